"""Exact draws from the discrete Gaussian on the integers, from a keyed stream of bits.

Rejection from a two-sided geometric law (Canonne, Kamath, Steinke 2020). Every step is an integer
comparison, so the law holds to its last digit and has no largest value; the same key gives the
same draw.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable


def bit_stream(secret: str, name: str) -> Callable[[int], int]:
    """``below(n)``: uniform integers of 0..n - 1, from SHA-512 of the name and a counter under the secret."""
    pool, held, counter = 0, 0, 0

    def below(n: int) -> int:
        nonlocal pool, held, counter
        need = (n - 1).bit_length()
        while True:
            while held < need:
                block = hmac.digest(secret.encode(), f"{counter}:{name}".encode(), hashlib.sha512)
                pool, held, counter = pool << 512 | int.from_bytes(block, "big"), held + 512, counter + 1
            held -= need
            drawn, pool = pool >> held, pool & (1 << held) - 1
            if drawn < n:
                return drawn

    return below


def _decays(below: Callable[[int], int], top: int, bottom: int) -> bool:
    """True with probability exp(-top / bottom)."""
    while top > bottom:
        if not _decays(below, 1, 1):
            return False
        top -= bottom
    passed = 1
    while below(bottom * passed) < top:
        passed += 1
    return passed % 2 == 1


def discrete_gaussian(below: Callable[[int], int], scale: int) -> int:
    """An integer z with probability in proportion to exp(-z² / (2 scale²)); ``scale`` is 1 or more."""
    side, square = scale + 1, scale * scale
    while True:
        low = below(side)
        if not _decays(below, low, side):
            continue
        high = 0
        while _decays(below, 1, 1):
            high += 1
        size, negative = low + side * high, below(2)
        if negative and not size:
            continue
        gap = size * side - square
        if _decays(below, gap * gap, 2 * square * side * side):
            return -size if negative else size
