"""All registered queries; importing a module registers what it holds."""

from __future__ import annotations

from wavemill.plans import methods, private, slicing, spectral, statistics  # noqa: F401
from wavemill.plans.registry import CHECKS, QUERIES


def queries():
    return dict(QUERIES)


def checks():
    return dict(CHECKS)
