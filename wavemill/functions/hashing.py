"""Randomness as a function of seed and key, so a retried task draws the same values."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the integer generator shared with the SQL checks.
MODULUS = 2147483647
STRIDE = 1000003
MULTIPLIERS = (48271, 16807)
INCREMENTS = (12345, 67891)


def u32(seed, *parts: Column) -> Column:
    """First 32 bits of md5("seed:part:...") as a BIGINT."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(seed, *parts: Column) -> Column:
    """Uniform on [0, 1) with 32 bits."""
    return u32(seed, *parts) / F.lit(4294967296.0)


def key_pair(seed, *parts: Column) -> Column:
    """Two integers of 30 bits each, ``first`` and ``second``, from one md5: the state of a key's draws."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    digest = F.md5(text)

    def bits(at):
        return F.shiftright(F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint"), 2)

    return F.struct(bits(1).alias("first"), bits(9).alias("second"))


def with_draws(df: DataFrame, base: str, draws: int, out: str = "x", draw: str = "b") -> DataFrame:
    """Repeat each row ``draws`` times, numbered ``draw``, with an integer ``out`` in [0, MODULUS).

    One md5 per row (its ``base``, a ``key_pair``) and a few multiplications per draw; every
    product stays below 2**62, so it is exact in BIGINT arithmetic. Each step is a
    column of its own, so squares are not expanded into copies of the expression.
    """
    p = F.lit(MODULUS)
    b, x = F.col(draw), F.col(out)
    first, second = F.col(base)["first"], F.col(base)["second"]
    numbered = df.withColumn(draw, F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn(
        out, (first + b.cast("bigint") * F.lit(STRIDE)) % p
    )
    for multiplier, increment, shift in zip(MULTIPLIERS, INCREMENTS, (b + second, F.lit(0))):
        numbered = numbered.withColumn(out, (x * x + F.lit(increment)) % p)
        numbered = numbered.withColumn(out, (x * F.lit(multiplier) + shift) % p)
    return numbered


def held_sums(values: np.ndarray, draws: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Sum of ``draws`` values drawn with replacement, for each key pair, by the steps of ``with_draws``."""
    ends = np.cumsum(draws)
    t = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - draws, draws)
    x = (np.repeat(first, draws) + t * STRIDE) % MODULUS
    for multiplier, increment, shift in zip(MULTIPLIERS, INCREMENTS, (t + np.repeat(second, draws), 0)):
        x = (x * x + increment) % MODULUS
        x = (x * multiplier + shift) % MODULUS
    taken = values[np.floor(x * len(values) / float(MODULUS)).astype(np.int64)]
    return np.add.reduceat(taken, ends - draws) if len(taken) else np.zeros(0)


def poisson_cuts() -> list[int]:
    """Cumulative Poisson(1) probabilities scaled to the generator's range, as far as it tells them apart."""
    cuts, mass, count = [], 0.0, 0
    while not cuts or cuts[-1] < MODULUS - 1:
        mass += math.exp(-1.0) / math.factorial(count)
        cuts.append(int(mass * MODULUS))
        count += 1
    return cuts


def poisson_weight(x: Column) -> Column:
    """Poisson(1) count for a scrambled integer, by inverse cumulative probability."""
    total = F.lit(0)
    for cut in poisson_cuts():
        total = total + (x >= F.lit(cut)).cast("int")
    return total


def gaussian(seed, *parts: Column) -> Column:
    """Standard normal by Box-Muller from two hashed uniforms."""
    u1 = F.lit(1.0) - uniform(f"{seed}:a", *parts)
    u2 = uniform(f"{seed}:b", *parts)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
