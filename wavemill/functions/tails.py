"""Tail probabilities, as numeric integrals over array expressions (no Python worker)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERVALS = 2000
#: In units of 1/sqrt(df) the cosine power is zero in DOUBLE beyond this angle.
FAR = 40.0


def _simpson(low: Column, high: Column, f) -> Column:
    """Integral of ``f`` from ``low`` to ``high`` by Simpson's rule on INTERVALS pieces."""
    step = (high - low) / F.lit(float(INTERVALS))

    def weight(i):
        return F.when((i == 0) | (i == INTERVALS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)

    total = F.aggregate(
        F.sequence(F.lit(0), F.lit(INTERVALS)),
        F.lit(0.0),
        lambda acc, i: acc + weight(i) * f(low + step * i.cast("double")),
    )
    return total * step / F.lit(3.0)


def normal_two_sided(z: Column) -> Column:
    a = F.abs(z)
    area = _simpson(a, a + F.lit(10.0), lambda x: F.exp(-x * x / F.lit(2.0)))
    return F.lit(2.0 / math.sqrt(2.0 * math.pi)) * area


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) for Student's t; with theta = atan(|t|/sqrt(df)) a ratio of cosine powers.

    The power falls off over angles of 1/sqrt(df), so the integrals end FAR such units
    out, or at a right angle: the rule is as fine for any df.
    """
    end = F.least(F.lit(math.pi / 2.0), F.lit(FAR) / F.sqrt(df))
    theta = F.least(F.atan(F.abs(t) / F.sqrt(df)), end)

    def power(x):
        return F.pow(F.greatest(F.cos(x), F.lit(0.0)), df - F.lit(1.0))

    ratio = _simpson(theta, end, power) / _simpson(F.lit(0.0), end, power)
    # least() passes over NULL, so an unknown t is kept apart.
    return F.when(F.abs(t) == F.lit(float("inf")), F.lit(0.0)).when(t.isNotNull(), ratio)


def signed_rank_exact(w: Column, n: Column) -> Column:
    """Exact two-sided p of the signed-rank statistic for at most 50 untied, non-zero differences.

    Counts the subsets of {1..n} by sum, one rank at a time, then adds the lower tail.
    """
    sums = (n * (n + 1) / 2).cast("int")
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), sums))
    counts = F.aggregate(
        F.sequence(F.lit(1), n.cast("int")),
        start,
        lambda acc, r: F.transform(
            acc,
            lambda x, s: x + F.when(s >= r, F.get(acc, s - r)).otherwise(F.lit(0.0)),
        ),
    )
    lower = F.aggregate(F.slice(counts, F.lit(1), w.cast("int") + 1), F.lit(0.0), lambda a, x: a + x)
    return F.least(F.lit(1.0), F.lit(2.0) * lower / F.pow(F.lit(2.0), n.cast("double")))
