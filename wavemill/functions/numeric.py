"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(x: Column, places: int = 6) -> Column:
    """Round for output, without negative zero."""
    return F.round(x, places) + F.lit(0.0)


def present(x: Column) -> Column:
    """True for values that are neither NULL nor NaN."""
    return x.isNotNull() & ~F.isnan(x)


def unit_clamp(x: Column) -> Column:
    """NULL and NaN to 0, then into [0, 1]; NaN goes first because greatest() would return it."""
    return F.least(F.greatest(F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def magnitude_level(x: Column, bits: int) -> Column:
    """Integer that never falls as ``x`` rises: binary exponent and ``bits`` leading mantissa bits.

    Used to cut an ordering by a DOUBLE into many small buckets.
    """
    size = F.least(F.abs(x), F.lit(1.7e308))
    exponent = F.floor(F.log2(size))
    fraction = size / F.pow(F.lit(2.0), exponent.cast("double")) - F.lit(1.0)
    level = (exponent + F.lit(1100)) * F.lit(1 << bits) + F.floor(fraction * F.lit(float(1 << bits)))
    level = F.when(size < F.lit(1e-300), F.lit(0)).otherwise(level).cast("bigint")
    return F.when(x < 0, -level).otherwise(level)


def finer_levels(x: Column, bits: int, widths: tuple[int, ...] = (20, 20)) -> list[Column]:
    """Levels below ``magnitude_level(x, bits)``: the next ``widths`` mantissa bits each, falling for negative values.

    Scaling by powers of two and taking off whole parts is exact, so all levels together tell every two
    DOUBLE values apart that are not subnormal.
    """
    size = F.least(F.abs(x), F.lit(1.7e308))
    exponent = F.floor(F.log2(size)).cast("double")
    # In two steps: one power of two may lie beyond the range of DOUBLE.
    half = F.floor(exponent / 2)
    rest = (size / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), exponent - half) - F.lit(1.0)) * F.lit(float(1 << bits))
    levels = []
    for width in widths:
        rest = (rest - F.floor(rest)) * F.lit(float(1 << width))
        level = F.when(size < F.lit(1e-300), F.lit(0)).otherwise(F.floor(rest)).cast("bigint")
        levels.append(F.when(x < 0, -level).otherwise(level))
    return levels


def integer_levels(key: Column, shifts=(40, 20)) -> list[Column]:
    """Coarse-to-fine prefixes of an integer key; a finest bucket spans 2**min(shifts) values."""
    return [F.shiftright(key.cast("bigint"), s) for s in shifts]
