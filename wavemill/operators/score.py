"""Fidelity, retained energy, compression and size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.functions.numeric import unit_clamp
from wavemill.operators.matrix import ID

# Floors that keep ratios finite.
NORM_FLOOR = 1e-8
KEEP_FLOOR = 1e-3
ENERGY_FLOOR = 1e-12


def pair_cells(original: DataFrame, approx: DataFrame) -> DataFrame:
    """Line up two cell tables on position; a cell missing on one side counts as 0."""
    left = original.select(ID, "i", "j", F.col("v").alias("v"))
    right = approx.select(ID, "i", "j", F.col("v").alias("approx"))
    return left.join(right, [ID, "i", "j"], "full").na.fill(0.0, ["v", "approx"])


def fidelity(v: Column, approx: Column) -> Column:
    """Aggregate: 1 - |v - approx| / |v|, into [0, 1]; NaN in the approximation counts as 0."""
    error = v - F.nanvl(approx, F.lit(0.0))
    distance = F.sqrt(F.sum(error * error))
    return unit_clamp(F.lit(1.0) - distance / F.greatest(F.sqrt(F.sum(v * v)), F.lit(NORM_FLOOR)))


def row_fidelity(rows: DataFrame, v: str = "row", approx: str = "approx") -> DataFrame:
    """``fidelity`` per matrix from arrays that lie side by side: two sums a row, no cell becomes a row.

    An approximation with a NULL in every cell gives NULL.
    """
    def squares(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda total, e: total + e * e)

    off = F.zip_with(v, approx, lambda x, y: x - F.nanvl(y, F.lit(0.0)))
    sums = rows.groupBy(ID).agg(F.sum(squares(off)).alias("__off"), F.sum(squares(F.col(v))).alias("__all"))
    distance = F.sqrt("__off") / F.greatest(F.sqrt("__all"), F.lit(NORM_FLOOR))
    return sums.select(ID, unit_clamp(F.lit(1.0) - distance).alias("fidelity"))


def retained_energy(c: Column, keep: Column) -> Column:
    """Aggregate: part of the energy that lies in kept places."""
    inside = F.sum(F.when(keep, c * c).otherwise(F.lit(0.0)))
    return F.coalesce(
        F.nanvl(inside / (F.sum(c * c) + F.lit(ENERGY_FLOOR)), F.lit(0.0)), F.lit(0.0)
    )


def kept_count(keep: Column) -> Column:
    return F.count_if(keep)


def compression_ratio(keep: Column) -> Column:
    """Aggregate: 1 / share of kept places, with a floor under the share."""
    return F.lit(1.0) / F.greatest(F.avg(keep.cast("int")), F.lit(KEEP_FLOOR))


def mean_or(x: Column, default: float) -> Column:
    """Aggregate: mean of the values that are neither NULL nor NaN."""
    return F.coalesce(F.avg(F.when(~F.isnan(x), x)), F.lit(default))


def average_scores(scores: DataFrame, *by: str) -> DataFrame:
    """Mean fidelity and ratio over matrices."""
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("matrices"),
        mean_or(F.col("fidelity"), 0.0).alias("fidelity"),
        mean_or(F.col("ratio"), 1.0).alias("ratio"),
    )


def catalog_gigabytes() -> Column:
    """Aggregate over a catalog: stored size in GB."""
    size = F.col("n_rows").cast("double") * F.col("n_cols") * F.col("bytes_per_value")
    return F.sum(size) / F.lit(1e9)
