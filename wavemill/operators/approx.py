"""Approximations compared with spectral selection: rounding, top-k, weighted low rank, adapter counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.operators.krylov import low_rank
from wavemill.operators.matrix import ID
from wavemill.operators.selection import select_largest
from wavemill.session import materialize

# Fixed values of the compared methods.
BITS = 4
RANK = 8
ZERO_BELOW = 1e-8
WEIGHT_FLOOR = 0.3


def quantize(table: DataFrame, v: str = "v", bits: int = BITS, scope=(ID,), out: str = "approx") -> DataFrame:
    """Symmetric rounding to ``bits``: scale by the largest magnitude of the scope, round half to even.

    A scope whose largest magnitude is below 1e-8 has no scale and gives NULL.
    ``scope`` may name block columns for one scale per block.
    """
    steps = float(2 ** (bits - 1) - 1)
    largest = F.max(F.abs(F.col(v))).over(Window.partitionBy(*scope))
    scale = F.when(largest >= F.lit(ZERO_BELOW), largest / F.lit(steps))
    return table.withColumn("scale", scale).withColumn(out, F.rint(F.col(v) / F.col("scale")) * F.col("scale"))


def quantize_rows(rows: DataFrame, bits: int = BITS, out: str = "approx") -> DataFrame:
    """``quantize`` of whole matrices given by rows: one number a matrix is joined, no cell becomes a row."""
    steps = float(2 ** (bits - 1) - 1)
    largest = rows.groupBy(ID).agg(F.max(F.array_max(F.transform("row", F.abs))).alias("__largest"))
    scale = F.when(F.col("__largest") >= F.lit(ZERO_BELOW), F.col("__largest") / F.lit(steps))
    scaled = rows.join(largest.select(ID, scale.alias("scale")), ID)
    return scaled.withColumn(out, F.transform("row", lambda x: F.rint(x / F.col("scale")) * F.col("scale")))


def parameter_count(keep_fraction: float | None = None, rank: int = RANK) -> Column:
    """Coefficients kept by the top-k method: as many as a rank-``rank`` pair of factors has, or a fraction."""
    size = F.col("n_rows").cast("bigint") * F.col("n_cols")
    if keep_fraction is None:
        wanted = F.lit(rank) * (F.col("n_rows").cast("bigint") + F.col("n_cols"))
    else:
        wanted = F.floor(size * F.lit(float(keep_fraction)))
    return F.greatest(F.lit(1), F.least(wanted, size))


def select_topk(dense: DataFrame, keep_fraction: float | None = None, out: str = "keep") -> DataFrame:
    return select_largest(dense, parameter_count(keep_fraction), "coef", out)


def cosine_weight(i: Column, j: Column, n_rows: Column, n_cols: Column) -> Column:
    """Position weight in [0, 1]: 1 in the top-left and bottom-right corners, 0 along the other diagonal."""
    x = i / F.greatest(n_rows - 1, F.lit(1)).cast("double")
    y = j / F.greatest(n_cols - 1, F.lit(1)).cast("double")
    return F.lit(0.5) + F.lit(0.5) * F.cos(F.lit(math.pi) * x + F.lit(math.pi) * y)


def cosine_low_rank(rows: DataFrame, rank: int = RANK, blend: bool = True) -> DataFrame:
    """Low rank of the weighted matrix, unweighted again and mixed with the original by weight².

    Without ``blend`` the result is the division alone, with its lower weight floor of 0.01. The
    weighted rows are written once, since the low rank reads them several times.
    """
    heights = rows.groupBy(ID).agg(F.count(F.lit(1)).alias("n_rows"))
    sized = rows.join(heights, ID).withColumn(
        "weight",
        F.transform(
            "row", lambda x, j: cosine_weight(F.col("i"), j, F.col("n_rows"), F.size("row"))
        ),
    )
    weighted = sized.select(
        ID,
        "i",
        F.col("row").alias("original"),
        "weight",
        F.zip_with("row", "weight", lambda x, w: x * w).alias("row"),
    )
    done = low_rank(materialize(weighted, "weighted"), rank)
    floor = F.lit(WEIGHT_FLOOR if blend else 0.01)

    def restore(p):
        divided = p["approx"] / F.greatest(p["weight"], floor)
        if not blend:
            return divided
        trust = p["weight"] * p["weight"]
        return trust * divided + (F.lit(1.0) - trust) * p["original"]

    zipped = F.arrays_zip("original", "weight", "approx")
    return done.select(ID, "i", F.col("original").alias("row"), F.transform(zipped, restore).alias("approx"))


def adapter_ratio(catalog: DataFrame, matched: Column, rank: int) -> DataFrame:
    """Parameters of rank-``rank`` adapters on the matched entries, and their part of the enlarged total."""
    adapters = F.coalesce(
        F.sum(F.when(matched, F.lit(rank).cast("bigint") * (F.col("n_rows") + F.col("n_cols")))), F.lit(0)
    )
    total = F.sum(F.col("n_rows").cast("bigint") * F.col("n_cols"))
    return catalog.agg(adapters.alias("trainable"), total.alias("base")).select(
        F.lit(rank).alias("rank"),
        "trainable",
        (F.col("base") + F.col("trainable")).alias("total"),
        (F.col("trainable") / (F.col("base") + F.col("trainable"))).alias("ratio"),
    )
