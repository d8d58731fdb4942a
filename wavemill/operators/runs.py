"""Masks as runs of kept positions: ``matrix_id, n_cols, block, first, last``.

The position of (k, l) is k * n_cols + l. A run keeps first..last, both included, and never crosses a
block of BLOCK positions, so whatever puts runs in order does so within (matrix, block): at most BLOCK
of them, however large the matrix. A row or a whole matrix that is kept is one run a block, and
masks are combined and counted without a row for each place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.operators.matrix import ID

BITS = 20
BLOCK = 1 << BITS
KEYS = (ID, "n_cols", "block")


def _cut(ends: DataFrame) -> DataFrame:
    """Stretches (first, last) of any length as runs that stay within a block."""
    low, high = F.shiftright("first", BITS), F.shiftright("last", BITS)
    blocks = ends.where(F.col("first") <= F.col("last")).withColumn("block", F.explode(F.sequence(low, high)))
    start = F.col("block") * F.lit(BLOCK)
    return blocks.select(
        *KEYS, F.greatest("first", start).alias("first"), F.least("last", start + F.lit(BLOCK - 1)).alias("last")
    )


def _swept(events: DataFrame, keep: Column) -> DataFrame:
    """Runs in which ``keep`` holds, from steps ``a`` and ``b`` at positions ``at`` (after their sums)."""
    steps = events.groupBy(*KEYS, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    order = Window.partitionBy(*KEYS).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    depth = steps.select(*KEYS, "at", F.sum("a").over(so_far).alias("a"), F.sum("b").over(so_far).alias("b"))
    flagged = depth.withColumn("on", keep)
    turns = flagged.withColumn("before", F.coalesce(F.lag("on").over(order), F.lit(False))).where(F.col("on") != F.col("before"))
    # What is on is turned off again within the block, at the place behind its last one.
    ends = turns.withColumn("next", F.lead("at").over(order)).where("on")
    return ends.select(*KEYS, F.col("at").alias("first"), (F.col("next") - 1).alias("last"))


def _events(table: DataFrame, a: int, b: int) -> DataFrame:
    both = F.array(
        F.struct(F.col("first").alias("at"), F.lit(a).alias("a"), F.lit(b).alias("b")),
        F.struct((F.col("last") + 1).alias("at"), F.lit(-a).alias("a"), F.lit(-b).alias("b")),
    )
    return table.select(*KEYS, F.inline(both))


def merged(ends: DataFrame) -> DataFrame:
    """Runs of stretches (matrix_id, n_cols, first, last) of any length, which may touch, overlap or repeat."""
    return _swept(_events(_cut(ends), 1, 0), F.col("a") > 0)


def from_places(mask: DataFrame) -> DataFrame:
    """Runs of kept places (matrix_id, n_cols, k, l)."""
    at = F.col("k").cast("bigint") * F.col("n_cols") + F.col("l")
    return merged(mask.select(ID, "n_cols", at.alias("first"), at.alias("last")))


def _combined(a: DataFrame, b: DataFrame, keep: Column) -> DataFrame:
    return _swept(_events(a, 1, 0).unionByName(_events(b, 0, 1)), keep)


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combined(a, b, (F.col("a") > 0) & (F.col("b") > 0))


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combined(a, b, (F.col("a") > 0) | (F.col("b") > 0))


def first_only(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combined(a, b, (F.col("a") > 0) & (F.col("b") <= 0))


def counts(table: DataFrame) -> DataFrame:
    """``matrix_id, kept, runs``: places kept and runs that hold them; a matrix without any has no row."""
    kept = F.sum(F.col("last") - F.col("first") + 1)
    return table.groupBy(ID).agg(kept.alias("kept"), F.count(F.lit(1)).alias("runs"))


def places(table: DataFrame) -> DataFrame:
    """Every kept place (matrix_id, k, l), as many rows as the mask keeps; a run is BLOCK places at most."""
    at = table.select(ID, "n_cols", F.explode(F.sequence("first", "last")).alias("at"))
    return at.select(ID, F.floor(F.col("at") / F.col("n_cols")).cast("bigint").alias("k"), (F.col("at") % F.col("n_cols")).cast("int").alias("l"))
