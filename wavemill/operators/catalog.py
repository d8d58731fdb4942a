"""Choosing entries of a catalog of matrices (name, shape, order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.operators.ranking import rank_in_group
from wavemill.operators.slices import filter_or_all, name_contains


def catalog_from_items(items: DataFrame, kind: str, sub: str, extent: str) -> DataFrame:
    """One entry per (kind, sub): rows are items counted, columns the largest extent."""
    entries = items.groupBy(F.col(kind).alias("kind"), F.col(sub).alias("__sub")).agg(
        F.count(F.lit(1)).cast("int").alias("n_rows"), F.max(extent).cast("int").alias("n_cols")
    )
    named = entries.withColumn("name", F.concat_ws(".", "kind", "__sub")).drop("__sub")
    ordered = rank_in_group(named.withColumn("__all", F.lit(1)), ["__all"], [F.col("kind")], ["name"], "ord")
    return ordered.select(
        F.col("name").alias("matrix_id"),
        "name",
        "kind",
        F.col("ord").cast("int").alias("ord"),
        F.when(F.col("n_cols") == 1, 1).otherwise(2).alias("n_dims"),
        "n_rows",
        "n_cols",
        F.lit(4).alias("bytes_per_value"),
    )


def select_named(catalog: DataFrame, parts: list[str]) -> DataFrame:
    """Two-dimensional entries whose name contains any of ``parts``."""
    return catalog.where(name_contains("name", parts) & (F.col("n_dims") >= 2))


def select_named_or_small(catalog: DataFrame, parts: list[str], max_rows: int) -> DataFrame:
    """As ``select_named``; if no entry matches, every two-dimensional one of at most ``max_rows`` rows."""
    flat = catalog.where(F.col("n_dims") >= 2)
    chosen = filter_or_all(flat, name_contains("name", parts))
    return chosen.where(name_contains("name", parts) | (F.col("n_rows") <= max_rows))


def first_entries(catalog: DataFrame, count: int) -> DataFrame:
    return catalog.orderBy("ord").limit(count)


def first_entries_by(catalog: DataFrame, group: str, count: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(group).orderBy("ord"))
    return catalog.withColumn("__place", place).where(F.col("__place") <= F.lit(count)).drop("__place")
