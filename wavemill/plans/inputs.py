"""The test tables in the roles the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.operators import strips
from wavemill.operators.catalog import catalog_from_items
from wavemill.operators.matrix import (
    cells,
    dense_from_facts,
    rows_from_vectors,
    rows_in_any_order,
)
from wavemill.sources.tables import read_table

FIRST_YEAR, YEARS = 1995, 7
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def embedding_rows(spark, sf_dir) -> DataFrame:
    """One matrix per label, of any height, rows in the order of vec_id."""
    return rows_from_vectors(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


def embedding_keyed(spark, sf_dir) -> DataFrame:
    """The same rows beside their keys, for strips: order by key, not ranked."""
    return strips.vectors_by_key(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


def embedding_vectors(spark, sf_dir) -> DataFrame:
    """The same rows without their position."""
    return rows_in_any_order(table(spark, sf_dir, "embeddings"), "label", "embedding")


def user_hours(spark, sf_dir) -> DataFrame:
    """7 weekdays x 24 hours of summed value per user."""
    ts = F.col("ts")
    return dense_from_facts(
        table(spark, sf_dir, "events"),
        F.col("user_id"), F.dayofweek(ts) - 1, F.hour(ts), 7, 24, vals=F.col("value"),
    )


def supplier_months(spark, sf_dir, by: Column | None = None) -> DataFrame:
    """12 months x 7 years per supplier: quantity, and discount given as its gradient."""
    ship = F.col("l_shipdate")
    return dense_from_facts(
        table(spark, sf_dir, "lineitem"),
        F.col("l_suppkey") if by is None else by,
        F.month(ship) - 1,
        F.year(ship) - FIRST_YEAR,
        12,
        YEARS,
        vals=F.col("l_quantity"),
        grad=F.col("l_extendedprice") * F.col("l_discount"),
    )


def event_tensor(spark, sf_dir) -> DataFrame:
    """Cells (layer = day of month, head = event type, i = part of day, j = hour of part)."""
    ts = F.col("ts")
    place = F.array_position(F.array(*[F.lit(e) for e in EVENT_TYPES]), F.col("event_type"))
    unknown = F.raise_error(F.concat(F.lit("unknown event type "), F.coalesce("event_type", F.lit("NULL")))).cast("bigint")
    head = F.when(place > 0, place - 1).otherwise(unknown)
    heads = len(EVENT_TYPES)
    flat = dense_from_facts(
        table(spark, sf_dir, "events"),
        F.lit("all"), (F.dayofmonth(ts) - 1) * heads + head, F.hour(ts), 31 * heads, 24, vals=F.col("value"),
    )
    return cells(flat, v="vals").select(
        "matrix_id",
        F.floor(F.col("i") / heads).cast("int").alias("layer"),
        (F.col("i") % heads).cast("int").alias("head"),
        F.floor(F.col("j") / 6).cast("int").alias("i"),
        (F.col("j") % 6).cast("int").alias("j"),
        "v",
    )


def results(spark, sf_dir, seed: Column | None = None) -> DataFrame:
    """Results table: method = event type, pairing key = user unless given, value = mean value."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("method"), (F.col("user_id") if seed is None else seed).alias("seed"))
        .agg(F.avg("value").alias("value"))
        .select(
            "method", F.lit("events").alias("dataset"), F.col("seed").cast("bigint").alias("seed"),
            F.lit("value").alias("metric"), "value",
        )
    )


def catalog(spark, sf_dir) -> DataFrame:
    return catalog_from_items(table(spark, sf_dir, "part"), "p_type", "p_brand", "p_size")


def user_updates(spark, sf_dir) -> DataFrame:
    """Contributor = user, coordinate = event type, v = summed value."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("party"), F.col("event_type").alias("coord"))
        .agg(F.sum("value").alias("v"))
    )


def supplier_updates(spark, sf_dir, *by: Column) -> DataFrame:
    """Party = supplier, coordinate = month of shipment, v = mean quantity."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(*by, F.col("l_suppkey").alias("party"), F.month("l_shipdate").alias("coord"))
        .agg(F.avg("l_quantity").alias("v"))
    )
