"""Slices of text datasets, their splits, caps and reports."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.functions.hashing import u32
from wavemill.operators.ranking import join_null_safe, pick_first_by_hash

# Fixed values of the reproducible splits.
SEED = 42


def equals_nocase(column: str | None, value: str, default: str) -> Column:
    """Case-insensitive equality; a missing value or a missing column (None) counts as ``default``."""
    actual = F.lit(default) if column is None else F.coalesce(F.col(column), F.lit(default))
    return F.lower(actual) == F.lit(value.lower())


def filter_or_all(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows that match, or every row if none does. One scalar subquery decides; nothing comes to the driver."""
    any_match = df.agg(F.coalesce(F.bool_or(predicate), F.lit(False)).alias("any")).scalar()
    return df.where(predicate | ~any_match)


def name_contains(column: str, parts: list[str]) -> Column:
    """True where the name contains any of ``parts``."""
    return F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(F.col(column), p))


def split_exact(
    df: DataFrame, segment: list[str], key: str, share: float | str | Fraction = "0.2", seed: int = SEED, bits: int = 16
) -> DataFrame:
    """Exactly ceil(share * n) test rows per segment, the rest train, by a seeded hash of a unique key.

    The share is taken as the fraction it is written as (0.15 is 15/100), so no product is rounded.
    """
    part = Fraction(str(share))
    if not 0 <= part <= 1:
        raise ValueError("share lies between 0 and 1")
    over, under = F.lit(part.numerator), F.lit(part.denominator)
    quota = lambda n: F.call_function("div", n * over + under - 1, under)
    marked = pick_first_by_hash(df, segment, key, quota, seed, bits, "__test")
    return marked.withColumn("split", F.when(F.col("__test"), "test").otherwise("train")).drop("__test")


def split_hash(df: DataFrame, key: str, fraction: float = 0.2, seed: int = SEED) -> DataFrame:
    """Split by the hash alone: no counting, no shuffle, also valid on a stream."""
    below = u32(seed, F.col(key)) < F.lit(int(fraction * 4294967296))
    return df.withColumn("split", F.when(below, "test").otherwise("train"))


def sample_cap(df: DataFrame, key: str, cap: int, seed: int = SEED) -> DataFrame:
    """At most ``cap`` rows, those first in hash order; each task keeps its own first rows."""
    return df.orderBy(u32(seed, F.col(key)), key).limit(cap)


def sample_cap_by(df: DataFrame, segment: list[str], key: str, cap: int, seed: int = SEED) -> DataFrame:
    """The same cap for each segment."""
    marked = pick_first_by_hash(df, segment, key, lambda n: F.least(n, F.lit(cap)), seed, out="__in")
    return marked.where("__in").drop("__in")


def split_report(split: DataFrame, segment: str, expected: DataFrame) -> DataFrame:
    """Rows per segment and split; expected segments without rows appear with 0."""
    counts = split.groupBy(segment, "split").agg(F.count(F.lit(1)).alias("n"))
    wanted = expected.select(segment).distinct().select(
        segment, F.explode(F.array(F.lit("train"), F.lit("test"))).alias("split")
    )
    return join_null_safe(wanted, counts, [segment, "split"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )
