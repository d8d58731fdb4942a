"""Ranks and running sums inside groups of any size.

A plain window over a group puts the whole group in one task. Here the ordering
is first cut into buckets by columns that never fall as the order rises. Bucket
counts combine map-side and are summed along the buckets; only rows of one
bucket ever meet in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions.hashing import u32
from wavemill.functions.numeric import finer_levels, integer_levels, magnitude_level

KEY = "__key"
#: Distinct values of a bucket that meet in one window; fuller buckets are cut by further bits.
BUCKET_VALUES = 1 << 16


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL; keeps the left copy of the keys.

    The keys are compared as one struct, whose NULL fields are equal. A left side
    already laid out by the same struct in a window is not shuffled again.
    """
    mine = left if KEY in left.columns else left.withColumn(KEY, F.struct(*keys))
    theirs = right.select(F.struct(*keys).alias(KEY), *[c for c in right.columns if c not in keys])
    return mine.join(theirs, KEY, how).drop(KEY)


def prefix_offsets(
    parts: DataFrame, group: list[str], levels: list[str], measures: list[str]
) -> DataFrame:
    """Sum of each measure over all earlier buckets of the group, as ``before_<measure>``.

    Works level by level: siblings are summed under their parent, the parent's own
    offset is added. Each window holds the children of one parent only.
    """
    *outer, last = levels
    w = Window.partitionBy(*group, *outer).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
    here = parts.select(
        *group,
        *levels,
        *measures,
        *[F.coalesce(F.sum(m).over(w), F.lit(0)).alias(f"before_{m}") for m in measures],
    )
    if not outer:
        return here
    parents = parts.groupBy(*group, *outer).agg(*[F.sum(m).alias(m) for m in measures])
    above = prefix_offsets(parents, group, outer, measures).select(
        *group, *outer, *[F.col(f"before_{m}").alias(f"__up_{m}") for m in measures]
    )
    joined = join_null_safe(here, above, [*group, *outer])
    for m in measures:
        joined = joined.withColumn(f"before_{m}", F.col(f"before_{m}") + F.col(f"__up_{m}"))
    return joined.drop(*[f"__up_{m}" for m in measures])


def rank_in_group(
    df: DataFrame, group: list[str], levels: list[Column], order: list[str], out: str = "rank"
) -> DataFrame:
    """Rank from 0 of each row in its group under ``order``; ``levels`` are coarse-to-fine buckets of it."""
    names = [f"__level{n}" for n in range(len(levels))]
    cut = df.select("*", *[c.alias(n) for c, n in zip(levels, names)])
    counts = cut.groupBy(*group, *names).agg(F.count(F.lit(1)).alias("__n"))
    offsets = prefix_offsets(counts, group, names, ["__n"]).select(*group, *names, "before___n")
    w = Window.partitionBy(KEY).orderBy(*order)
    placed = cut.withColumn(KEY, F.struct(*group, *names)).withColumn("__row", F.row_number().over(w))
    joined = join_null_safe(placed, offsets, [*group, *names])
    return joined.withColumn(out, F.col("before___n") + F.col("__row") - F.lit(1)).drop(
        "before___n", "__row", *names
    )


def rank_by_id(df: DataFrame, group: list[str], key: str, out: str = "rank", shifts=(40, 20)) -> DataFrame:
    """Rank by a unique integer key; a bucket spans 2**20 key values, so it holds at most that many rows."""
    return rank_in_group(df, group, integer_levels(F.col(key), shifts), [key], out)


def pick_first_by_hash(
    df: DataFrame, group: list[str], key: str, quota, seed=42, bits: int = 16, out: str = "picked"
) -> DataFrame:
    """Mark the first ``quota(n)`` rows of each group in the order of a seeded hash of ``key``.

    Hash prefixes are counted per group; the prefix in which the quota is met is
    ranked row by row, all others are decided by their prefix alone, so the rows
    themselves are shuffled only for that one prefix.
    """
    hashed = df.withColumn("__hash", u32(seed, F.col(key))).withColumn(
        "__prefix", F.shiftright("__hash", 32 - bits)
    )
    counts = hashed.groupBy(*group, "__prefix").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("__prefix").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        counts.select(
            *group,
            F.col("__prefix").alias("__edge"),
            (F.sum("__n").over(upto) - F.col("__n")).alias("__before"),
            F.sum("__n").over(upto).alias("__upto"),
            quota(F.sum("__n").over(whole)).alias("__quota"),
        )
        .where((F.col("__before") < F.col("__quota")) & (F.col("__quota") <= F.col("__upto")))
        .select(*group, "__edge", (F.col("__quota") - F.col("__before")).alias("__left"))
    )
    tagged = join_null_safe(hashed, edge, group, "left")
    clear = tagged.where(F.col("__edge").isNull() | (F.col("__prefix") != F.col("__edge"))).withColumn(
        out, F.coalesce(F.col("__prefix") < F.col("__edge"), F.lit(False))
    )
    place = F.row_number().over(Window.partitionBy(*group).orderBy("__hash", key))
    close = (
        tagged.where(F.col("__prefix") == F.col("__edge"))
        .withColumn("__place", place)
        .withColumn(out, F.col("__place") <= F.col("__left"))
        .drop("__place")
    )
    return clear.unionByName(close).drop("__hash", "__prefix", "__edge", "__left")


def refined(rows: DataFrame, group: list[str], levels: dict[str, Column], limit: int) -> DataFrame:
    """Add ``levels``, coarse to fine; a finer one is 0 where the bucket of those before it holds ``limit`` rows or fewer.

    Counts of buckets combine map-side; rows are matched to the counts of their bucket, never sorted.
    """
    names = list(levels)
    out = rows.withColumn(names[0], levels[names[0]])
    for depth, name in enumerate(names[1:], 1):
        bucket = [*group, *names[:depth]]
        full = out.groupBy(*bucket).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)
        out = join_null_safe(out, full, bucket, "left").withColumn(name, F.when(F.col("__n").isNotNull(), levels[name]).otherwise(F.lit(0).cast("bigint"))).drop("__n")
    return out


def average_ranks(df: DataFrame, group: list[str], value: str, weights: dict[str, Column] | None = None,
                  bits: int = 12, bucket_values: int = BUCKET_VALUES) -> DataFrame:
    """One row per distinct value: number of ties and their average rank in the group.

    Equal values are merged before the shuffle. ``weights`` are further
    aggregates taken over the rows that share the value. Buckets of more than
    ``bucket_values`` distinct values are cut by the next bits, down to the last.
    """
    extra = [c.alias(n) for n, c in (weights or {}).items()]
    distinct = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("ties"), *extra)
    x = F.col(value).cast("double")
    levels = {"__level": magnitude_level(x, bits)} | {f"__level{n}": c for n, c in enumerate(finer_levels(x, bits), 1)}
    names = list(levels)
    cut = refined(distinct, group, levels, bucket_values)
    counts = cut.groupBy(*group, *names).agg(F.sum("ties").alias("ties"))
    offsets = prefix_offsets(counts, group, names, ["ties"]).drop("ties")
    w = Window.partitionBy(KEY).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn(KEY, F.struct(*group, *names)).withColumn("__inside", F.coalesce(F.sum("ties").over(w), F.lit(0)))
    first = F.col("before_ties") + F.col("__inside")
    return (
        join_null_safe(placed, offsets, [*group, *names])
        .withColumn("avg_rank", first.cast("double") + (F.col("ties") + 1) / F.lit(2.0))
        .withColumn("rank_before", first)
        .drop(*names, "__inside", "before_ties")
    )


def group_median(df: DataFrame, group: list[str], value: str, out: str = "median", bits: int = 12) -> DataFrame:
    """Exact median per group without holding a group in one task: only the middle ranks are read."""
    ranked = average_ranks(df, group, value)
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    low = F.floor((F.col("__n") - 1) / 2)
    high = F.floor(F.col("__n") / 2)

    def covers(rank):
        return (F.col("rank_before") <= rank) & (rank < F.col("rank_before") + F.col("ties"))

    middle = join_null_safe(ranked, sizes, group)
    return (
        middle.where(covers(low) | covers(high))
        .groupBy(*group)
        .agg(((F.min(value) + F.max(value)) / F.lit(2.0)).alias(out))
    )
