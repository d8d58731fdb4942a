"""Summaries, bootstrap intervals and tests over a results table.

``results``: method STRING, dataset STRING, seed BIGINT (pairing key, unique per
method), metric STRING, value DOUBLE.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions.hashing import MODULUS, held_sums, key_pair, poisson_weight, with_draws
from wavemill.functions.numeric import present
from wavemill.functions.tails import normal_two_sided, signed_rank_exact, t_two_sided
from wavemill.operators.ranking import average_ranks, rank_by_id

# Fixed values of the summaries.
RESAMPLES = 1000
LOW, HIGH = 0.025, 0.975
EXACT_UP_TO = 50


def metric_values(results: DataFrame, metric: str) -> DataFrame:
    """Values of one metric without NULL and NaN."""
    return results.where((F.col("metric") == metric) & present(F.col("value"))).select("method", "seed", "value")


def summarize(values: DataFrame) -> DataFrame:
    return values.groupBy("method").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
    )


def _interval(means: DataFrame) -> DataFrame:
    """Percentile interval of at most RESAMPLES means per method, interpolated linearly."""
    return means.groupBy("method").agg(
        F.percentile("mean", F.lit(LOW)).alias("ci_low"), F.percentile("mean", F.lit(HIGH)).alias("ci_high")
    )


def bootstrap_poisson(values: DataFrame, resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """Interval of the mean for groups of any size.

    Each value gets a Poisson(1) weight per resample, a function of its key, so
    resamples are sums: they combine map-side and ``resamples`` rows per group and
    task are shuffled, however many values there are.
    """
    based = values.withColumn("__base", key_pair(seed, F.col("method"), F.col("seed")))
    drawn = with_draws(based, "__base", resamples).select("method", "value", "b", poisson_weight(F.col("x")).alias("w"))
    sums = (
        drawn.groupBy("method", "b")
        .agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("value")).alias("wx"))
    )
    return _interval(sums.select("method", F.try_divide("wx", "w").alias("mean")))


def bootstrap_exact(values: DataFrame, resamples: int = RESAMPLES, seed: int = 0, bits: int = 9) -> DataFrame:
    """Interval from drawing n of n values with replacement.

    The n draws of a resample are first dealt to buckets of 2**bits ranks, as counts that
    combine map-side; each bucket then draws its count from its own values, where they lie.
    Values are never moved for a draw: a bucket holds ``resamples`` counts and sends as many
    sums. A dealing task sends one count a resample and bucket it hits, so at most ``resamples``
    small rows per value in all. The largest group holds the values of one bucket.
    """
    ranked = rank_by_id(values, ["method"], "seed").withColumn("bucket", F.shiftright("rank", bits))
    sizes = values.groupBy("method").agg(F.count("value").alias("n"))
    share = F.shiftright(F.floor(F.col("x") * F.col("n") / F.lit(float(MODULUS))), bits)
    # Values are few against their draws, so they are dealt to all cores before they are multiplied.
    spread = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranked.join(sizes, "method").repartition(spread, "rank")
    dealt = dealt.select("method", "n", key_pair(seed, F.col("method"), F.col("rank")).alias("__base"))
    counts = with_draws(dealt, "__base", resamples).groupBy("method", share.alias("bucket"), "b").agg(
        F.count(F.lit(1)).alias("draws")
    )
    own = key_pair(f"{seed}:local", F.col("method"), F.col("bucket"), F.col("b"))
    asked = counts.withColumn("__base", own).select("method", "bucket", "b", "draws", "__base.*")
    held = ranked.select(F.col("method").alias("owner"), F.col("bucket").alias("part"), "rank", "value")

    def draw(values_: pa.Table, asked_: pa.Table) -> pa.Table:
        values_, asked_ = values_.sort_by("rank"), asked_.sort_by("b")
        drawn = held_sums(
            values_.column("value").to_numpy(), *(asked_.column(c).to_numpy() for c in ("draws", "first", "second"))
        )
        return pa.table({"method": asked_.column("method"), "b": asked_.column("b"), "draws": asked_.column("draws"), "total": drawn})

    sums = held.groupBy("owner", "part").cogroup(asked.groupBy("method", "bucket")).applyInArrow(
        draw, "method string, b int, draws bigint, total double"
    )
    means = sums.groupBy("method", "b").agg((F.sum("total") / F.sum("draws")).alias("mean"))
    return _interval(means)


def summary_with_interval(values: DataFrame, exact: bool = False, resamples: int = RESAMPLES, seed: int = 0):
    boot = bootstrap_exact if exact else bootstrap_poisson
    return summarize(values).join(boot(values, resamples, seed), "method", "left")


def formatted(summary: DataFrame) -> DataFrame:
    """Table cells as text, one decimal."""
    return summary.select(
        "method",
        F.format_string("%.1f±%.1f", "mean", "std").alias("mean_std"),
        F.format_string("[%.1f, %.1f]", "ci_low", "ci_high").alias("ci"),
    )


def pair_with(values: DataFrame, target: str) -> DataFrame:
    """Every other method's values beside the target's value of the same pairing key (NULL if none)."""
    base = values.where(F.col("method") == target).select("seed", F.col("value").alias("base"))
    return values.where(F.col("method") != target).join(base, "seed", "left")


def t_statistic(mean: Column, error: Column) -> Column:
    """mean/error; infinite if only the error is 0, NULL if both are."""
    return F.when(error > 0, mean / F.nullif(error, F.lit(0.0))).when(
        mean != 0, F.sign(mean) * F.lit(float("inf"))
    )


def paired_moments(pairs: DataFrame) -> DataFrame:
    difference = F.col("base") - F.col("value")
    return pairs.groupBy("method").agg(
        F.count("value").alias("n"),
        F.count("base").alias("n_pairs"),
        F.avg("value").alias("mean"),
        F.var_samp("value").alias("var"),
        F.avg(difference).alias("mean_d"),
        F.stddev_samp(difference).alias("sd_d"),
    )


def ttest_paired(pairs: DataFrame) -> DataFrame:
    """Paired t-test over matched keys only."""
    moments = paired_moments(pairs.where(F.col("base").isNotNull())).where(F.col("n_pairs") >= 2)
    t = t_statistic(F.col("mean_d"), F.col("sd_d") / F.sqrt("n_pairs"))
    return moments.select(
        "method", "n_pairs", t.alias("t"), (F.col("n_pairs") - 1).cast("double").alias("df")
    ).withColumn("p", t_two_sided(F.col("t"), F.col("df")))


def with_target_moments(values: DataFrame, target: str) -> DataFrame:
    """Moments of every other method beside those of the target (one scalar subquery)."""
    moments = values.groupBy("method").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var")
    )
    return attach_target(moments.where(F.col("method") != target), values, target)


def attach_target(table: DataFrame, values: DataFrame, target: str) -> DataFrame:
    base = values.where(F.col("method") == target).agg(
        F.struct(
            F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var")
        ).alias("t")
    )
    joined = table.withColumn("__t", base.scalar())
    return joined.select(
        "*",
        F.col("__t.n").alias("n_base"),
        F.col("__t.mean").alias("mean_base"),
        F.col("__t.var").alias("var_base"),
    ).drop("__t")


def welch_t() -> Column:
    spread = F.col("var_base") / F.col("n_base") + F.col("var") / F.col("n")
    return t_statistic(F.col("mean_base") - F.col("mean"), F.sqrt(spread))


def welch_df() -> Column:
    a, b = F.col("var_base") / F.col("n_base"), F.col("var") / F.col("n")
    parts = a * a / (F.col("n_base") - 1) + b * b / (F.col("n") - 1)
    return (a + b) * (a + b) / F.nullif(parts, F.lit(0.0))


def ttest_welch(values: DataFrame, target: str) -> DataFrame:
    """Unpaired t-test with unequal variances of the target against every other method."""
    enough = with_target_moments(values, target).where((F.col("n") >= 2) & (F.col("n_base") >= 2))
    return enough.select("method", welch_t().alias("t"), welch_df().alias("df")).withColumn(
        "p", t_two_sided(F.col("t"), F.coalesce("df", F.lit(1.0)))
    )


def cohens_d_value() -> Column:
    pooled = F.sqrt((F.col("var_base") + F.col("var")) / F.lit(2.0))
    d = (F.col("mean_base") - F.col("mean")) / F.nullif(pooled, F.lit(0.0))
    return F.when(pooled > 0, d).otherwise(F.lit(0.0))


def cohens_d(values: DataFrame, target: str) -> DataFrame:
    enough = with_target_moments(values, target).where((F.col("n") >= 2) & (F.col("n_base") >= 2))
    return enough.select("method", cohens_d_value().alias("cohens_d"))


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """Signed-rank test over matched keys.

    Zero differences are left out; equal magnitudes share their average rank. Up
    to 50 pairs without ties or zeros the p-value is exact, else normal with the
    correction for ties.
    """
    matched = pairs.where(F.col("base").isNotNull()).withColumn("d", F.col("base") - F.col("value"))
    counts = matched.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("d") == 0).alias("zeros")
    )
    ranked = average_ranks(
        matched.where(F.col("d") != 0).withColumn("size", F.abs("d")),
        ["method"],
        "size",
        {"positive": F.count_if(F.col("d") > 0)},
    )
    t = F.col("ties").cast("double")
    sums = ranked.groupBy("method").agg(
        F.sum("ties").alias("n"),
        F.sum(F.col("avg_rank") * F.col("positive")).alias("w_plus"),
        F.sum(F.col("avg_rank") * (F.col("ties") - F.col("positive"))).alias("w_minus"),
        F.sum(t * t * t - t).alias("tie_term"),
    )
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / F.lit(24.0) - F.col("tie_term") / F.lit(48.0)
    z = (F.col("w") - n * (n + 1) / F.lit(4.0)) / F.sqrt(F.nullif(variance, F.lit(0.0)))
    exact = (F.col("n") <= EXACT_UP_TO) & (F.col("zeros") == 0) & (F.col("tie_term") == 0)
    return (
        counts.join(sums, "method", "left")
        .withColumn("w", F.least("w_plus", "w_minus"))
        .withColumn("exact", exact)
        .withColumn("p", F.when(exact, signed_rank_exact(F.col("w"), F.col("n"))).otherwise(normal_two_sided(z)))
        .select("method", "n_pairs", "zeros", "n", "w_plus", "w_minus", "w", "exact", "p")
    )


def holm(table: DataFrame, p: str = "p", family: list[str] | None = None, out: str = "p_holm") -> DataFrame:
    """Step-down correction within each family of tests; missing p-values are not counted.

    A family has one row per compared method, never rows of data.
    """
    family = family or []
    named = table.withColumn("__known", present(F.col(p)))
    scope = Window.partitionBy(*family, "__known")
    rank = F.row_number().over(scope.orderBy(p))
    size = F.count(F.lit(1)).over(scope)
    raised = named.withColumn("__raised", (size - rank + 1) * F.col(p))
    running = F.max("__raised").over(scope.orderBy(p).rowsBetween(Window.unboundedPreceding, 0))
    return raised.withColumn(out, F.when(F.col("__known"), F.least(F.lit(1.0), running))).drop(
        "__known", "__raised"
    )


def compare(values: DataFrame, target: str) -> DataFrame:
    """The target against every other method: difference, t-test, signed ranks, effect size, correction.

    A method whose keys all match the target's is tested in pairs, others by Welch's
    test with no signed-rank p-value. Methods with fewer than two values are skipped.
    """
    pairs = pair_with(values, target)
    moments = attach_target(paired_moments(pairs), values, target).where(
        (F.col("n") >= 2) & (F.col("n_base") >= 2)
    )
    paired = (F.col("n") == F.col("n_base")) & (F.col("n_pairs") == F.col("n"))
    tested = (
        moments.withColumn("paired", paired)
        .withColumn(
            "t",
            F.when(F.col("paired"), t_statistic(F.col("mean_d"), F.col("sd_d") / F.sqrt("n_pairs"))).otherwise(
                welch_t()
            ),
        )
        .withColumn(
            "df", F.when(F.col("paired"), (F.col("n") - 1).cast("double")).otherwise(welch_df())
        )
        .withColumn("p_t", t_two_sided(F.col("t"), F.coalesce("df", F.lit(1.0))))
    )
    ranks = wilcoxon(pairs).select("method", F.col("p").alias("p_rank"))
    table = tested.join(ranks, "method", "left").select(
        F.concat_ws(" vs ", F.lit(target), "method").alias("compare"),
        (F.col("mean_base") - F.col("mean")).alias("mean_diff"),
        "paired",
        "t",
        "p_t",
        F.when(F.col("paired"), F.col("p_rank")).alias("p_wilcoxon"),
        cohens_d_value().alias("cohens_d"),
    )
    return holm(table, "p_t")
