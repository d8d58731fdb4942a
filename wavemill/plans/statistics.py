"""Summaries, intervals and tests over results."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavemill.functions.numeric import tidy
from wavemill.functions.tails import t_two_sided
from wavemill.operators import stats
from wavemill.operators.ranking import average_ranks
from wavemill.plans import inputs
from wavemill.plans import sqlparts as q
from wavemill.plans.registry import query
from wavemill.session import scratch_path
from wavemill.sources import sinks

TARGET = "purchase"
HOURLY_SQL = "user_id * 10000 + dayofmonth(ts) * 100 + hour(ts)"


def by_day():
    return F.dayofmonth("ts").cast("bigint")


def by_user_hour():
    return F.col("user_id") * 10000 + F.dayofmonth("ts") * 100 + F.hour("ts")


def values(spark, sf_dir, seed=None):
    return stats.metric_values(inputs.results(spark, sf_dir, seed), "value")


def rounded(df, *names, places=6):
    return df.withColumns({n: tidy(F.col(n), places) for n in names})


@query(q.with_parts([q.event_results()], f"""SELECT method, count(value) AS n, {q.r('avg(value)')} AS mean,
  {q.r('stddev_samp(value)')} AS std FROM results GROUP BY method"""))
def metric_summary(spark, sf_dir):
    return rounded(stats.summarize(values(spark, sf_dir)), "mean", "std")


POISSON_SQL = [
    q.event_results(),
    f"based AS (SELECT method, value, {q.key_pair(0, 'method', 'seed')} FROM results)",
    *q.scrambled("based", "drawn", "method, value"),
    f"weighed AS (SELECT method, b, value, {q.poisson('x')} AS w FROM drawn)",
    "means AS (SELECT method, b, sum(w * value) / sum(w) AS mean FROM weighed GROUP BY method, b)",
    "ci AS (SELECT method, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high FROM means GROUP BY method)",
]


@query(q.with_parts(POISSON_SQL, f"SELECT method, {q.r('ci_low')} AS ci_low, {q.r('ci_high')} AS ci_high FROM ci"))
def bootstrap_poisson(spark, sf_dir):
    return rounded(stats.bootstrap_poisson(values(spark, sf_dir)), "ci_low", "ci_high")


@query(
    q.with_parts(
        [q.event_results(),
         """ranked AS MATERIALIZED (SELECT method, value, row_number() OVER (PARTITION BY method ORDER BY seed) - 1 AS rk,
  count(*) OVER (PARTITION BY method) AS n FROM results)""",
         f"based AS (SELECT method, n, {q.key_pair(0, 'method', 'rk')} FROM ranked)",
         *q.scrambled("based", "dealt", "method, n"),
         f"counts AS (SELECT method, b, n, floor(x * n / {q.MODULUS}.0::DOUBLE)::BIGINT // 512 AS bucket, count(*) AS draws FROM dealt GROUP BY ALL)",
         "held AS (SELECT method, rk // 512 AS bucket, count(*) AS size FROM ranked GROUP BY ALL)",
         f"local AS (SELECT method, bucket, b, size, draws, {q.key_pair('0:local', 'method', 'bucket', 'b')} FROM counts JOIN held USING (method, bucket))",
         *q.scrambled("local", "drawn", "method, bucket, b, size", "draws", "t"),
         f"picks AS (SELECT method, b, bucket * 512 + floor(x * size / {q.MODULUS}.0::DOUBLE)::BIGINT AS rk FROM drawn)",
         "means AS (SELECT p.method, p.b, avg(r.value) AS mean FROM picks p JOIN ranked r ON r.method = p.method AND r.rk = p.rk GROUP BY ALL)"],
        f"""SELECT method, {q.r('quantile_cont(mean, 0.025)')} AS ci_low, {q.r('quantile_cont(mean, 0.975)')} AS ci_high
FROM means GROUP BY method""",
    )
)
def bootstrap_exact(spark, sf_dir):
    return rounded(stats.bootstrap_exact(values(spark, sf_dir)), "ci_low", "ci_high")


@query(
    q.with_parts(
        POISSON_SQL,
        """SELECT method, printf('%.1f±%.1f', avg(value), stddev_samp(value)) AS mean_std,
  printf('[%.1f, %.1f]', any_value(ci_low), any_value(ci_high)) AS ci FROM results JOIN ci USING (method) GROUP BY method""",
    )
)
def summary_formatted(spark, sf_dir):
    """The summary as table text, written and taken from the written file."""
    path = scratch_path(spark, "summary")
    sinks.write_summary(stats.formatted(stats.summary_with_interval(values(spark, sf_dir))), path)
    lines = spark.read.text(path).where(~F.col("value").startswith("| Method") & ~F.col("value").startswith("|--"))
    cell = F.split(F.col("value"), r"\|")
    return lines.select(
        F.trim(cell[1]).alias("method"), F.trim(cell[2]).alias("mean_std"), F.trim(cell[3]).alias("ci")
    )


def compare_parts(seed: str = "user_id") -> list[str]:
    return [
        q.event_results(seed=seed),
        f"""pairs AS (SELECT o.method, o.seed, o.value, b.value AS base FROM results o
  LEFT JOIN results b ON b.method = '{TARGET}' AND b.seed = o.seed WHERE o.method <> '{TARGET}')""",
        f"""target AS (SELECT count(value) AS n_base, avg(value) AS mean_base, var_samp(value) AS var_base FROM results
  WHERE method = '{TARGET}')""",
        """moments AS (SELECT method, count(value) AS n, count(base) AS n_pairs, avg(value) AS mean, var_samp(value) AS var,
  avg(base - value) AS mean_d, stddev_samp(base - value) AS sd_d, any_value(n_base) AS n_base,
  any_value(mean_base) AS mean_base, any_value(var_base) AS var_base FROM pairs, target GROUP BY method)""",
        """welch AS (SELECT *, (mean_base - mean) / sqrt(var_base / n_base + var / n) AS tw,
  (var_base / n_base + var / n) ** 2 / ((var_base / n_base) ** 2 / (n_base - 1) + (var / n) ** 2 / (n - 1)) AS dfw FROM moments)""",
    ]


def wilcoxon_parts() -> list[str]:
    return [
        "diffs AS (SELECT method, base - value AS d FROM pairs WHERE base IS NOT NULL)",
        """dranks AS (SELECT method, d, rank() OVER (PARTITION BY method ORDER BY abs(d)) +
  (count(*) OVER (PARTITION BY method, abs(d)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY method, abs(d)) AS t FROM diffs WHERE d <> 0)""",
        """wsums AS (SELECT method, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0.0 END)::DOUBLE AS w_plus,
  sum(CASE WHEN d < 0 THEN rk ELSE 0.0 END)::DOUBLE AS w_minus, sum(t * t - 1)::DOUBLE AS tie_term FROM dranks GROUP BY method)""",
        """wcounts AS (SELECT method, count(*) AS n_pairs, count(*) FILTER (d = 0) AS zeros FROM diffs GROUP BY method)""",
        """wstat AS (SELECT *, least(w_plus, w_minus) AS w, n <= 50 AND zeros = 0 AND tie_term = 0 AS exact,
  (least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tie_term / 48.0) AS z
  FROM wcounts JOIN wsums USING (method))""",
        """subsets AS (WITH RECURSIVE grow(n, s, c) AS (SELECT 0, 0, 1.0::DOUBLE
  UNION ALL SELECT n + 1, s + a, sum(c) FROM grow, (SELECT unnest([0, 1]) AS pick), LATERAL (SELECT pick * (n + 1) AS a) WHERE n < 50 GROUP BY n + 1, s + a)
  SELECT n, s, c FROM grow)""",
        f"""wilcox AS (SELECT method, n_pairs, zeros, n, w_plus, w_minus, w, exact, CASE WHEN exact THEN least(1.0,
  2.0 * (SELECT sum(g.c) FROM subsets g WHERE g.n = wstat.n AND g.s <= wstat.w) / pow(2.0, n)) ELSE {q.normal_two_sided('z')} END AS p FROM wstat)""",
    ]


COMPARE_SELECT = f"""SELECT '{TARGET} vs ' || method AS compare, {q.r('mean_diff')} AS mean_diff, paired, {q.r('t')} AS t, {q.r('p_t')} AS p_t,
  {q.r('CASE WHEN paired THEN p END')} AS p_wilcoxon, {q.r('cohens_d')} AS cohens_d,
  {q.r('least(1.0, max(raised) OVER (ORDER BY p_t ROWS UNBOUNDED PRECEDING))')} AS p_holm FROM held"""


def compare_sql(seed: str = "user_id") -> str:
    return q.with_parts(
        [*compare_parts(seed), *wilcoxon_parts(),
         """picked AS (SELECT *, n = n_base AND n_pairs = n AS paired, mean_base - mean AS mean_diff,
  (mean_base - mean) / sqrt((var_base + var) / 2.0) AS cohens_d FROM welch)""",
         """timed AS (SELECT *, CASE WHEN paired THEN mean_d / (sd_d / sqrt(n_pairs)) ELSE tw END AS t,
  CASE WHEN paired THEN (n - 1)::DOUBLE ELSE dfw END AS df FROM picked)""",
         f"tested AS (SELECT *, {q.t_two_sided('t', 'df')} AS p_t FROM timed)",
         """held AS (SELECT tested.*, wilcox.p, (count(*) OVER () - row_number() OVER (ORDER BY p_t) + 1) * p_t AS raised
  FROM tested LEFT JOIN wilcox USING (method))"""],
        COMPARE_SELECT,
    )


COMPARED = ("mean_diff", "t", "p_t", "p_wilcoxon", "cohens_d", "p_holm")


@query(compare_sql())
def compare_methods(spark, sf_dir):
    """Every user has every event type, so the tests are paired."""
    return rounded(stats.compare(values(spark, sf_dir), TARGET), *COMPARED)


@query(compare_sql(HOURLY_SQL))
def compare_methods_unpaired(spark, sf_dir):
    """Keyed by user and hour of the month few keys match, so Welch's test is taken."""
    return rounded(stats.compare(values(spark, sf_dir, by_user_hour()), TARGET), *COMPARED)


@query(compare_sql())
def comparison_csv(spark, sf_dir):
    """The comparison written as CSV with headings and read back."""
    path = scratch_path(spark, "comparison")
    sinks.write_comparison(stats.compare(values(spark, sf_dir), TARGET), path)
    schema = ("compare string, mean_diff double, paired boolean, t double, p_t double, p_wilcoxon double, "
              "cohens_d double, p_holm double")
    return rounded(spark.read.schema(schema).option("header", True).csv(path), *COMPARED)


@query(
    q.with_parts(
        [*compare_parts(),
         "tt AS (SELECT method, n_pairs, mean_d / (sd_d / sqrt(n_pairs)) AS t, (n_pairs - 1)::DOUBLE AS df FROM moments)"],
        f"SELECT method, n_pairs, {q.r('t')} AS t, df, {q.r(q.t_two_sided('t', 'df'))} AS p FROM tt",
    )
)
def ttest_paired(spark, sf_dir):
    pairs = stats.pair_with(values(spark, sf_dir), TARGET)
    return rounded(stats.ttest_paired(pairs), "t", "p")


@query(q.with_parts(compare_parts(HOURLY_SQL),
                    f"SELECT method, {q.r('tw', 5)} AS t, {q.r('dfw', 4)} AS df, {q.r(q.t_two_sided('tw', 'dfw'))} AS p FROM welch"))
def ttest_welch(spark, sf_dir):
    tested = stats.ttest_welch(values(spark, sf_dir, by_user_hour()), TARGET)
    return rounded(rounded(rounded(tested, "t", places=5), "df", places=4), "p")


WILCOXON_SELECT = f"""SELECT method, n_pairs, zeros, CAST(n AS BIGINT) AS n, {q.r('w_plus')} AS w_plus, {q.r('w_minus')} AS w_minus,
  {q.r('w')} AS w, exact, {q.r('p')} AS p FROM wilcox"""


@query(q.with_parts([*compare_parts(), *wilcoxon_parts()], WILCOXON_SELECT))
def wilcoxon(spark, sf_dir):
    """Signed ranks over users."""
    tested = stats.wilcoxon(stats.pair_with(values(spark, sf_dir), TARGET))
    return rounded(tested, "w_plus", "w_minus", "w", "p")


@query(q.with_parts([*compare_parts("dayofmonth(ts)"), *wilcoxon_parts()], WILCOXON_SELECT))
def wilcoxon_exact(spark, sf_dir):
    """Signed ranks over days: at most 31 pairs, so the p-value is counted exactly."""
    tested = stats.wilcoxon(stats.pair_with(values(spark, sf_dir, by_day()), TARGET))
    return rounded(tested, "w_plus", "w_minus", "w", "p")


T_PARTS = [
    "whole AS (SELECT avg(value) AS centre FROM events)",
    """groups AS (SELECT event_type, dayofweek(ts)::INTEGER AS weekday, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd
  FROM events GROUP BY ALL)""",
    "ts AS (SELECT event_type, weekday, (mean - centre) / (sd / sqrt(n)) AS t, (n - 1)::DOUBLE AS df FROM groups, whole)",
    f"tails AS MATERIALIZED (SELECT event_type, weekday, t, df, {q.t_two_sided('t', 'df')} AS p FROM ts)",
]


def group_tails(spark, sf_dir):
    """Each event type and weekday against the overall mean."""
    events = inputs.table(spark, sf_dir, "events")
    centre = events.agg(F.avg("value")).scalar()
    groups = events.groupBy("event_type", (F.dayofweek("ts") - 1).alias("weekday")).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")
    )
    t = stats.t_statistic(F.col("mean") - centre, F.col("sd") / F.sqrt("n"))
    tested = groups.select("event_type", "weekday", t.alias("t"), (F.col("n") - 1).cast("double").alias("df"))
    return tested.withColumn("p", t_two_sided(F.col("t"), F.col("df")))


@query(q.with_parts(T_PARTS, f"SELECT event_type, weekday, {q.r('t')} AS t, df, {q.r('p')} AS p FROM tails"))
def t_tail(spark, sf_dir):
    return rounded(group_tails(spark, sf_dir), "t", "p")


@query(q.with_parts([*compare_parts()],
                    f"SELECT method, {q.r('(mean_base - mean) / sqrt((var_base + var) / 2.0)')} AS cohens_d FROM moments"))
def cohens_d(spark, sf_dir):
    return rounded(stats.cohens_d(values(spark, sf_dir), TARGET), "cohens_d")


@query(
    q.with_parts(
        [*T_PARTS,
         """raised AS (SELECT *, (count(*) OVER (PARTITION BY event_type) - row_number() OVER (PARTITION BY event_type ORDER BY p) + 1) * p AS up
  FROM tails)"""],
        f"""SELECT event_type, weekday, {q.r('p')} AS p,
  {q.r('least(1.0, max(up) OVER (PARTITION BY event_type ORDER BY p ROWS UNBOUNDED PRECEDING))')} AS p_holm FROM raised""",
    )
)
def holm(spark, sf_dir):
    """Correction within each event type's seven tests."""
    held = stats.holm(group_tails(spark, sf_dir), "p", ["event_type"])
    return rounded(held.select("event_type", "weekday", "p", "p_holm"), "p", "p_holm")


@query(
    """SELECT event_type, value, count(*) AS ties, any_value(rk) + (count(*) - 1) / 2.0 AS avg_rank FROM (
  SELECT event_type, value, rank() OVER (PARTITION BY event_type ORDER BY value) AS rk FROM events) GROUP BY event_type, value"""
)
def avg_rank(spark, sf_dir):
    ranked = average_ranks(inputs.table(spark, sf_dir, "events"), ["event_type"], "value")
    return ranked.select("event_type", "value", "ties", "avg_rank")
