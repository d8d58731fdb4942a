"""Clipped, noised and outlier-resistant aggregation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wavemill.functions.numeric import tidy
from wavemill.operators import privacy
from wavemill.plans import inputs
from wavemill.plans import sqlparts as q
from wavemill.plans.registry import query
from wavemill.plans.statistics import rounded

BOUND = 700.0
UPDATE_BOUND = 85.0
TOLERANCE = 2.4
SECRET, RELEASE = "demonstration", "1"
NOISE = f"{SECRET}:{RELEASE}"

UPDATES = "updates AS MATERIALIZED (SELECT user_id AS party, event_type AS coord, sum(value) AS v FROM events GROUP BY ALL)"
CLIPPED = f"""clipped AS MATERIALIZED (SELECT party, coord, v * CASE WHEN norm > {BOUND} THEN {BOUND} / norm ELSE 1.0 END AS clipped
  FROM updates JOIN (SELECT party, sqrt(sum(v * v)) AS norm FROM updates GROUP BY party) USING (party))"""
SCALE = f"({BOUND} * sqrt(2.0 * ln(1.5 / 1e-5::DOUBLE)) / 3.0)"


@query(q.with_parts([UPDATES, CLIPPED], f"SELECT party, coord, {q.r('clipped', 5)} AS clipped FROM clipped"))
def dp_clip(spark, sf_dir):
    clipped = privacy.clip_contributors(inputs.user_updates(spark, sf_dir), bound=BOUND)
    return rounded(clipped.select("party", "coord", "clipped"), "clipped", places=5)


DAYS = "days AS (SELECT user_id, count(DISTINCT dayofmonth(ts)) AS days FROM events GROUP BY user_id)"


@query(q.with_parts([DAYS], f"""SELECT user_id, {q.r('sqrt(2.0 * ln(1.5 / 1e-5::DOUBLE)) / greatest(3.0 / days, 1e-6::DOUBLE)')} AS sigma,
  {q.r('sqrt(2.0 * ln(1.25 / 1e-5::DOUBLE)) / greatest(3.0 / days, 1e-6::DOUBLE)')} AS textbook FROM days"""))
def dp_sigma(spark, sf_dir):
    """Noise scale if a user's budget is spread evenly over the days they were active."""
    days = inputs.table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_distinct(F.dayofmonth("ts")).alias("days")
    )
    step = F.lit(privacy.EPSILON) / F.col("days")
    return days.select(
        "user_id",
        tidy(privacy.sigma(1.0, step)).alias("sigma"),
        tidy(privacy.sigma(1.0, step, constant=privacy.TEXTBOOK_CONSTANT)).alias("textbook"),
    )


@query(
    q.with_parts(
        ["rounds AS (SELECT event_type, dayofmonth(ts) - 1 AS t FROM events GROUP BY ALL)",
         "sized AS (SELECT *, max(t) OVER (PARTITION BY event_type) + 1 AS total FROM rounds)",
         "steps AS (SELECT *, 3.0::DOUBLE / (total - t + 1) AS epsilon FROM sized)",
         "spends AS (SELECT *, sum(epsilon) OVER (PARTITION BY event_type ORDER BY t ROWS UNBOUNDED PRECEDING) AS spent FROM steps)"],
        f"""SELECT event_type, t::INTEGER AS t, total::INTEGER AS total, {q.r('epsilon')} AS epsilon,
  {q.r('sqrt(2.0 * ln(1.5 / 1e-5::DOUBLE)) / epsilon')} AS sigma, {q.r('spent')} AS spent, spent > 3.0 * (1.0 + 1e-9::DOUBLE) AS overspent FROM spends""",
    )
)
def dp_ledger(spark, sf_dir):
    """One round per day of the month with events, one ledger per event type."""
    rounds = inputs.table(spark, sf_dir, "events").select(
        "event_type", (F.dayofmonth("ts") - 1).alias("t")
    ).distinct()
    sized = rounds.withColumn("total", F.max("t").over(Window.partitionBy("event_type")) + 1)
    return rounded(privacy.ledger(sized, ["event_type"]), "epsilon", "sigma", "spent")


@query(
    q.with_parts(
        [UPDATES, CLIPPED, "sums AS (SELECT coord, sum(clipped) AS total FROM clipped GROUP BY coord)"],
        f"SELECT coord, {q.r('total', 4)} AS total, {q.r(f'total + {SCALE} * ' + q.gaussian(NOISE, 'coord'), 4)} AS released FROM sums",
    )
)
def dp_release(spark, sf_dir):
    """Noised sums per event type over clipped users."""
    released = privacy.release_sums(inputs.user_updates(spark, sf_dir), SECRET, RELEASE, bound=BOUND)
    return rounded(released.select("coord", "total", "released"), "total", "released", places=4)


PARTIES = """parties AS MATERIALIZED (SELECT l_suppkey AS party, month(l_shipdate)::INTEGER AS coord, avg(l_quantity) AS v
  FROM lineitem GROUP BY ALL)"""


@query()
def dp_release_discrete(spark, sf_dir):
    """The same sums with exact draws from the discrete Gaussian."""
    released = privacy.release_sums(inputs.user_updates(spark, sf_dir), SECRET, RELEASE, bound=BOUND, discrete=True)
    return rounded(released.select("coord", "total", "released"), "total", "released", places=4)


@query(q.with_parts([PARTIES], f"SELECT coord, {q.r('median(v)')} AS median FROM parties GROUP BY coord"))
def robust_median(spark, sf_dir):
    return rounded(privacy.robust_median(inputs.supplier_updates(spark, sf_dir)), "median")


@query(
    q.with_parts(
        ["""flagged AS MATERIALIZED (SELECT l_returnflag AS flag, l_suppkey AS party, month(l_shipdate)::INTEGER AS coord, avg(l_quantity) AS v
  FROM lineitem GROUP BY ALL)""",
         "medians AS (SELECT flag, coord, median(v) AS median FROM flagged GROUP BY ALL)",
         "nodes AS (SELECT count(DISTINCT l_suppkey) AS n, (count(DISTINCT l_suppkey) - 1) // 3 AS f FROM lineitem)",
         "devs AS (SELECT flag, party, avg(abs(v - median)) AS deviation FROM flagged JOIN medians USING (flag, coord) GROUP BY ALL)",
         f"counts AS (SELECT flag, count(*) AS parties, count(*) FILTER (deviation < {TOLERANCE}) AS agreeing FROM devs GROUP BY flag)"],
        """SELECT flag, parties, agreeing, n >= 3 * f + 1 AS valid, parties >= 2 * f + 1 AS quorum,
  agreeing / parties >= (2 * f + 1) / n AS agreed FROM counts, nodes""",
    )
)
def robust_agreement(spark, sf_dir):
    """Do enough suppliers lie near the median, for each return flag?"""
    updates = inputs.supplier_updates(spark, sf_dir, F.col("l_returnflag").alias("flag"))
    medians = privacy.robust_median(updates, by=("flag", "coord"))
    nodes = inputs.table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_suppkey")).scalar()
    faulty = F.floor((nodes - 1) / 3)
    return privacy.agreement(updates, medians, nodes, faulty, TOLERANCE, by=("flag",))


@query(
    q.with_parts(
        [PARTIES,
         f"""held AS MATERIALIZED (SELECT party, coord, v * CASE WHEN norm > {UPDATE_BOUND} THEN {UPDATE_BOUND} / norm ELSE 1.0 END AS v
  FROM parties JOIN (SELECT party, sqrt(sum(v * v)) AS norm FROM parties GROUP BY party) USING (party))""",
         "medians AS (SELECT coord, median(v) AS median FROM held GROUP BY coord)",
         "original AS (SELECT month(l_shipdate)::INTEGER AS coord, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL)"],
        f"""SELECT coord, {q.r('median')} AS median,
  {q.r(f'v + median + ({UPDATE_BOUND} * sqrt(2.0 * ln(1.5 / 1e-5::DOUBLE)) / 3.0) * ' + q.gaussian(NOISE, 'coord'), 4)} AS updated
FROM original JOIN medians USING (coord)""",
    )
)
def private_update(spark, sf_dir):
    """Mean price per month moved by the noised median of the suppliers' clipped quantities."""
    original = inputs.table(spark, sf_dir, "lineitem").groupBy(F.month("l_shipdate").alias("coord")).agg(
        F.avg("l_extendedprice").alias("v")
    )
    done = privacy.private_update(original, inputs.supplier_updates(spark, sf_dir), SECRET, RELEASE, bound=UPDATE_BOUND)
    return done.select("coord", tidy(F.col("median")).alias("median"), tidy(F.col("updated"), 4).alias("updated"))
