"""Clipped, noised and outlier-resistant aggregation over contributors.

``updates``: party, coord, v. Noise is added once, to the aggregate.
"""

from __future__ import annotations

import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavemill.functions.discrete import bit_stream, discrete_gaussian
from wavemill.functions.hashing import gaussian
from wavemill.operators.ranking import group_median

# Fixed values of the mechanism.
EPSILON = 3.0
DELTA = 1e-5
NOISE_CONSTANT = 1.5
TEXTBOOK_CONSTANT = 1.25
EPSILON_FLOOR = 1e-6
CLIP = 1.0
TOLERANCE = 1e-2

GRID_BITS = 20


def clip_contributors(updates: DataFrame, party: str = "party", v: str = "v", bound: float = CLIP) -> DataFrame:
    """Scale each contributor's vector to an L2 norm of at most ``bound``."""
    norms = updates.groupBy(party).agg(F.sqrt(F.sum(F.col(v) * F.col(v))).alias("norm"))
    factor = F.when(F.col("norm") > F.lit(float(bound)), F.lit(float(bound)) / F.col("norm")).otherwise(
        F.lit(1.0)
    )
    return updates.join(norms, party).withColumn("clipped", F.col(v) * factor)


def sigma(bound: float, epsilon: Column, delta: float = DELTA, constant: float = NOISE_CONSTANT) -> Column:
    """Scale of Gaussian noise for a budget; the textbook mechanism has 1.25 for ``constant``."""
    scale = float(bound) * math.sqrt(2.0 * math.log(constant / delta))
    return F.lit(scale) / F.greatest(epsilon, F.lit(EPSILON_FLOOR))


def budget_step(t: Column, total: Column, epsilon: float = EPSILON) -> Column:
    """Budget of round t (from 0) of ``total``."""
    return F.lit(float(epsilon)) / (total - t + F.lit(1))


def ledger(rounds: DataFrame, by: list[str], epsilon: float = EPSILON, bound: float = CLIP) -> DataFrame:
    """Budget, noise scale and running spend of each round; flags rounds that exceed the total."""
    so_far = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    stepped = rounds.withColumn("epsilon", budget_step(F.col("t"), F.col("total"), epsilon))
    return (
        stepped.withColumn("sigma", sigma(bound, F.col("epsilon")))
        .withColumn("spent", F.sum("epsilon").over(so_far))
        .withColumn("overspent", F.col("spent") > F.lit(float(epsilon) * (1.0 + 1e-9)))
    )


def add_noise(aggregate: DataFrame, key: list[str], v: str, scale: Column, secret: str, release: str, out: str) -> DataFrame:
    """Add Gaussian noise that depends on the secret, the release and the key alone.

    A rerun of a release gives the same value; another release has noise of its own, so two
    releases do not subtract to the exact difference.
    """
    return aggregate.withColumn(out, F.col(v) + scale * gaussian(f"{secret}:{release}", *[F.col(k) for k in key]))


def add_discrete_noise(
    aggregate: DataFrame, key: list[str], v: str, scale: Column, secret: str, release: str, out: str
) -> DataFrame:
    """``add_noise`` by exact draws from the discrete Gaussian, on a grid of about a millionth of the scale.

    The grid's step is a power of two, 2**-GRID_BITS of the scale or less by a factor below two; the value is
    rounded to it and the scale rounded up to whole steps. So the result tells nothing by its
    last bits and the tail has no end, which a sum of rounded logarithms cannot give. Rounding moves a
    value by half a step; over d coordinates that adds a step times the root of d to the sensitivity.
    NULL and non-finite values or scales, and scales of 0 or less, give NULL. Rows are one a coordinate, after the aggregation.
    """
    named = F.concat_ws(
        ":", F.lit(release), *[F.coalesce(F.length(F.col(k).cast("string")), F.lit(-1)) for k in key], *[F.col(k).cast("string") for k in key]
    )
    asked = aggregate.withColumns({"__name": named, "__v": F.col(v).cast("double"), "__scale": scale.cast("double")})
    kept = [c for c in aggregate.columns if c != out]
    schema = T.StructType([*(f for f in aggregate.schema.fields if f.name != out), T.StructField(out, T.DoubleType())])

    def noised(name: str, value: float | None, wide: float | None) -> float | None:
        if value is None or wide is None or not (math.isfinite(value) and math.isfinite(wide) and wide > 0):
            return None
        exponent = math.frexp(wide)[1] - 1 - GRID_BITS
        units = math.ceil(math.ldexp(wide, -exponent))
        drawn = discrete_gaussian(bit_stream(secret, name), units)
        return float(Fraction(2) ** exponent * (round(Fraction(value) / Fraction(2) ** exponent) + drawn))

    def run(batches):
        for batch in batches:
            asked_ = (batch.column(c).to_pylist() for c in ("__name", "__v", "__scale"))
            column = pa.array([noised(*x) for x in zip(*asked_)], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), column], [*kept, out])

    return asked.mapInArrow(run, schema)


def release_sums(
    updates: DataFrame, secret: str, release: str, epsilon: float = EPSILON, bound: float = CLIP, discrete: bool = False
) -> DataFrame:
    """Noised sum per coordinate over clipped contributors; ``discrete`` draws exactly, on a grid."""
    sums = clip_contributors(updates, bound=bound).groupBy("coord").agg(F.sum("clipped").alias("total"))
    noise = add_discrete_noise if discrete else add_noise
    return noise(sums, ["coord"], "total", sigma(bound, F.lit(float(epsilon))), secret, release, "released")


def robust_median(updates: DataFrame, v: str = "v", by=("coord",)) -> DataFrame:
    """Exact coordinate-wise median over parties."""
    return group_median(updates, list(by), v, "median")


def agreement(
    updates: DataFrame, medians: DataFrame, nodes: Column | int, faulty: Column | int,
    tolerance: float = TOLERANCE, by=(),
) -> DataFrame:
    """Whether enough parties sent updates, and enough of them lie close to the median.

    ``nodes`` is the configured number of parties, of which up to ``faulty`` may be
    wrong; 2*faulty+1 must agree. Valid only if nodes >= 3*faulty+1.
    """
    nodes = F.lit(nodes) if isinstance(nodes, int) else nodes
    faulty = F.lit(faulty) if isinstance(faulty, int) else faulty
    by = list(by)
    joined = updates.join(medians, [*by, "coord"])
    parties = joined.groupBy(*by, "party").agg(F.avg(F.abs(F.col("v") - F.col("median"))).alias("deviation"))
    counted = parties.groupBy(*by).agg(
        F.count(F.lit(1)).alias("parties"),
        F.count_if(F.col("deviation") < F.lit(tolerance)).alias("agreeing"),
    )
    needed = F.lit(2) * faulty + F.lit(1)
    share = F.col("agreeing") / F.nullif("parties", F.lit(0))
    return counted.select(
        *by,
        "parties",
        "agreeing",
        (nodes >= F.lit(3) * faulty + F.lit(1)).alias("valid"),
        (F.col("parties") >= needed).alias("quorum"),
        F.coalesce(share >= needed / nodes, F.lit(False)).alias("agreed"),
    )


def require_agreement(report: DataFrame) -> DataFrame:
    """Raise on the executors if a report row lacks a valid set-up, a quorum or agreement."""
    fine = F.col("valid") & F.col("quorum") & F.col("agreed")
    return report.withColumn(
        "passed", F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit("parties do not agree")).cast("boolean"))
    )


def private_update(
    original: DataFrame, updates: DataFrame, secret: str, release: str, epsilon: float = EPSILON, bound: float = CLIP
) -> DataFrame:
    """Add the noised median of clipped updates to a vector (coord, v).

    Clip, take the median, add noise once. Coordinates without updates stay as they are.
    """
    clipped = clip_contributors(updates, bound=bound).select("party", "coord", F.col("clipped").alias("v"))
    medians = robust_median(clipped)
    noised = add_noise(medians, ["coord"], "median", sigma(bound, F.lit(float(epsilon))), secret, release, "noised")
    return original.join(noised, "coord", "left").withColumn(
        "updated", F.col("v") + F.coalesce("noised", F.lit(0.0))
    )
