"""How much of one matrix's energy the selection made for another keeps: pairs of matrices of any height, in strips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.operators import projection, strips
from wavemill.operators.matrix import ID
from wavemill.operators.selection import TAU, TINY
from wavemill.session import materialize

PLACES = [c for c in strips.NAMES if c not in (ID, "coef")]


def with_steps(rows: DataFrame) -> DataFrame:
    """``matrix_id, i, row`` with ``grad``: the step from the row before, zero in the first row."""
    before = rows.select(ID, (F.col("i") + 1).alias("i"), F.col("row").alias("before"))
    step = F.zip_with("row", F.coalesce("before", "row"), lambda a, b: a - b)
    return rows.select(ID, "i", "row").join(before, [ID, "i"], "left").select(ID, "i", "row", step.alias("grad"))


def _sides(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of both matrices of every pair, values and gradients, under ids that end in sv, sg, tv or tg; the lower
    matrix of a pair gets a row of zeros at the height of the other, so all four have one shape."""
    named = pairs.select("src", "tgt", F.to_json(F.struct("src", "tgt")).alias("pair"))
    sizes = rows.groupBy(ID).agg((F.max("i") + 1).alias("height"), F.max(F.size("row")).alias("wide"))
    both = named.join(sizes.select(F.col(ID).alias("src"), F.col("height").alias("sm"), F.col("wide").alias("sn")), "src")
    both = both.join(sizes.select(F.col(ID).alias("tgt"), F.col("height").alias("tm"), F.col("wide").alias("tn")), "tgt")
    told = F.raise_error(F.concat(F.lit("matrices of unequal width: "), "pair")).cast("string")
    both = both.withColumn("pair", F.when(F.col("sn") == F.col("tn"), F.col("pair")).otherwise(told))
    ends = [F.struct(F.lit(s).alias("side"), F.col(key).alias(ID), F.col(m).alias("m")) for s, key, m in (("s", "src", "sm"), ("t", "tgt", "tm"))]
    sides = both.select("pair", "sn", F.greatest("sm", "tm").alias("high"), F.inline(F.array(*ends)))
    met = sides.select("pair", "side", ID).join(rows, ID).select("pair", "side", F.col("i").alias("at"), "row", "grad")
    zeros = F.array_repeat(F.lit(0.0), F.col("sn"))
    short = sides.where(F.col("m") < F.col("high")).select("pair", "side", (F.col("high") - 1).alias("at"), zeros.alias("row"), zeros.alias("grad"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("row")) for k, c in (("v", "row"), ("g", "grad"))])
    every = met.unionByName(short).select("pair", "side", "at", F.inline(kinds))
    return every.select(F.concat("pair", "side", "kind").alias(ID), "at", "row")


def _kind() -> Column:
    return F.expr(f"right({ID}, 2)")


def _pair() -> Column:
    return F.expr(f"left({ID}, length({ID}) - 2)")


def _only(kind: str, column: str) -> Column:
    return F.first(F.when(F.col("kind") == kind, F.col(column)), ignorenulls=True)


def transfer_scores(rows: DataFrame, pairs: DataFrame, tau: float = TAU, width: int = strips.WIDTH) -> DataFrame:
    """``src, tgt, baseline, transfer, full``: energy of the target kept by three selections of its coefficients.

    ``rows`` (matrix_id, i from 0 without gaps, row, grad), ``pairs`` (src, tgt). The baseline is selected by the source's
    profile and gradient, transfer by the adapted profile and the target's gradient, full by the target's own. The lower
    matrix of a pair counts as filled up with rows of zeros. Pairs with a matrix that is missing go; matrices of unequal
    width are an error. A task holds ``width`` columns of one matrix.
    """
    wanted = pairs.select(F.explode(F.array("src", "tgt")).alias(ID)).distinct()
    near = materialize(rows.join(wanted, ID, "left_semi"), "transfer-rows")
    segments = materialize(strips.forward(_sides(near, pairs), width, placed=True), "transfer-segments")
    steep = strips.select_largest(segments.where(_kind().isin("sg", "tg")), strips.fraction_count())
    values = segments.where(_kind().isin("sv", "tv"))
    lined = strips.energy_profile(values).withColumns({"kind": _kind(), "pair": _pair()}).groupBy("pair", *PLACES).agg(
        _only("sv", "share").alias("ss"), _only("tv", "share").alias("ts"), _only("tv", "coef").alias("tc")
    )
    lined = materialize(lined.withColumn("xs", F.zip_with("ss", "ts", projection.adapted_share)), "transfer-shares")
    arrays = [F.struct(F.lit(c).alias("kind"), F.col(c).alias("coef")) for c in ("ss", "ts", "xs")]
    shares = lined.select("pair", *PLACES, F.inline(F.array(*arrays))).select(F.concat("pair", "kind").alias(ID), *PLACES, "coef")
    marks = strips.select_weight(shares, tau).unionByName(steep).select(_pair().alias("pair"), _kind().alias("kind"), *PLACES, "keep")
    kept = marks.groupBy("pair", *PLACES).agg(*[_only(k, "keep").alias(k) for k in ("ss", "ts", "xs", "sg", "tg")])
    scored = lined.select("pair", *PLACES, "tc").join(kept, ["pair", *PLACES])
    energy = F.aggregate("tc", F.lit(0.0), lambda acc, c: acc + c * c)

    def inside(share: str, grad: str) -> Column:
        squares = F.zip_with("tc", F.zip_with(share, grad, lambda a, b: a & b), lambda c, k: F.when(k, c * c).otherwise(0.0))
        return F.sum(F.aggregate(squares, F.lit(0.0), lambda acc, c: acc + c))

    sums = scored.groupBy("pair").agg(
        F.sum(energy).alias("energy"), inside("ss", "sg").alias("baseline"), inside("xs", "tg").alias("transfer"), inside("ts", "tg").alias("full")
    )
    parts = [F.nanvl(F.col(c) / (F.col("energy") + F.lit(TINY)), F.lit(0.0)).alias(c) for c in ("baseline", "transfer", "full")]
    names = pairs.select("src", "tgt", F.to_json(F.struct("src", "tgt")).alias("pair"))
    return names.join(sums, "pair").select("src", "tgt", *parts)
