"""Matrices, transforms, selections and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.functions.numeric import tidy
from wavemill.operators import columns, factor, projection, runs, score, selection, strips, tiles
from wavemill.operators.matrix import ID, cells, crop, dense_from_cells, tile, weighted_sum
from wavemill.operators.transform import coefficients, dct2d, dct2d_rows, dct_axis, idct2d
from wavemill.plans import inputs
from wavemill.plans import sqlparts as q
from wavemill.plans.registry import query
from wavemill.session import materialize

TAU = 0.85
LOW_TAU = 0.5
TENSOR_TAU = 0.9999
R_LAYERS, R_HEADS = 8, 3


def _cells_out(table: DataFrame, places: int, v: str = "v") -> DataFrame:
    return table.select(ID, "i", "j", tidy(F.col(v), places).alias("v"))


def _cells_sql(parts: list[str], places: int, source: str = "cells", v: str = "v") -> str:
    return q.with_parts(parts, f"SELECT matrix_id, i, j, {q.r(v, places)} AS v FROM {source}")


def supplier_profile(spark, sf_dir) -> DataFrame:
    """Records with coefficients, those of the gradient (gcoef), share and the original (vals)."""
    dense = dct2d(inputs.supplier_months(spark, sf_dir), coef="vals", gcoef="grad").drop("grad")
    return selection.energy_profile(dense)


SUPPLIER_SQL = [
    *q.supplier_cells(),
    *q.forward("cells", "raw", {"c": "v", "g": "g"}),
    q.profile("raw", "prof"),
]
EMBEDDING_SQL = [*q.embedding_cells(), *q.forward("cells", "raw"), q.profile("raw", "prof")]
BOTH_SQL = [
    q.energy("prof", "by_energy", TAU, keep="ke"),
    q.largest("by_energy", "twice", q.quarter(), "g", keep="kg"),
]


@query(
    q.with_parts(
        [*EMBEDDING_SQL, q.energy("prof", "sel", TAU)],
        f"""SELECT split_part(matrix_id, '/', 1)::INTEGER AS label, count(*) AS total,
  CAST(sum(keep::INTEGER) AS BIGINT) AS kept,
  {q.r("sum(CASE WHEN keep THEN c * c ELSE 0.0 END) / (sum(c * c) + 1e-12::DOUBLE)")} AS retained,
  {q.r(q.ratio("keep"))} AS ratio FROM sel GROUP BY 1""",
    )
)
def energy_by_label(spark, sf_dir) -> DataFrame:
    """How many coefficients hold 85% of the energy of each label's vectors?"""
    segments = strips.written_segments(inputs.embedding_keyed(spark, sf_dir))
    scored = strips.retained(strips.select_energy(segments, TAU))
    share = F.col("kept") / F.col("total")
    return scored.select(
        F.split_part(F.col(ID), F.lit("/"), F.lit(1)).cast("int").alias("label"),
        "total",
        "kept",
        tidy(F.col("retained")).alias("retained"),
        tidy(F.lit(1.0) / F.greatest(share, F.lit(score.KEEP_FLOOR))).alias("ratio"),
    )


@query(_cells_sql(q.embedding_cells(), 6))
def matrix_embeddings(spark, sf_dir):
    rows = inputs.embedding_rows(spark, sf_dir)
    return _cells_out(rows.select(ID, F.col("i").cast("int").alias("i"), F.posexplode("row").alias("j", "v")), 6)


@query(_cells_sql(q.user_cells(), 4))
def matrix_user_hours(spark, sf_dir):
    return _cells_out(cells(inputs.user_hours(spark, sf_dir), v="vals"), 4)


@query(_cells_sql(q.supplier_cells(), 4))
def matrix_supplier_months(spark, sf_dir):
    return _cells_out(cells(inputs.supplier_months(spark, sf_dir), v="vals"), 4)


@query(
    q.with_parts(
        q.user_cells(),
        "SELECT matrix_id, 5 AS n_rows, 12 AS n_cols, i, j, round(v, 4) + 0.0 AS v FROM cells WHERE i < 5 AND j < 12",
    )
)
def crop_block(spark, sf_dir):
    block = crop(cells(inputs.user_hours(spark, sf_dir), v="vals"), 5, 12)
    return block.select(ID, "n_rows", "n_cols", "i", "j", tidy(F.col("v"), 4).alias("v"))


@query(
    q.with_parts(
        q.user_cells(),
        """SELECT matrix_id || '/' || (i // 4)::VARCHAR || '/' || (j // 10)::VARCHAR AS matrix_id,
  least(4, 7 - (i // 4) * 4)::INTEGER AS n_rows, least(10, 24 - (j // 10) * 10)::INTEGER AS n_cols,
  (i % 4)::INTEGER AS i, (j % 10)::INTEGER AS j, round(v, 4) + 0.0 AS v FROM cells""",
    )
)
def tile_blocks(spark, sf_dir):
    blocks = tile(cells(inputs.user_hours(spark, sf_dir), v="vals"), 4, 10)
    return blocks.select(ID, "n_rows", "n_cols", "i", "j", tidy(F.col("v"), 4).alias("v"))


@query(q.with_parts([*q.embedding_cells(), *q.forward("cells", "raw")],
                    f"SELECT matrix_id, k, l, {q.r('c')} AS c FROM raw"))
def dct2d_coef(spark, sf_dir):
    coef = strips.coefficient_cells(strips.forward(inputs.embedding_keyed(spark, sf_dir)))
    return coef.select(ID, "k", "l", tidy(F.col("c")).alias("c"))


@query(q.with_parts([*q.embedding_cells(), *q.forward("cells", "raw")],
                    f"SELECT matrix_id, k, l, {q.r('c')} AS c FROM raw"))
def dct2d_by_strips(spark, sf_dir):
    """The transform that spreads one matrix over several tasks."""
    return dct2d_rows(inputs.embedding_rows(spark, sf_dir), width=16).select(ID, "k", "l", tidy(F.col("c")).alias("c"))


@query(_cells_sql(q.embedding_cells(), 4))
def strip_roundtrip(spark, sf_dir):
    """Transform and inverse of matrices of any height, strip by strip: the vectors come back."""
    rows = strips.inverse(strips.forward(inputs.embedding_keyed(spark, sf_dir)))
    back = rows.select(ID, F.col("i").cast("int").alias("i"), F.posexplode("row").alias("j", "v"))
    return back.select(ID, "i", "j", tidy(F.col("v"), 4).alias("v"))


@query(q.with_parts([*q.embedding_cells(), *q.forward("cells", "raw")],
                    f"SELECT matrix_id, k, l, {q.r('c')} AS c FROM raw"))
def dct2d_by_factors(spark, sf_dir):
    """The transform for columns of any length: no task sees a whole column."""
    coef = strips.coefficient_cells(columns.forward(inputs.embedding_rows(spark, sf_dir)))
    return coef.select(ID, "k", "l", tidy(F.col("c")).alias("c"))


@query(_cells_sql(q.embedding_cells(), 4))
def factors_roundtrip(spark, sf_dir):
    """There and back in parts of columns."""
    rows = columns.inverse(columns.forward(inputs.embedding_rows(spark, sf_dir)))
    back = rows.select(ID, F.col("i").cast("int").alias("i"), F.posexplode("row").alias("j", "v"))
    return back.select(ID, "i", "j", tidy(F.col("v"), 4).alias("v"))


@query(
    q.with_parts(
        [*q.embedding_cells(), *q.forward("cells", "raw"), q.largest("raw", "sel", q.quarter(), "c", keep="keep")],
        "SELECT matrix_id, k, l FROM sel WHERE keep",
    )
)
def strip_largest(spark, sf_dir):
    """The quarter of largest coefficients of matrices of any height."""
    segments = strips.written_segments(inputs.embedding_keyed(spark, sf_dir))
    marked = strips.select_largest(segments, strips.fraction_count())
    return strips.coefficient_cells(marked, keep="keep").where("keep").select(ID, "k", "l")


@query(_cells_sql([*q.user_cells(), *q.forward("cells", "raw"), *q.inverse("raw", "back", {"v": "x.c"})], 4, "back"))
def dct_roundtrip(spark, sf_dir):
    return _cells_out(cells(idct2d(dct2d(inputs.user_hours(spark, sf_dir))), v="vals"), 4)


@query(q.with_parts([*q.tensor_cells(), q.axis("tensor", "by_layer", "layer", 31), q.axis("by_layer", "by_head", "head", 5)],
                    """SELECT 'layer' AS axis, layer::INTEGER AS layer, head::INTEGER AS head, i::INTEGER AS i, j::INTEGER AS j,
  round(v, 4) + 0.0 AS v FROM by_layer
UNION ALL SELECT 'layer,head', layer::INTEGER, head::INTEGER, i::INTEGER, j::INTEGER, round(v, 4) + 0.0 FROM by_head"""), "dct_axis")
def dct_axis_tensor(spark, sf_dir):
    by_layer = dct_axis(inputs.event_tensor(spark, sf_dir), "layer", size=31)
    both = by_layer.withColumn("axis", F.lit("layer")).unionByName(
        dct_axis(by_layer, "head", size=len(inputs.EVENT_TYPES)).withColumn("axis", F.lit("layer,head"))
    )
    return both.select("axis", "layer", "head", "i", "j", tidy(F.col("v"), 4).alias("v"))


@query(q.with_parts(EMBEDDING_SQL, f"SELECT matrix_id, k, l, {q.r('share', 10)} AS share FROM prof"))
def energy_profile(spark, sf_dir):
    segments = strips.written_segments(inputs.embedding_keyed(spark, sf_dir))
    profile = strips.coefficient_cells(strips.energy_profile(segments), share="share")
    return profile.select(ID, "k", "l", tidy(F.col("share"), 10).alias("share"))


@query(q.with_parts([*EMBEDDING_SQL, q.energy("prof", "sel", TAU)], "SELECT matrix_id, k, l FROM sel WHERE keep"))
def select_energy(spark, sf_dir):
    segments = strips.written_segments(inputs.embedding_keyed(spark, sf_dir))
    marked = strips.select_energy(segments, TAU)
    return strips.coefficient_cells(marked, keep="keep").where("keep").select(ID, "k", "l")


@query(
    q.with_parts(
        [*q.user_cells(), *q.forward("cells", "raw"), q.profile("raw", "prof"), q.energy("prof", "sel", TAU)],
        "SELECT matrix_id, count(*) AS total, CAST(sum(keep::INTEGER) AS BIGINT) AS kept FROM sel GROUP BY matrix_id",
    )
)
def select_energy_users(spark, sf_dir):
    """Many small matrices: kept coefficients per user."""
    profile = selection.energy_profile(dct2d(inputs.user_hours(spark, sf_dir)))
    kept = coefficients(selection.select_energy(profile, TAU), keep="keep")
    return kept.groupBy(ID).agg(
        F.count(F.lit(1)).alias("total"), score.kept_count(F.col("keep")).alias("kept")
    )


@query(q.with_parts([*EMBEDDING_SQL, q.energy("prof", "sel", TAU)], "SELECT matrix_id, k, l FROM sel WHERE keep"))
def select_energy_cells(spark, sf_dir):
    """Transform and selection without records, for matrices of any size, over a written profile."""
    coef = dct2d_rows(inputs.embedding_rows(spark, sf_dir))
    profile = materialize(selection.cell_profile(coef).select(ID, "k", "l", "share"), "profile")
    return selection.select_energy_cells(profile, TAU).where("keep").select(ID, "k", "l")


@query(q.with_parts([*SUPPLIER_SQL, *BOTH_SQL], "SELECT matrix_id, k, l FROM twice WHERE kg"))
def select_gradient_cells(spark, sf_dir):
    dense = dct2d(inputs.supplier_months(spark, sf_dir).drop("vals"), gcoef="grad")
    coef = materialize(coefficients(dense, g="gcoef").select(ID, "k", "l", "g"), "gradient")
    return selection.select_gradient_cells(coef).where("keep").select(ID, "k", "l")


@query(q.with_parts([*SUPPLIER_SQL, *BOTH_SQL], "SELECT matrix_id, k, l FROM twice WHERE kg"))
def select_gradient(spark, sf_dir):
    return selection.positions(selection.select(supplier_profile(spark, sf_dir), "gradient"))


@query()
def select_cluster(spark, sf_dir):
    dense = inputs.supplier_months(spark, sf_dir)
    return selection.positions(selection.select_cluster(dct2d(dense), shapes=dense))


@query(
    q.with_parts(
        [*SUPPLIER_SQL, *BOTH_SQL],
        "SELECT matrix_id, k, l, 'and' AS combine FROM twice WHERE ke AND kg "
        "UNION ALL SELECT matrix_id, k, l, 'or' FROM twice WHERE ke OR kg",
    )
)
def select_energy_gradient(spark, sf_dir):
    profile = supplier_profile(spark, sf_dir)
    picked = selection.select(profile, "energy+gradient", "and", TAU, out="both")
    picked = selection.select(picked, "energy+gradient", "or", TAU, out="any")
    picked = cells(picked, at=("k", "l"), both="both", any="any")
    ways = F.array(F.when(F.col("both"), F.lit("and")), F.when(F.col("any"), F.lit("or")))
    return picked.select(ID, "k", "l", F.explode(F.array_compact(ways)).alias("combine"))


@query()
def select_cluster_gradient(spark, sf_dir):
    shapes = inputs.supplier_months(spark, sf_dir)
    return selection.positions(selection.select(supplier_profile(spark, sf_dir), "clustering+gradient", shapes=shapes))


def _two_masks(spark, sf_dir):
    profile = supplier_profile(spark, sf_dir)
    by_energy = selection.positions(selection.select(profile, "energy", tau=TAU))
    by_gradient = selection.positions(selection.select(profile, "gradient"))
    return by_energy, by_gradient


@query(q.with_parts([*SUPPLIER_SQL, *BOTH_SQL], "SELECT matrix_id, k, l FROM twice WHERE ke AND kg"))
def mask_and(spark, sf_dir):
    return selection.mask_and(*_two_masks(spark, sf_dir))


@query(q.with_parts([*SUPPLIER_SQL, *BOTH_SQL], "SELECT matrix_id, k, l FROM twice WHERE ke OR kg"))
def mask_or(spark, sf_dir):
    return selection.mask_or(*_two_masks(spark, sf_dir))


@query(q.with_parts([*SUPPLIER_SQL, *BOTH_SQL], "SELECT matrix_id, k, l FROM twice WHERE ke AND NOT kg"))
def mask_andnot(spark, sf_dir):
    return selection.mask_and_not(*_two_masks(spark, sf_dir))


@query(
    _cells_sql(
        [*EMBEDDING_SQL, q.energy("prof", "sel", TAU),
         *q.inverse("sel", "back", {"v": "CASE WHEN x.keep THEN x.c ELSE 0.0 END"})], 6, "back")
)
def spectral_project(spark, sf_dir):
    keyed = inputs.embedding_keyed(spark, sf_dir)
    projected = strips.inverse(strips.keep_only(strips.select_energy(strips.written_segments(keyed), TAU)))
    return _cells_out(projected.select(ID, F.col("i").cast("int").alias("i"), F.posexplode("row").alias("j", "v")), 6)


BLEND_JOIN = "JOIN prof s ON s.matrix_id = b.matrix_id AND s.k = b.i AND s.l = b.j JOIN cells o ON o.matrix_id = b.matrix_id AND o.i = b.i AND o.j = b.j"


@query(
    q.with_parts(
        [*SUPPLIER_SQL, *BOTH_SQL,
         *q.inverse("twice", "back", {"p": "CASE WHEN x.ke AND x.kg THEN x.c ELSE 0.0 END",
                                     "d": "CASE WHEN x.ke AND x.kg THEN x.c + 0.01 * x.g ELSE 0.0 END"})],
        f"""SELECT b.matrix_id, b.i, b.j, {q.r('b.p * s.share + o.v * (1.0 - s.share)', 4)} AS plain,
  {q.r('b.d * s.share + o.v * (1.0 - s.share)', 4)} AS with_delta FROM back b {BLEND_JOIN}""",
    )
)
def spectral_blend(spark, sf_dir):
    """Blend without and with a delta (a hundredth of the gradient)."""
    dense = weighted_sum(inputs.supplier_months(spark, sf_dir), "vals", "grad", 1.0, 0.01, "moved")
    dense = dct2d(dense, coef="vals", gcoef="grad", mcoef="moved").drop("grad", "moved")
    kept = selection.select(selection.energy_profile(dense), tau=TAU).select(
        ID, "n_rows", "n_cols", "share", "vals",
        projection.kept("coef").alias("p"), projection.kept("mcoef").alias("d"),
    )
    table = cells(idct2d(kept, p="p", d="d"), p="p", d="d", s="share", v="vals")

    def blended(name):
        return tidy(projection.blend(F.col(name), F.col("s"), F.col("v")), 4)

    return table.select(ID, "i", "j", blended("p").alias("plain"), blended("d").alias("with_delta"))


BY_KIND = "l_suppkey::VARCHAR || '/' || l_returnflag"


@query(
    q.with_parts(
        [*q.supplier_cells("cells", BY_KIND), *q.forward("cells", "raw"), q.profile("raw", "prof"),
         q.energy("prof", "sel", TAU), *q.inverse("sel", "back", {"p": "CASE WHEN x.keep THEN x.c ELSE 0.0 END"})],
        f"""SELECT split_part(b.matrix_id, '/', 1) AS group_id, split_part(b.matrix_id, '/', 2) AS kind, b.i, b.j,
  {q.r('b.p * s.share', 6)} AS v FROM back b JOIN prof s ON s.matrix_id = b.matrix_id AND s.k = b.i AND s.l = b.j""",
    )
)
def project_by_kind(spark, sf_dir):
    """Three related matrices per supplier, each projected on its own selection and weighed by its profile."""
    key = F.concat_ws("/", F.col("l_suppkey").cast("string"), "l_returnflag")
    dense = dct2d(inputs.supplier_months(spark, sf_dir, key).drop("grad"))
    kept = selection.select_energy(selection.energy_profile(dense), TAU)
    table = cells(projection.project(kept, out="p", carry=["share"]), p="p", s="share")
    part = F.split(F.col(ID), "/")
    return table.select(
        part[0].alias("group_id"), part[1].alias("kind"), "i", "j", tidy(F.col("p") * F.col("s"), 6).alias("v")
    )


TENSOR_SQL = [
    *q.tensor_cells(),
    q.axis("tensor", "by_layer", "layer", 31),
    f"cut_layer AS (SELECT * FROM by_layer WHERE layer < {R_LAYERS})",
    q.axis("cut_layer", "by_head", "head", 5),
    f"""slices AS (SELECT layer::VARCHAR || '/' || head::VARCHAR AS matrix_id, 4 AS m, 6 AS n, i, j, v FROM by_head
  WHERE head < {R_HEADS})""",
    *q.forward("slices", "raw"),
    "plain AS (SELECT 'sum' AS matrix_id, 4 AS m, 6 AS n, i, j, sum(v) AS v FROM tensor GROUP BY i, j)",
    *q.forward("plain", "plain_raw"),
    q.profile("plain_raw", "prof"),
]


def _tensor_profile(tensor: DataFrame) -> DataFrame:
    """Profile of the tensor summed over layers and heads."""
    flat = tensor.groupBy(ID, "i", "j").agg(F.sum("v").alias("v")).withColumns(
        {"n_rows": F.lit(4), "n_cols": F.lit(6)}
    )
    return selection.energy_profile(dct2d(dense_from_cells(flat, vals="v")))


@query(
    q.with_parts(
        [*TENSOR_SQL, "weighed AS (SELECT r.matrix_id, r.m, r.n, r.k, r.l, r.c * p.share AS c FROM raw r JOIN prof p USING (k, l))",
         *q.inverse("weighed", "back", {"v": "x.c"})],
        f"""SELECT split_part(matrix_id, '/', 1)::INTEGER AS layer, split_part(matrix_id, '/', 2)::INTEGER AS head, i, j,
  {q.r('v', 4)} AS v FROM back""",
    )
)
def tensor_project(spark, sf_dir):
    tensor = inputs.event_tensor(spark, sf_dir)
    done = projection.tensor_project(tensor, coefficients(_tensor_profile(tensor), share="share"), R_LAYERS, R_HEADS)
    return done.select("layer", "head", "i", "j", tidy(F.col("v"), 4).alias("v"))


@query(
    q.with_parts(
        [*TENSOR_SQL, q.energy("prof", "sel", TENSOR_TAU)],
        f"""SELECT CAST(sum(keep::INTEGER) AS BIGINT) AS kept,
  {q.r(f'(31.0 / {R_LAYERS}) * (5.0 / {R_HEADS}) * (count(*) / sum(keep::INTEGER))')} AS ratio FROM sel""",
    )
)
def tensor_ratio(spark, sf_dir):
    tensor = inputs.event_tensor(spark, sf_dir)
    kept = coefficients(selection.select_energy(_tensor_profile(tensor), TENSOR_TAU), keep="keep").agg(
        F.count(F.lit(1)).alias("size"), score.kept_count(F.col("keep")).alias("kept")
    )
    extent = tensor.agg((F.max("layer") + 1).alias("layers"), (F.max("head") + 1).alias("heads"))
    sized = kept.withColumn("__e", extent.select(F.struct("layers", "heads")).scalar())
    return sized.select(
        "kept",
        tidy(
            projection.tensor_ratio(
                F.col("__e.layers"), F.lit(R_LAYERS), F.col("__e.heads"), F.lit(R_HEADS), F.col("size"), F.col("kept")
            )
        ).alias("ratio"),
    )


@query(
    q.with_parts(
        [*SUPPLIER_SQL, q.energy("prof", "e1", TAU, keep="kf"), q.energy("e1", "e2", LOW_TAU, keep="kl"),
         *q.inverse("e2", "back", {"a": "CASE WHEN x.kl THEN x.c ELSE 0.0 END",
                                   "b": "CASE WHEN x.kf THEN x.c ELSE 0.0 END",
                                   "d": "CASE WHEN x.kf AND NOT x.kl THEN x.c ELSE 0.0 END"}),
         f"""three AS (SELECT b.matrix_id, b.i, b.j, b.d, b.a * s.share + o.v * (1.0 - s.share) AS l1,
  b.b * s.share + o.v * (1.0 - s.share) AS l2 FROM back b {BLEND_JOIN})"""],
        f"""SELECT matrix_id, i, j, 'L1' AS level, {q.r('l1', 4)} AS value FROM three
UNION ALL SELECT matrix_id, i, j, 'L2', {q.r('l2', 4)} FROM three
UNION ALL SELECT matrix_id, i, j, 'L3', {q.r('l2 + 0.1::DOUBLE * d', 4)} FROM three""",
    )
)
def progressive_levels(spark, sf_dir):
    profile = supplier_profile(spark, sf_dir)
    masks = selection.select_energy(selection.select_energy(profile, TAU, out="full"), LOW_TAU, out="low")
    levels = projection.progressive(masks)
    return levels.select(ID, "i", "j", "level", tidy(F.col("value"), 4).alias("value"))


@query(
    q.with_parts(
        [*q.supplier_cells("cells", BY_KIND), *q.forward("cells", "raw"), q.profile("raw", "prof"),
         """pairs AS (SELECT split_part(a.matrix_id, '/', 1) AS matrix_id, a.m, a.n, a.k, a.l, a.c,
  (a.share + b.share) / 2.0 AS shared,
  least(greatest(b.share / greatest((a.share + b.share) / 2.0, 1e-6::DOUBLE), 0.5), 2.0) AS specific
  FROM prof a JOIN prof b ON split_part(a.matrix_id, '/', 1) = split_part(b.matrix_id, '/', 1) AND a.k = b.k AND a.l = b.l
  WHERE a.matrix_id LIKE '%/A' AND b.matrix_id LIKE '%/R')""",
         "adapted AS (SELECT *, shared * specific AS share FROM pairs)",
         q.energy("adapted", "sel", TAU),
         *q.inverse("sel", "back", {"p": "CASE WHEN x.keep THEN x.c ELSE 0.0 END"})],
        f"""SELECT b.matrix_id, b.i, b.j, {q.r('b.p * s.share + o.v * (1.0 - s.share)', 4)} AS v
FROM back b JOIN adapted s ON s.matrix_id = b.matrix_id AND s.k = b.i AND s.l = b.j
JOIN cells o ON o.matrix_id = b.matrix_id || '/A' AND o.i = b.i AND o.j = b.j""",
    )
)
def transfer_blend(spark, sf_dir):
    """Each supplier's matrix of kind A, blended by the profile it shares with kind R."""
    key = F.concat_ws("/", F.col("l_suppkey").cast("string"), "l_returnflag")
    dense = dct2d(inputs.supplier_months(spark, sf_dir, key).drop("grad"), coef="vals")
    part = F.split(F.col(ID), "/")
    profile = selection.energy_profile(dense).withColumns({"kind": part[1], ID: part[0]})
    target = profile.where(F.col("kind") == "R").select(ID, F.col("share").alias("target"))
    pairs = profile.where(F.col("kind") == "A").join(target, ID)
    pairs = pairs.withColumns(
        {
            "shared": F.zip_with("share", "target", projection.shared_share),
            "specific": F.zip_with("share", "target", projection.specific_share),
            "adapted": F.zip_with("share", "target", projection.adapted_share),
        }
    )
    kept = selection.select_energy(pairs, TAU, "adapted")
    return _cells_out(projection.transfer(kept, "shared", "specific"), 4, "blended")


GRAM_SQL = q.with_parts(
    [q.embedding_ranks(),
     """entries AS (SELECT label::VARCHAR AS matrix_id, r, unnest(range(len(embedding)))::INTEGER AS j,
  unnest(embedding)::DOUBLE AS v FROM ranks)"""],
    f"""SELECT a.matrix_id, a.j AS i, b.j AS j, {q.r('sum(a.v * b.v)', 5)} AS v
FROM entries a JOIN entries b ON a.matrix_id = b.matrix_id AND a.r = b.r GROUP BY ALL""",
)


@query(GRAM_SQL)
def gram(spark, sf_dir):
    return _cells_out(factor.gram(inputs.embedding_vectors(spark, sf_dir)), 5)


@query(GRAM_SQL)
def qr_gram(spark, sf_dir):
    """RᵀR from the triangular factor, which must equal WᵀW."""
    return _cells_out(factor.gram(factor.qr_r(inputs.embedding_vectors(spark, sf_dir))), 5)


def _factor_sql(ridge: float, select: str) -> str:
    """Upper factor of WᵀW + ridge*I by elimination, one pivot a step, over its upper half."""
    return f"""WITH RECURSIVE {q.embedding_ranks()},
heights AS (SELECT label::VARCHAR AS matrix_id, count(*) AS height FROM embeddings GROUP BY label),
entries AS (SELECT label::VARCHAR AS matrix_id, r, unnest(range(len(embedding)))::INTEGER AS j, unnest(embedding)::DOUBLE AS v FROM ranks),
products AS MATERIALIZED (SELECT a.matrix_id, a.j AS i, b.j AS j, sum(a.v * b.v) + CASE WHEN a.j = b.j THEN {ridge}::DOUBLE ELSE 0.0 END AS v
  FROM entries a JOIN entries b ON a.matrix_id = b.matrix_id AND a.r = b.r AND a.j <= b.j GROUP BY a.matrix_id, a.j, b.j),
steps AS (SELECT 0 AS pivot, matrix_id, i, j, v FROM products
  UNION ALL SELECT a.pivot + 1, a.matrix_id, a.i, a.j, a.v - c.v * d.v / p.v FROM steps a
  JOIN steps p ON p.matrix_id = a.matrix_id AND p.i = a.pivot AND p.j = a.pivot
  JOIN steps c ON c.matrix_id = a.matrix_id AND c.i = a.pivot AND c.j = a.i
  JOIN steps d ON d.matrix_id = a.matrix_id AND d.i = a.pivot AND d.j = a.j WHERE a.i > a.pivot),
factor AS (SELECT s.matrix_id, s.i, s.j, s.v / sqrt(greatest(p.v, 0.0)) AS v FROM steps s
  JOIN steps p ON p.matrix_id = s.matrix_id AND p.pivot = s.pivot AND p.i = s.pivot AND p.j = s.pivot WHERE s.i = s.pivot)
{select}"""


@query(_factor_sql(0.0, f"""SELECT matrix_id, i, j, {q.r('v', 4)} AS v FROM factor JOIN heights USING (matrix_id) WHERE i < height"""))
def qr_r(spark, sf_dir):
    r = factor.qr_r(inputs.embedding_vectors(spark, sf_dir))
    upper = r.select(ID, "i", F.posexplode("row").alias("j", "v")).where(F.col("j") >= F.col("i"))
    return _cells_out(upper, 4)


@query(_factor_sql(0.0, """, norms AS (SELECT matrix_id, i, sum(v * v) AS norm FROM factor JOIN heights USING (matrix_id) WHERE i < height GROUP BY ALL),
placed AS (SELECT matrix_id, h.height, t.i, row_number() OVER (PARTITION BY matrix_id ORDER BY coalesce(norm, 0.0) DESC, t.i) AS place
  FROM (SELECT matrix_id, height, unnest(range(height)) AS i FROM heights) t JOIN heights h USING (matrix_id) LEFT JOIN norms n USING (matrix_id, i)),
widths AS (SELECT matrix_id, max(j) + 1 AS n FROM factor GROUP BY matrix_id)
SELECT matrix_id, i AS k, unnest(range(n))::INTEGER AS l FROM placed JOIN widths USING (matrix_id) WHERE place <= greatest(1, height // 4)"""))
def select_qr_rows(spark, sf_dir):
    return factor.select_qr_rows(inputs.embedding_vectors(spark, sf_dir))


@query(GRAM_SQL.replace("sum(a.v * b.v)", "sum(a.v * b.v) + any_value(CASE WHEN a.j = b.j THEN 0.5 ELSE 0.0 END)"))
def cholesky_gram(spark, sf_dir):
    """FᵀF of the factor of WᵀW + I/2, made in tiles of 32 columns, which must give that matrix back."""
    vectors = inputs.embedding_vectors(spark, sf_dir)
    return _cells_out(factor.gram(tiles.cholesky_rows(vectors, 0.5, side=32)), 5)


@query(_factor_sql(factor.RIDGE, f"SELECT matrix_id, i, j, {q.r('v', 4)} AS v FROM factor"))
def cholesky_r(spark, sf_dir):
    upper = tiles.cholesky_rows(inputs.embedding_vectors(spark, sf_dir), factor.RIDGE)
    return _cells_out(upper.select(ID, "i", F.posexplode("row").alias("j", "v")).where(F.col("j") >= F.col("i")), 4)


RUNS_SQL = """spots AS (SELECT matrix_id, n, {place} AS pos FROM {source} WHERE {keep}),
islands AS (SELECT matrix_id, min(pos) AS first, max(pos) AS last FROM (
  SELECT matrix_id, pos, pos - row_number() OVER (PARTITION BY matrix_id ORDER BY pos) AS island FROM spots) GROUP BY matrix_id, island)"""


def _runs_sql(keep: str) -> str:
    part = RUNS_SQL.format(place="(k * n + l)::BIGINT", keep=keep, source="twice")
    return q.with_parts([*SUPPLIER_SQL, *BOTH_SQL, part], "SELECT matrix_id, first, last FROM islands")


def _supplier_runs(spark, sf_dir, combine) -> DataFrame:
    """Masks by energy and by gradient as runs of positions, combined run by run."""
    profile = supplier_profile(spark, sf_dir)
    profile = selection.select(profile, "energy-only", tau=TAU, out="ke")
    profile = selection.select(profile, "gradient", tau=TAU, out="kg")
    flags = coefficients(profile, ke="ke", kg="kg")
    by_energy, by_gradient = (runs.from_places(flags.where(k).select(ID, "n_cols", "k", "l")) for k in ("ke", "kg"))
    return combine(by_energy, by_gradient).select(ID, "first", "last")


@query(_runs_sql("(ke AND kg)"))
def runs_both(spark, sf_dir):
    return _supplier_runs(spark, sf_dir, runs.both)


@query(_runs_sql("(ke OR kg)"))
def runs_either(spark, sf_dir):
    return _supplier_runs(spark, sf_dir, runs.either)


@query(_runs_sql("(ke AND NOT kg)"))
def runs_first_only(spark, sf_dir):
    return _supplier_runs(spark, sf_dir, runs.first_only)
