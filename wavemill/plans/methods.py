"""Approximation methods, scores and the experiments that compare them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.functions.numeric import tidy
from wavemill.operators import approx, krylov, projection, score, selection, slices, strips, transfer
from wavemill.operators.matrix import ID, cells, weighted_sum
from wavemill.operators.transform import coefficients, dct2d, idct2d
from wavemill.plans import inputs
from wavemill.plans import sqlparts as q
from wavemill.plans.registry import CHECKS, query
from wavemill.plans.slicing import CATALOG
from wavemill.plans.spectral import (
    BLEND_JOIN,
    BOTH_SQL,
    EMBEDDING_SQL,
    SUPPLIER_SQL,
    TAU,
    supplier_profile,
)

PAIRS = [(0, 1), (2, 3), (4, 5)]
ADAPTED_8 = ["ECO", "PROMO"]
ADAPTED_64 = ["ECO", "PROMO", "LARGE", "SMALL", "STANDARD"]


def _band_scores(table: DataFrame, v: str, approximation: str) -> DataFrame:
    return table.groupBy(ID).agg(score.fidelity(F.col(v), F.col(approximation)).alias("fidelity"))


QUANTIZE_SQL = [
    """scaled AS (SELECT *, CASE WHEN max(abs(v)) OVER (PARTITION BY matrix_id) >= 1e-8
  THEN max(abs(v)) OVER (PARTITION BY matrix_id) / 7.0 END AS scale FROM cells)""",
    "rounded AS (SELECT *, round_even(v / scale, 0) * scale AS a FROM scaled)",
]


@query(q.with_parts([*q.embedding_cells(), *QUANTIZE_SQL],
                    f"""SELECT matrix_id, {q.r('max(scale)')} AS scale, count(DISTINCT round_even(v / scale, 0)) AS levels,
  {q.r(q.fidelity('v', 'a'))} AS fidelity FROM rounded GROUP BY matrix_id"""))
def quantize_int4(spark, sf_dir):
    rounded = approx.quantize_rows(inputs.embedding_vectors(spark, sf_dir))
    steps = F.array_distinct(F.transform("row", lambda x: F.rint(x / F.col("scale")) + F.lit(0.0)))
    levels = rounded.select(ID, "scale", F.explode(steps).alias("step")).groupBy(ID).agg(
        tidy(F.max("scale")).alias("scale"), F.count_distinct("step").alias("levels")
    )
    scored = score.row_fidelity(rounded).select(ID, tidy(F.col("fidelity")).alias("fidelity"))
    return levels.join(scored, ID)


def ranked_segments(rows: DataFrame) -> DataFrame:
    """Written segments of matrices given as ``matrix_id, i, row``."""
    return strips.written_segments(rows.select(ID, F.col("i").alias("at"), "row"))


def _projected_fidelity(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """How near the kept coefficients come to the rows: both meet by position, matrix by matrix of any height."""
    back = strips.inverse(strips.keep_only(marked)).withColumnRenamed("row", "approx")
    scored = score.row_fidelity(rows.select(ID, "i", "row").join(back, [ID, "i"]))
    return scored.select(ID, tidy(F.col("fidelity")).alias("fidelity"))


def _topk_sql(count: str) -> str:
    return q.with_parts(
        [*EMBEDDING_SQL, q.largest("prof", "sel", count, "c"),
         *q.inverse("sel", "back", {"p": "CASE WHEN x.keep THEN x.c ELSE 0.0 END"}),
         "counts AS (SELECT matrix_id, CAST(sum(keep::INTEGER) AS BIGINT) AS kept FROM sel GROUP BY matrix_id)"],
        f"""SELECT b.matrix_id, any_value(kept) AS kept, {q.r(q.fidelity('o.v', 'b.p'))} AS fidelity
FROM back b JOIN cells o USING (matrix_id, i, j) JOIN counts USING (matrix_id) GROUP BY b.matrix_id""",
    )


def _topk(spark, sf_dir, fraction: float | None = None) -> DataFrame:
    rows = inputs.embedding_rows(spark, sf_dir)
    marked = strips.select_largest(ranked_segments(rows), approx.parameter_count(fraction))
    scored = _projected_fidelity(rows, marked)
    return strips.retained(marked).select(ID, "kept").join(scored, ID)


@query(_topk_sql("greatest(1, least(8 * (m + n), m * n))"))
def topk_spectral(spark, sf_dir):
    """As many of the largest coefficients as a rank-8 pair of factors has numbers."""
    return _topk(spark, sf_dir)


@query(_topk_sql("greatest(1, least(floor(m * n * 0.08::DOUBLE), m * n))"))
def topk_fraction(spark, sf_dir):
    """A fixed 8% of the coefficients."""
    return _topk(spark, sf_dir, 0.08)


def _recursive(parts: list[str], select: str) -> str:
    return q.with_parts(parts, select).replace("WITH ", "WITH RECURSIVE ", 1)


LOW_RANK_SQL = [
    *q.embedding_cells(),
    *q.leading("cells", "lead", approx.RANK),
    "totals AS (SELECT matrix_id, sum(v * v) AS energy FROM cells GROUP BY matrix_id)",
    """ranked AS (SELECT matrix_id, energy, captured, greatest(energy - captured, 0.0) AS rest,
  1.0 - sqrt(greatest(energy - captured, 0.0)) / greatest(sqrt(energy), 1e-8::DOUBLE) AS fidelity FROM totals JOIN lead USING (matrix_id))""",
]


@query(_recursive(LOW_RANK_SQL, f"""SELECT matrix_id, {q.r('energy', 4)} AS energy, {q.r('captured', 4)} AS captured, {q.r('rest', 4)} AS rest,
  {q.r('fidelity', 5)} AS fidelity, 0.0::DOUBLE AS residual FROM ranked"""))
def low_rank(spark, sf_dir):
    """Rank-8 approximation of whole label matrices: energy captured and left, and the largest residual of a direction."""
    vectors = inputs.embedding_vectors(spark, sf_dir)
    directions = krylov.leading_directions(vectors, approx.RANK)
    done = krylov.along(vectors, directions)
    off = F.aggregate(F.zip_with("row", "approx", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)
    rest = done.select(ID, off.alias("off")).groupBy(ID).agg(F.sum("off").alias("rest"))
    distance = F.sqrt("rest") / F.greatest(F.sqrt("energy"), F.lit(score.NORM_FLOOR))
    captured = F.aggregate("held", F.lit(0.0), lambda acc, x: acc + x)
    return rest.join(directions, ID).select(
        ID, tidy(F.col("energy"), 4).alias("energy"), tidy(captured, 4).alias("captured"), tidy(F.col("rest"), 4).alias("rest"),
        tidy(F.lit(1.0) - distance, 5).alias("fidelity"), tidy(F.array_max("residuals") / F.col("energy")).alias("residual"),
    )


COSINE = "(0.5 + 0.5 * cos(pi() * i / greatest(m - 1, 1) + pi() * j / greatest(n - 1, 1)))"
COSINE_LOW_RANK_SQL = [
    f"heavy AS (SELECT matrix_id, i, j, v * {COSINE} AS v FROM cells)",
    *q.leading("heavy", "turned", approx.RANK),
    """near AS (SELECT matrix_id, i, w, vs, list_transform(vs, lambda x: list_dot_product(x, w)) AS marks
  FROM turned_rows JOIN turned USING (matrix_id))""",
    """near_cells AS (SELECT matrix_id, i, t.j::INTEGER AS j, list_dot_product(marks, list_transform(vs, lambda x: x[t.j + 1])) AS a
  FROM near, unnest(range(len(w))) AS t(j))""",
    f"""mixed AS (SELECT matrix_id, v, {COSINE} AS weight, a FROM cells JOIN near_cells USING (matrix_id, i, j))""",
    f"""cosine_ranked AS (SELECT matrix_id, {q.fidelity('v', '(weight * weight * a / greatest(weight, 0.3) + (1.0 - weight * weight) * v)')} AS fidelity
  FROM mixed GROUP BY matrix_id)""",
]


@query(_recursive([*q.embedding_cells(), *COSINE_LOW_RANK_SQL], f"SELECT matrix_id, {q.r('fidelity', 5)} AS fidelity FROM cosine_ranked"))
def cosine_low_rank(spark, sf_dir):
    scored = score.row_fidelity(approx.cosine_low_rank(inputs.embedding_rows(spark, sf_dir), approx.RANK))
    return scored.select(ID, tidy(F.col("fidelity"), 5).alias("fidelity"))


@query(
    q.with_parts(
        q.embedding_cells(),
        f"""SELECT matrix_id, i, j, {q.r('0.5 + 0.5 * cos(pi() * i / greatest(m - 1, 1) + pi() * j / greatest(n - 1, 1))')} AS weight,
  {q.r('v * (0.5 + 0.5 * cos(pi() * i / greatest(m - 1, 1) + pi() * j / greatest(n - 1, 1)))')} AS weighted FROM cells""",
    )
)
def cosine_weight(spark, sf_dir):
    rows = inputs.embedding_rows(spark, sf_dir)
    heights = rows.groupBy(ID).agg(F.count(F.lit(1)).alias("n_rows"))
    table = rows.join(heights, ID).select(
        ID, F.col("i").cast("int").alias("i"), "n_rows", F.size("row").alias("n_cols"), F.posexplode("row").alias("j", "v")
    )
    weight = approx.cosine_weight(F.col("i"), F.col("j"), F.col("n_rows"), F.col("n_cols"))
    return table.select(
        ID, "i", "j", tidy(weight).alias("weight"), tidy(F.col("v") * weight).alias("weighted")
    )


def _adapter_sql(parts: list[str], rank: int) -> str:
    match = " OR ".join(f"contains(name, '{p}')" for p in parts)
    return f"""SELECT {rank}::INTEGER AS rank, CAST(sum(CASE WHEN ({match}) AND n_dims >= 2 THEN {rank} * (n_rows + n_cols) ELSE 0 END) AS BIGINT) AS trainable,
  CAST(sum(n_rows * n_cols) AS BIGINT) AS base FROM catalog"""


@query(
    q.with_parts(
        [CATALOG, f"ranks AS ({_adapter_sql(ADAPTED_8, 8)} UNION ALL {_adapter_sql(ADAPTED_64, 64)})"],
        f"SELECT rank, trainable, base + trainable AS total, {q.r('trainable / (base + trainable)')} AS ratio FROM ranks",
    )
)
def adapter_ratio(spark, sf_dir):
    catalog = inputs.catalog(spark, sf_dir)
    flat = F.col("n_dims") >= 2
    small = approx.adapter_ratio(catalog, slices.name_contains("name", ADAPTED_8) & flat, 8)
    large = approx.adapter_ratio(catalog, slices.name_contains("name", ADAPTED_64) & flat, 64)
    return small.unionByName(large).withColumn("ratio", tidy(F.col("ratio")))


PROJECTED_SQL = [
    *EMBEDDING_SQL,
    q.energy("prof", "sel", TAU),
    *q.inverse("sel", "back", {"p": "CASE WHEN x.keep THEN x.c ELSE 0.0 END"}),
]


@query(q.with_parts(PROJECTED_SQL, f"""SELECT matrix_id, {q.r(q.fidelity('o.v', 'b.p'))} AS fidelity
FROM back b JOIN cells o USING (matrix_id, i, j) GROUP BY matrix_id"""))
def fidelity(spark, sf_dir):
    """Matrices and their projections lined up by row."""
    rows = inputs.embedding_rows(spark, sf_dir)
    return _projected_fidelity(rows, strips.select_energy(ranked_segments(rows), TAU))


@query(
    q.with_parts(
        PROJECTED_SQL,
        f"""SELECT b.matrix_id, b.i, b.j, {q.r('b.p * s.share + o.v * (1.0 - s.share)', 5)} AS blended
FROM back b JOIN cells o USING (matrix_id, i, j) JOIN sel s ON s.matrix_id = b.matrix_id AND s.k = b.i AND s.l = b.j""",
    )
)
def strip_blend(spark, sf_dir):
    """The blend of matrices of any height with what their kept coefficients give."""
    rows = inputs.embedding_rows(spark, sf_dir)
    marked = strips.select_energy(ranked_segments(rows), TAU)
    mixed = strips.blend(rows, marked, strips.inverse(strips.keep_only(marked)))
    flat = mixed.select(ID, F.col("i").cast("int").alias("i"), F.posexplode("blended").alias("j", "v"))
    return flat.select(ID, "i", "j", tidy(F.col("v"), 5).alias("blended"))


@query(q.with_parts([*SUPPLIER_SQL, *BOTH_SQL],
                    f"""SELECT matrix_id, {q.r('sum(CASE WHEN ke AND kg THEN c * c ELSE 0.0 END) / (sum(c * c) + 1e-12::DOUBLE)')} AS retained
FROM twice GROUP BY matrix_id"""))
def retained_energy(spark, sf_dir):
    """Energy kept under a sparse mask."""
    profile = supplier_profile(spark, sf_dir)
    mask = selection.positions(selection.select(profile, tau=TAU))
    marked = selection.apply_mask(coefficients(profile), mask)
    return marked.groupBy(ID).agg(
        tidy(score.retained_energy(F.col("c"), F.col("keep"))).alias("retained")
    )


@query(q.with_parts([*SUPPLIER_SQL, *BOTH_SQL],
                    f"""SELECT matrix_id, CAST(sum((ke AND kg)::INTEGER) AS BIGINT) AS kept, count(*) AS total,
  {q.r(q.ratio('(ke AND kg)'))} AS ratio FROM twice GROUP BY matrix_id"""))
def compression_ratio(spark, sf_dir):
    kept = coefficients(selection.select(supplier_profile(spark, sf_dir), tau=TAU), keep="keep")
    return kept.groupBy(ID).agg(
        score.kept_count(F.col("keep")).alias("kept"),
        F.count(F.lit(1)).alias("total"),
        tidy(score.compression_ratio(F.col("keep"))).alias("ratio"),
    )


@query(
    q.with_parts(
        [CATALOG, *SUPPLIER_SQL, *BOTH_SQL,
         f"ratios AS (SELECT {q.ratio('(ke AND kg)')} AS ratio FROM twice GROUP BY matrix_id)",
         "mean AS (SELECT avg(ratio) AS ratio FROM ratios)"],
        f"""SELECT kind, round(sum(n_rows::DOUBLE * n_cols * bytes_per_value) / 1e9, 12) AS gigabytes,
  round(sum(n_rows::DOUBLE * n_cols * bytes_per_value) / 1e9 / any_value(mean.ratio), 12) AS compressed FROM catalog, mean GROUP BY kind""",
    )
)
def size_estimate(spark, sf_dir):
    """Catalog size per kind, before and after the mean compression of the supplier matrices."""
    kept = coefficients(selection.select(supplier_profile(spark, sf_dir), tau=TAU), keep="keep")
    ratios = kept.groupBy(ID).agg(score.compression_ratio(F.col("keep")).alias("ratio"))
    mean = ratios.agg(score.mean_or(F.col("ratio"), 1.0)).scalar()
    sizes = inputs.catalog(spark, sf_dir).groupBy("kind").agg(score.catalog_gigabytes().alias("gigabytes"))
    return sizes.select(
        "kind", F.round("gigabytes", 12).alias("gigabytes"), F.round(F.col("gigabytes") / mean, 12).alias("compressed")
    )


SEGMENTS_SQL = [
    *q.embedding_cells(),
    f"pairs AS (SELECT * FROM (VALUES {', '.join(str(p) for p in PAIRS)}) AS t(src, tgt))",
    """labels AS (SELECT DISTINCT matrix_id::INTEGER AS label, matrix_id, m, n FROM cells)""",
    """sized AS (SELECT src, tgt, s.matrix_id AS sid, t.matrix_id AS tid, greatest(s.m, t.m)::INTEGER AS m, s.n
  FROM pairs JOIN labels s ON s.label = src JOIN labels t ON t.label = tgt)""",
    """moved AS (SELECT *, v - coalesce(lag(v) OVER (PARTITION BY matrix_id, j ORDER BY i), v) AS g FROM cells)""",
    """sides AS (
  SELECT src || '/' || tgt || '/' || side AS matrix_id, z.m, z.n, a.i::INTEGER AS i, b.j::INTEGER AS j, coalesce(c.v, 0.0) AS v, coalesce(c.g, 0.0) AS g
  FROM (SELECT *, sid AS id, 's' AS side FROM sized UNION ALL SELECT *, tid, 't' FROM sized) z,
    LATERAL (SELECT unnest(range(z.m)) AS i) a, LATERAL (SELECT unnest(range(z.n)) AS j) b
  LEFT JOIN moved c ON c.matrix_id = z.id AND c.i = a.i AND c.j = b.j)""",
    *q.forward("sides", "raw", {"c": "v", "g": "g"}),
    q.profile("raw", "prof"),
    """lined AS (SELECT s.matrix_id, s.m, s.n, s.k, s.l, s.share AS ss, t.share AS ts, s.g AS sg, t.g AS tg, t.c AS tc,
  (s.share + t.share) / 2.0 * least(greatest(t.share / greatest((s.share + t.share) / 2.0, 1e-6::DOUBLE), 0.5), 2.0) AS xs
  FROM prof s JOIN prof t ON t.matrix_id = replace(s.matrix_id, '/s', '/t') AND t.k = s.k AND t.l = s.l
  WHERE s.matrix_id LIKE '%/s')""",
    q.energy("lined", "l1", TAU, "ss", "es"),
    q.energy("l1", "l2", TAU, "ts", "et"),
    q.energy("l2", "l3", TAU, "xs", "ex"),
    q.largest("l3", "l4", q.quarter(), "sg", "gs"),
    q.largest("l4", "l5", q.quarter(), "tg", "gt"),
    """scored AS (SELECT split_part(matrix_id, '/', 1) AS src, split_part(matrix_id, '/', 2) AS tgt,
  sum(CASE WHEN es AND gs THEN tc * tc ELSE 0.0 END) / (sum(tc * tc) + 1e-12::DOUBLE) AS baseline,
  sum(CASE WHEN ex AND gt THEN tc * tc ELSE 0.0 END) / (sum(tc * tc) + 1e-12::DOUBLE) AS transfer,
  sum(CASE WHEN et AND gt THEN tc * tc ELSE 0.0 END) / (sum(tc * tc) + 1e-12::DOUBLE) AS "full"
  FROM l5 GROUP BY ALL)""",
]


@query(
    q.with_parts(
        SEGMENTS_SQL,
        """SELECT 'transfer ' || src || '->' || tgt AS method, round(baseline * 100, 4) + 0.0 AS baseline,
  round(transfer * 100, 4) + 0.0 AS transfer, round("full" * 100, 4) + 0.0 AS "full",
  round((transfer - baseline) * 100, 4) + 0.0 AS delta, round(("full" - transfer) * 100, 4) + 0.0 AS gap FROM scored""",
    )
)
def segment_transfer(spark, sf_dir):
    """One target matrix under three masks, for all pairs of segments in one job.

    The whole target is scored: the lower of the two matrices is filled up with rows
    of zeros. The mask of the source uses its own gradient (here the step from the
    vector before), the adapted and the target's own mask use the target's.
    """
    # The list of pairs is an argument of the experiment, a handful of rows.
    pairs = spark.createDataFrame([(str(a), str(b)) for a, b in PAIRS], "src string, tgt string")
    scored = transfer.transfer_scores(transfer.with_steps(inputs.embedding_rows(spark, sf_dir)), pairs, TAU)

    def percent(x):
        return tidy(x * F.lit(100.0), 4)

    return scored.select(
        F.format_string("transfer %s->%s", "src", "tgt").alias("method"),
        percent(F.col("baseline")).alias("baseline"),
        percent(F.col("transfer")).alias("transfer"),
        percent(F.col("full")).alias("full"),
        percent(F.col("transfer") - F.col("baseline")).alias("delta"),
        percent(F.col("full") - F.col("transfer")).alias("gap"),
    )


STRATEGIES = {"energy+gradient": "(ke AND kg)", "energy-only": "ke", "gradient": "kg"}
_arms = " UNION ALL ".join(
    f"""SELECT '{name}' AS strategy, b.matrix_id, {q.fidelity('o.v', f'(b.p{n} * s.share + o.v * (1.0 - s.share))')} AS fidelity
FROM back b {BLEND_JOIN} GROUP BY b.matrix_id"""
    for n, name in enumerate(STRATEGIES)
)
_ratios = " UNION ALL ".join(
    f"SELECT '{name}' AS strategy, matrix_id, {q.ratio(keep)} AS ratio FROM twice GROUP BY matrix_id"
    for name, keep in STRATEGIES.items()
)


@query(
    q.with_parts(
        [*SUPPLIER_SQL, *BOTH_SQL,
         *q.inverse("twice", "back", {f"p{n}": f"CASE WHEN {k.replace('ke', 'x.ke').replace('kg', 'x.kg')} THEN x.c ELSE 0.0 END"
                                     for n, k in enumerate(STRATEGIES.values())}),
         f"fid AS ({_arms})", f"rat AS ({_ratios})"],
        f"""SELECT strategy, count(*) AS matrices, {q.r('avg(fidelity)')} AS fidelity, {q.r('avg(ratio)')} AS ratio
FROM fid JOIN rat USING (strategy, matrix_id) GROUP BY strategy""",
    )
)
def strategy_ablation(spark, sf_dir):
    """Every strategy on the same matrices in one pass: blended fidelity and ratio."""
    profile = supplier_profile(spark, sf_dir)
    arms = list(STRATEGIES)
    for n, strategy in enumerate(arms):
        profile = selection.select(profile, strategy, tau=TAU, out=f"k{n}")
    for n in range(len(arms)):
        profile = profile.withColumn(f"p{n}", projection.kept("coef", f"k{n}"))
    names = [f"{x}{n}" for x in "pk" for n in range(len(arms))]
    dense = idct2d(profile.drop("coef", "gcoef"), **{n: n for n in names if n.startswith("p")})
    table = cells(dense, s="share", v="vals", **{n: n for n in names})
    per_matrix = table.groupBy(ID).agg(
        *[
            F.struct(
                F.lit(strategy).alias("strategy"),
                score.fidelity(
                    F.col("v"), projection.blend(F.col(f"p{n}"), F.col("s"), F.col("v"))
                ).alias("fidelity"),
                score.compression_ratio(F.col(f"k{n}")).alias("ratio"),
            ).alias(f"arm{n}")
            for n, strategy in enumerate(arms)
        ]
    )
    scores = per_matrix.select(ID, F.inline(F.array(*[F.col(f"arm{n}") for n in range(len(arms))])))
    return score.average_scores(scores, "strategy").select(
        "strategy", "matrices", tidy(F.col("fidelity")).alias("fidelity"), tidy(F.col("ratio")).alias("ratio")
    )


def _method_scores(spark, sf_dir) -> DataFrame:
    """Fidelity and ratio of the label matrices under three methods; matrices stay in strips and rows."""
    rows = inputs.embedding_rows(spark, sf_dir)
    segments = ranked_segments(rows)

    def selected(method, marked):
        back = strips.inverse(strips.keep_only(marked)).withColumnRenamed("row", "approx")
        scored = score.row_fidelity(rows.select(ID, "i", "row").join(back, [ID, "i"]))
        ratio = F.lit(1.0) / F.greatest(F.col("kept") / F.col("total"), F.lit(score.KEEP_FLOOR))
        return strips.retained(marked).join(scored, ID).select(F.lit(method).alias("method"), ID, "fidelity", ratio.alias("ratio"))

    rounded = score.row_fidelity(approx.quantize_rows(inputs.embedding_vectors(spark, sf_dir)))
    # Stored bits per value before and after, not a measured size.
    int4 = rounded.select(F.lit("int4").alias("method"), ID, "fidelity", F.lit(32.0 / approx.BITS).alias("ratio"))
    spectral = selected("spectral", strips.select_energy(segments, TAU))
    topk = selected("topk", strips.select_largest(segments, approx.parameter_count()))
    return spectral.unionByName(topk).unionByName(int4)


SCORES_SQL = [
    *EMBEDDING_SQL, q.energy("prof", "e1", TAU, keep="kp"),
    q.largest("e1", "e2", "greatest(1, least(8 * (m + n), m * n))", "c", "kt"),
    *q.inverse("e2", "back", {"p": "CASE WHEN x.kp THEN x.c ELSE 0.0 END", "t": "CASE WHEN x.kt THEN x.c ELSE 0.0 END"}),
    *QUANTIZE_SQL,
    f"""fid AS (SELECT matrix_id, {q.fidelity('r.v', 'b.p')} AS p, {q.fidelity('r.v', 'b.t')} AS t, {q.fidelity('r.v', 'r.a')} AS a
  FROM rounded r JOIN back b USING (matrix_id, i, j) GROUP BY matrix_id)""",
    f"rat AS (SELECT matrix_id, {q.ratio('kp')} AS p, {q.ratio('kt')} AS t FROM e2 GROUP BY matrix_id)",
    """scores AS (SELECT 'spectral' AS method, matrix_id, fid.p AS fidelity, rat.p AS ratio FROM fid JOIN rat USING (matrix_id)
  UNION ALL SELECT 'topk', matrix_id, fid.t, rat.t FROM fid JOIN rat USING (matrix_id) UNION ALL SELECT 'int4', matrix_id, fid.a, 8.0 FROM fid)""",
]


@query(q.with_parts(SCORES_SQL, f"SELECT method, count(*) AS matrices, {q.r('avg(fidelity)')} AS fidelity, {q.r('avg(ratio)')} AS ratio FROM scores GROUP BY method"))
def score_by_method(spark, sf_dir):
    averages = score.average_scores(_method_scores(spark, sf_dir), "method")
    return averages.select(
        "method", "matrices", tidy(F.col("fidelity")).alias("fidelity"), tidy(F.col("ratio")).alias("ratio")
    )


COMPARED_SQL = [
    *SCORES_SQL,
    *LOW_RANK_SQL[len(q.embedding_cells()):],
    *COSINE_LOW_RANK_SQL,
    "pairs_of AS (SELECT matrix_id, any_value(m * n / (8.0 * (m + n))) AS ratio FROM cells GROUP BY matrix_id)",
    """every AS (SELECT method, matrix_id, fidelity, ratio FROM scores
  UNION ALL SELECT 'low_rank', matrix_id, r.fidelity, p.ratio FROM ranked r JOIN pairs_of p USING (matrix_id)
  UNION ALL SELECT 'cosine_low_rank', matrix_id, c.fidelity, p.ratio FROM cosine_ranked c JOIN pairs_of p USING (matrix_id))""",
    f"adapters AS ({CHECKS['adapter_ratio']})",
    f"ablation AS ({CHECKS['strategy_ablation']})",
    f"transfers AS ({CHECKS['segment_transfer']})",
    """results AS (
  SELECT method, 'embeddings' AS dataset, matrix_id::BIGINT AS seed, unnest(['fidelity', 'ratio']) AS metric, unnest([fidelity, ratio]) AS value FROM every
  UNION ALL SELECT 'adapter ' || rank, 'catalog', NULL, unnest(['trainable', 'ratio']), unnest([trainable::DOUBLE, ratio]) FROM adapters
  UNION ALL SELECT 'ablation ' || strategy, 'suppliers', NULL, unnest(['fidelity', 'ratio']), unnest([fidelity, ratio]) FROM ablation
  UNION ALL SELECT method, 'embeddings', NULL, unnest(['baseline', 'transfer', 'full', 'delta', 'gap']),
    unnest([baseline, transfer, "full", delta, gap]) FROM transfers)""",
]


@query(_recursive(COMPARED_SQL, f"SELECT method, dataset, seed, metric, {q.r('value', 4)} AS value FROM results"))
def method_comparison(spark, sf_dir):
    """All methods as rows of a results table: per label (its pairing key), then adapters, strategies and segment transfers."""
    rows, vectors = inputs.embedding_rows(spark, sf_dir), inputs.embedding_vectors(spark, sf_dir)
    heights = vectors.groupBy(ID).agg(F.count(F.lit(1)).alias("m"), F.max(F.size("row")).alias("n"))
    pair = F.col("m") * F.col("n") / (F.lit(approx.RANK) * (F.col("m") + F.col("n")))

    def ranked(name, done):
        return score.row_fidelity(done).join(heights, ID).select(F.lit(name).alias("method"), ID, "fidelity", pair.alias("ratio"))

    def lines(table, method, dataset, metrics, key=None):
        pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics]
        seed = F.lit(None) if key is None else F.col(key)
        return table.select(method.alias("method"), F.lit(dataset).alias("dataset"), seed.cast("bigint").alias("seed"), F.inline(F.array(*pairs)))

    scores = (
        _method_scores(spark, sf_dir).select("method", ID, "fidelity", "ratio")
        .unionByName(ranked("low_rank", krylov.low_rank(vectors, approx.RANK)))
        .unionByName(ranked("cosine_low_rank", approx.cosine_low_rank(rows, approx.RANK)))
    )
    results = (
        lines(scores, F.col("method"), "embeddings", ["fidelity", "ratio"], ID)
        .unionByName(lines(adapter_ratio(spark, sf_dir), F.concat(F.lit("adapter "), "rank"), "catalog", ["trainable", "ratio"]))
        .unionByName(lines(strategy_ablation(spark, sf_dir), F.concat(F.lit("ablation "), "strategy"), "suppliers", ["fidelity", "ratio"]))
        .unionByName(lines(segment_transfer(spark, sf_dir), F.col("method"), "embeddings", ["baseline", "transfer", "full", "delta", "gap"]))
    )
    return results.withColumn("value", tidy(F.col("value"), 4))


MIXED_SQL = [
    *SUPPLIER_SQL,
    q.energy("prof", "sel", TAU),
    "mixed AS (SELECT matrix_id, m, n, i, j, 0.5 * v + 0.3 * g AS v FROM cells)",
    *q.forward("mixed", "mraw"),
    "lined AS (SELECT s.*, x.c AS x FROM sel s JOIN mraw x USING (matrix_id, k, l))",
    *q.inverse("lined", "back", {"a": "CASE WHEN x.keep THEN x.c ELSE 0.0 END", "b": "CASE WHEN x.keep THEN x.g ELSE 0.0 END",
                                 "x": "CASE WHEN x.keep THEN x.x ELSE 0.0 END"}),
]


@query(
    q.with_parts(
        MIXED_SQL,
        f"""SELECT matrix_id, {q.r('sqrt(sum((x - 0.5 * a - 0.3 * b) ** 2)) / greatest(sqrt(sum(x * x)), 1e-8::DOUBLE)')} AS residual
FROM back GROUP BY matrix_id""",
    )
)
def check_linearity(spark, sf_dir):
    """Projecting a mix of two matrices against mixing their projections: relative residual, about 0."""
    dense = weighted_sum(inputs.supplier_months(spark, sf_dir), "vals", "grad", 0.5, 0.3, "mix")
    dense = dct2d(dense, c="vals", g="grad", x="mix")
    kept = selection.select_energy(selection.energy_profile(dense, c="c"), TAU).select(
        ID, "n_rows", "n_cols",
        *[projection.kept(source).alias(name) for name, source in (("a", "c"), ("b", "g"), ("x", "x"))],
    )
    back = idct2d(kept, a="a", b="b", x="x")
    off = F.col("x") - F.lit(0.5) * F.col("a") - F.lit(0.3) * F.col("b")
    size = F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x"))), F.lit(score.NORM_FLOOR))
    return cells(back, a="a", b="b", x="x").groupBy(ID).agg(
        tidy(F.sqrt(F.sum(off * off)) / size).alias("residual")
    )


@query(
    q.with_parts(
        [*PROJECTED_SQL, "again AS (SELECT matrix_id, m, n, i, j, p AS v FROM back)", *q.forward("again", "twice", {"d": "v"})],
        f"""SELECT matrix_id, {q.r('sqrt(sum(CASE WHEN keep THEN t.d * t.d ELSE 0.0 END)) / greatest(sqrt(sum(CASE WHEN keep THEN c * c ELSE 0.0 END)), 1e-12::DOUBLE)')} AS ratio
FROM sel JOIN twice t USING (matrix_id, k, l) GROUP BY matrix_id""",
    )
)
def check_isometry(spark, sf_dir):
    """Norm of the kept coefficients after a projection against before: about 1."""
    marked = strips.select_energy(ranked_segments(inputs.embedding_rows(spark, sf_dir)), TAU)
    projected = strips.inverse(strips.keep_only(marked))
    again = strips.forward(projected.withColumnRenamed("i", "at")).select(ID, "k0", "l0", F.col("coef").alias("again"))
    met = marked.select(ID, "k0", "l0", "coef", "keep").join(again, [ID, "k0", "l0"])

    def norm(x):
        inside = F.zip_with(x, "keep", lambda c, k: F.when(k, c * c).otherwise(0.0))
        return F.sqrt(F.sum(F.aggregate(inside, F.lit(0.0), lambda acc, c: acc + c)))

    return met.groupBy(ID).agg(tidy(norm("again") / F.greatest(norm("coef"), F.lit(1e-12))).alias("ratio"))
