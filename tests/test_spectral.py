"""Properties and edge cases of matrices, transforms, selections and projections."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import basis, cells, dct, dense_of, matrix_from, places, rows_of
from wavemill.functions import cosine
from wavemill.operators import projection, score, selection
from wavemill.operators.matrix import (
    crop, dense_from_cells, dense_from_facts, dense_from_rows, dense_from_vectors, tile, tile_rows,
)
from wavemill.operators.transform import coefficients, dct2d, dct2d_rows, dct_axis, idct2d, idct2d_cells

RNG = np.random.default_rng(7)
SHAPES = {"one": (1, 1), "row": (1, 9), "col": (6, 1), "wide": (3, 12), "tall": (12, 3), "square": (8, 8)}
MATRICES = {n: RNG.standard_normal(s) for n, s in SHAPES.items()} | {
    "zero": np.zeros((4, 5)), "flat": np.full((4, 4), 3.0), "other": RNG.standard_normal((8, 8)),
}


@pytest.fixture(scope="module")
def dense(spark):
    return dense_of(spark, MATRICES).cache()


@pytest.fixture(scope="module")
def profile(dense):
    return selection.energy_profile(dct2d(dense, coef="vals")).cache()


def test_forward_matches_definition_and_inverts(dense):
    done = idct2d(dct2d(dense, coef="vals"), back="coef")
    got, back = matrix_from(done, "coef"), matrix_from(done, "back")
    for name, m in MATRICES.items():
        assert np.allclose(got[name], dct(m), atol=1e-12)
        assert np.allclose(back[name], m, atol=1e-12)
        assert np.isclose((got[name] ** 2).sum(), (m**2).sum())


@pytest.mark.parametrize("size", [1, 2, 7, 255, 256, 257, 300, 1025])
def test_long_axes_use_the_same_transform(size):
    x = RNG.standard_normal((2, size))
    assert np.allclose(cosine.forward_last(x), x @ basis(size).T, atol=1e-10)
    assert np.allclose(cosine.inverse_last(cosine.forward_last(x)), x, atol=1e-10)


def test_strips_equal_whole(spark):
    m = {"a": RNG.standard_normal((300, 21)), "b": RNG.standard_normal((5, 7))}
    got = {(r.matrix_id, r.k, r.l): r.c for r in dct2d_rows(rows_of(spark, m), width=4).collect()}
    for name, x in m.items():
        want = dct(x)
        assert all(np.isclose(got[name, k, l], want[k, l], atol=1e-10) for k in range(len(x)) for l in range(x.shape[1]))
    assert len(got) == sum(x.size for x in m.values())


def test_strips_refuse_what_they_cannot_hold(spark):
    with pytest.raises(Exception, match="tile_rows"):
        dct2d_rows(rows_of(spark, {"a": np.ones((5, 2))}), max_rows=4).collect()


def test_axis_transform(spark):
    x = RNG.standard_normal((4, 3, 2))
    rows = [(i, j, k, float(x[i, j, k])) for i in range(4) for j in range(3) for k in range(2)]
    table = spark.createDataFrame(rows, "layer int, head int, j int, v double")
    want = np.einsum("kl,lhj->khj", basis(4), x)
    for r in dct_axis(table, "layer").collect():
        assert np.isclose(r.v, want[r.layer, r.head, r.j])


@pytest.mark.parametrize("size", [None, 5, 7])
def test_axis_transform_takes_missing_cells_as_zero(spark, size):
    lines = {0: {0: 1.0, 2: 1.0}, 1: {0: 3.0, 1: 2.0, 2: 1.0, 3: 4.0, 4: 5.0}, 2: {4: 2.0}, 3: {1: None, 3: 6.0}}
    rows = [(i, h, v) for h, line in lines.items() for i, v in line.items()]
    table = spark.createDataFrame(rows, "layer int, head int, v double").repartition(3)
    got = dct_axis(table, "layer", size=size).collect()
    extent = size or 5
    assert len(got) == 4 * extent
    for r in got:
        x = np.array([lines[r.head].get(i) or 0.0 for i in range(extent)])
        assert np.isclose(r.v, (basis(extent) @ x)[r.layer])
    with pytest.raises(Exception, match="beyond 4"):
        dct_axis(table, "layer", size=4).collect()


def test_selection_by_energy(profile):
    got = places(selection.select_energy(profile, 0.85))
    for name, m in MATRICES.items():
        if name in ("flat", "zero"):
            continue
        share = (dct(m) ** 2 / ((m**2).sum() + 1e-12)).ravel()
        order = np.argsort(-share, kind="stable")
        kept = order[np.cumsum(share[order]) <= 0.85 * share.sum()]
        assert got.get(name, set()) == {(p // m.shape[1], p % m.shape[1]) for p in kept}
    # One dominant coefficient: nothing stays below the threshold. All zero: everything does.
    assert "flat" not in got and "one" not in got
    assert len(got["zero"]) == 20


def cell_places(marked):
    out = {}
    for r in marked.where("keep").select("matrix_id", "k", "l").collect():
        out.setdefault(r.matrix_id, set()).add((r.k, r.l))
    return out


def test_cells_of_any_size_are_selected_alike(profile):
    kept = profile.where(F.col("matrix_id") != "flat")
    table = coefficients(kept, c="coef", share="share", g="coef")
    # At tau = 1 two sums of the same numbers in different order are compared; the integer case below covers it.
    for tau in (0.3, 0.85, 0.99):
        assert cell_places(selection.select_energy_cells(table, tau, bits=3)) == places(selection.select_energy(kept, tau))
    for fraction in (0.01, 0.25, 1.0):
        want = places(selection.select_gradient(kept, fraction, "coef"))
        assert cell_places(selection.select_gradient_cells(table, fraction, bits=2)) == want


def test_ties_are_taken_by_position(spark):
    """Integer shares with many ties: the order among equals is (k, l)."""
    shares = [float(1 + p % 2) for p in range(100)]
    dense = spark.createDataFrame([("t", 10, 10, shares)], "matrix_id string, n_rows int, n_cols int, share array<double>")
    table = coefficients(dense, share="share")
    order = sorted(range(100), key=lambda p: (-shares[p], p))
    for tau in (0.5, 0.8, 0.98, 1.0):
        kept = {divmod(p, 10) for p, run in zip(order, np.cumsum([shares[p] for p in order])) if run <= tau * 150}
        assert places(selection.select_energy(dense, tau))["t"] == kept
        assert cell_places(selection.select_energy_cells(table, tau))["t"] == kept


def test_cell_profile_is_the_same(profile):
    table = coefficients(profile, c="coef", share="share")
    again = selection.cell_profile(table.drop("share"), out="b").join(table, ["matrix_id", "k", "l"])
    assert again.count() == table.count()
    assert again.where(F.abs(F.col("share") - F.col("b")) > 1e-12).count() == 0


def test_energy_grows_with_tau(profile):
    small, large = (places(selection.select_energy(profile, t)) for t in (0.5, 0.9))
    assert all(s <= large[n] for n, s in small.items())


def test_gradient_count_and_combinations(spark):
    names = ["square", "wide", "one"]
    grads = {n: RNG.standard_normal(SHAPES[n]) for n in names}
    dense = dense_of(spark, {n: MATRICES[n] for n in names}, grad=grads)
    coef = selection.energy_profile(dct2d(dense, coef="vals", gcoef="grad")).cache()
    by_gradient = places(selection.select(coef, "gradient"))
    assert {n: len(p) for n, p in by_gradient.items()} == {"square": 16, "wide": 9, "one": 1}
    by_energy = places(selection.select(coef, "energy-only", tau=0.85))
    both = places(selection.select(coef, tau=0.85))
    either = places(selection.select(coef, combine="or", tau=0.85))
    for n in names:
        assert both.get(n, set()) == by_energy.get(n, set()) & by_gradient[n]
        assert either[n] == by_energy.get(n, set()) | by_gradient[n]


def test_unknown_names_raise(profile):
    with pytest.raises(ValueError):
        selection.select(profile, "loudest")
    with pytest.raises(ValueError):
        selection.select(profile.withColumn("gcoef", F.col("coef")), combine="xor")


def test_cluster_is_the_largest_cell_of_a_partition(spark):
    dense = dense_of(spark, {"a": RNG.standard_normal((8, 10)), "b": np.ones((8, 10)), "c": [[1.0]]})
    got = places(selection.select_cluster(dct2d(dense), clusters=4, starts=3))
    # Coordinates are the only features, so matrices of one shape agree.
    assert got["a"] == got["b"] and len(got["a"]) >= 80 / 4
    assert got["c"] == {(0, 0)}
    centre = np.mean(list(got["a"]), axis=0)
    spread = max(np.hypot(*(np.array(p) - centre)) for p in got["a"])
    assert spread < np.hypot(8, 10) / 2


def test_mask_algebra(spark):
    schema = "matrix_id string, k int, l int"
    a = spark.createDataFrame([("m", 0, 0), ("m", 0, 1), ("n", 1, 1)], schema)
    b = spark.createDataFrame([("m", 0, 1), ("m", 2, 2)], schema)

    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    assert rows(selection.mask_and(a, b)) == [("m", 0, 1)]
    assert rows(selection.mask_or(a, b)) == [("m", 0, 0), ("m", 0, 1), ("m", 2, 2), ("n", 1, 1)]
    assert rows(selection.mask_and_not(a, b)) == [("m", 0, 0), ("n", 1, 1)]


def test_full_mask_is_identity_and_blend(profile):
    every = profile.withColumn("keep", F.transform("coef", lambda x: F.lit(True)))
    assert all(np.allclose(p, MATRICES[n], atol=1e-12) for n, p in matrix_from(projection.project(every), "projected").items())
    kept = selection.select_energy(profile, 0.6)
    projected = matrix_from(projection.project(kept), "projected")
    blended = {(r.matrix_id, r.i, r.j): r.blended for r in projection.spectral_blend(kept).collect()}
    for name, m in MATRICES.items():
        share = dct(m) ** 2 / ((m**2).sum() + 1e-12)
        want = projected[name] * share + m * (1 - share)
        assert all(np.isclose(blended[name, i, j], want[i, j]) for i in range(m.shape[0]) for j in range(m.shape[1]))


def test_progressive_levels(profile):
    masks = selection.select_energy(selection.select_energy(profile, 0.9, out="full"), 0.4, out="low")
    got = {}
    for r in projection.progressive(masks).where("matrix_id = 'square'").collect():
        got[r.level, r.i, r.j] = r.value
    full = matrix_from(projection.project(masks, keep="full"), "projected")["square"]
    low = matrix_from(projection.project(masks, keep="low"), "projected")["square"]
    m = MATRICES["square"]
    share = dct(m) ** 2 / (m**2).sum()
    second = full * share + m * (1 - share)
    want = {"L1": low * share + m * (1 - share), "L2": second, "L3": second + 0.1 * (full - low)}
    for level, w in want.items():
        assert all(np.isclose(got[level, i, j], w[i, j]) for i in range(8) for j in range(8))


def test_scores(spark):
    v = {"a": [[3.0, 4.0]], "zero": [[0.0, 0.0]], "nan": [[1.0, 1.0]], "far": [[1.0, 0.0]]}
    w = {"a": [[3.0, 0.0]], "zero": [[0.0, 0.0]], "nan": [[float("nan"), 1.0]], "far": [[-9.0, 5.0]]}
    table = cells(dense_of(spark, v, w=w), v="vals", w="w")
    got = {r.matrix_id: r.f for r in table.groupBy("matrix_id").agg(score.fidelity(F.col("v"), F.col("w")).alias("f")).collect()}
    assert np.isclose(got["a"], 1 - 4 / 5)
    assert got["zero"] == 1.0 and got["far"] == 0.0
    assert np.isclose(got["nan"], 1 - 1 / np.sqrt(2))


def test_empty_mask_ratio_has_a_floor(spark):
    table = spark.range(5000).select(F.lit(False).alias("keep"), F.lit(2.0).alias("c"))
    row = table.agg(
        score.compression_ratio(F.col("keep")).alias("ratio"),
        score.kept_count(F.col("keep")).alias("kept"),
        score.retained_energy(F.col("c"), F.col("keep")).alias("retained"),
    ).first()
    assert np.isclose(row.ratio, 1000.0) and row.kept == 0 and row.retained == 0.0


def test_nan_cell_keeps_nothing_and_scores_zero(spark):
    dense = dense_of(spark, {"bad": [[1.0, float("nan")], [2.0, 3.0]]})
    prof = selection.energy_profile(dct2d(dense))
    assert places(selection.select_energy(prof)) == {}
    assert cell_places(selection.select_energy_cells(coefficients(prof, share="share"))) == {}
    kept = coefficients(selection.select_energy(prof), c="coef", keep="keep")
    assert kept.agg(score.retained_energy(F.col("c"), F.col("keep")).alias("r")).first().r == 0.0


def test_missing_cell_counts_as_zero(spark):
    schema = "matrix_id string, i int, j int, v double"
    a = spark.createDataFrame([("m", 0, 0, 3.0), ("m", 0, 1, 4.0)], schema)
    b = spark.createDataFrame([("m", 0, 0, 3.0)], schema)
    pairs = score.pair_cells(a, b)
    assert np.isclose(pairs.agg(score.fidelity(F.col("v"), F.col("approx")).alias("f")).first().f, 0.2)


def test_facts_fill_the_grid(spark):
    facts = spark.createDataFrame([(1, 0, 0, 2.0), (1, 0, 0, 3.0), (1, 1, 2, 7.0), (2, 0, 1, None)],
                                  "id int, i int, j int, v double")
    dense = dense_from_facts(facts, F.col("id"), F.col("i"), F.col("j"), 2, 3, vals=F.col("v"))
    got = matrix_from(dense, "vals")
    assert got["1"].tolist() == [[5.0, 0.0, 0.0], [0.0, 0.0, 7.0]]
    assert got["2"].tolist() == [[0.0] * 3] * 2
    with pytest.raises(Exception, match="outside"):
        dense_from_facts(facts, F.col("id"), F.col("i"), F.col("j"), 2, 2, vals=F.col("v")).collect()


def test_vectors_keep_key_order_and_tile(spark):
    """One label holds most rows; keys are far apart, so ranks cross many buckets."""
    ids = [int(x) for x in RNG.choice(2**40, 200, replace=False)]
    rows = [(k, "hot" if n % 10 else "cold", [float(k % 97), float(n)]) for n, k in enumerate(ids)]
    df = spark.createDataFrame(rows, "id bigint, label string, vec array<double>")
    got = matrix_from(dense_from_vectors(df, "label", "id", "vec", height=64), "vals")
    for label in ("hot", "cold"):
        want = np.array([v for _, l, v in sorted(rows) if l == label])
        bands = [got[f"{label}/{b}"] for b in range((len(want) + 63) // 64)]
        assert np.array_equal(np.concatenate(bands), want)


def test_crop_and_tile(spark):
    m = np.arange(35.0).reshape(5, 7)
    table = cells(dense_of(spark, {"m": m}), v="vals")
    assert np.array_equal(matrix_from(dense_from_cells(crop(table, 3, 4), vals="v"), "vals")["m"], m[:3, :4])
    assert np.array_equal(matrix_from(dense_from_cells(crop(table, 9, 9), vals="v"), "vals")["m"], m)
    blocks = matrix_from(dense_from_cells(tile(table, 2, 4), vals="v"), "vals")
    assert np.array_equal(np.block([[blocks[f"m/{b}/{s}"] for s in range(2)] for b in range(3)]), m)


def test_rows_tile_and_gather(spark):
    m = RNG.standard_normal((10, 3))
    got = matrix_from(dense_from_rows(tile_rows(rows_of(spark, {"m": m}), 4)), "vals")
    assert np.array_equal(np.concatenate([got[f"m/{b}"] for b in range(3)]), m)


def test_tensor_projection(spark):
    x = RNG.standard_normal((4, 3, 2, 5))
    rows = [("t", *map(int, p), float(x[p])) for p in np.ndindex(x.shape)]
    tensor = spark.createDataFrame(rows, "matrix_id string, layer int, head int, i int, j int, v double")
    gamma = RNG.random((2, 5))
    prof = spark.createDataFrame([(k, l, float(gamma[k, l])) for k, l in np.ndindex(2, 5)], "k int, l int, share double")
    y = np.einsum("ab,bhij->ahij", basis(4), x)[:2]
    y = np.einsum("gh,ahij->agij", basis(3), y)[:, :2]
    want = np.einsum("ki,agkl,lj->agij", basis(2), gamma * np.einsum("ki,agij,lj->agkl", basis(2), y, basis(5)), basis(5))
    got = projection.tensor_project(tensor, prof, 2, 2).collect()
    assert len(got) == want.size
    assert all(np.isclose(r.v, want[r.layer, r.head, r.i, r.j]) for r in got)


def test_missing_cells_are_zero_and_stay_in_their_record(spark):
    from wavemill.operators.matrix import dense_from_cells, dense_from_rows

    cells = [("a", 2, 2, 0, 0, 1.0), ("a", 2, 2, 1, 0, 1.0), ("a", 2, 2, 0, 1, 1.0)] + [("b", 2, 2, i, j, 10.0) for i in (0, 1) for j in (0, 1)]
    table = spark.createDataFrame(cells, "matrix_id string, n_rows int, n_cols int, i int, j int, v double")
    got = {r.matrix_id: r.v for r in dense_from_cells(table, v="v").collect()}
    assert got == {"a": [1.0, 1.0, 1.0, 0.0], "b": [10.0] * 4}
    ragged = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, [3.0])], "matrix_id string, i bigint, row array<double>")
    with pytest.raises(Exception, match="differ in length"):
        dense_from_rows(ragged).collect()


def embeddings_of(spark, folder, heights, width=4):
    """An embeddings table with so many vectors a label; the matrices by label, rows in the order of vec_id."""
    ids = RNG.permutation(sum(heights.values())).tolist()
    made, rows = {}, []
    for label, height in heights.items():
        own = sorted(ids.pop() for _ in range(height))
        made[label] = np.round(RNG.standard_normal((height, width)) * 8) / 8 + np.linspace(0, 3, height)[:, None].round(2)
        rows += [(k, [float(x) for x in v], label) for k, v in zip(own, made[label])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    df.write.parquet(f"{folder}/embeddings.parquet")
    return str(folder), made


def test_labels_beyond_any_band_are_whole(spark, tmp_path):
    from wavemill.plans.methods import method_comparison
    from wavemill.plans.spectral import energy_by_label, select_energy_cells

    folder, made = embeddings_of(spark, tmp_path, {0: 1100, 1: 2500, 2: 3})
    want = {}
    for label, m in made.items():
        c = dct(m)
        share = np.sort((c * c / ((c * c).sum() + 1e-12)).ravel())[::-1]
        want[label] = (m.size, int((np.cumsum(share) <= 0.85 * share.sum()).sum()))
    got = {r.label: (r.total, r.kept) for r in energy_by_label(spark, folder).collect()}
    assert got == want
    cells_kept = {r.matrix_id: r.n for r in select_energy_cells(spark, folder).groupBy("matrix_id").agg(F.count("*").alias("n")).collect()}
    assert {int(k): v for k, v in cells_kept.items()} == {k: v[1] for k, v in want.items() if v[1]}
    results = method_comparison(spark, folder)
    assert results.groupBy("method", "seed", "metric").count().where("count > 1").count() == 0
    assert results.select("seed").distinct().count() == len(made)


@pytest.mark.parametrize("heights", [{0: 30, 1: 70}, {0: 70, 1: 30}, {0: 1, 1: 9}])
def test_transfer_scores_the_whole_target(spark, tmp_path, heights):
    import duckdb

    from compare import difference
    from wavemill.plans import library

    folder, _ = embeddings_of(spark, tmp_path, heights)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    got = library.queries()["segment_transfer"](spark, folder)
    assert difference(got, con, library.checks()["segment_transfer"]) is None


def test_inverse_by_strips(spark):
    some = {n: m for n, m in MATRICES.items()} | {"long": RNG.standard_normal((1500, 5))}
    coef = dct2d_rows(rows_of(spark, some), width=2)
    back = {}
    for r in idct2d_cells(coef, width=3).collect():
        back.setdefault(r.matrix_id, {})[r.i] = r.row
    for name, m in some.items():
        assert np.allclose([back[name][i] for i in range(len(m))], m)
    hole = coef.where("NOT (matrix_id = 'wide' AND k = 1 AND l = 4)")
    with pytest.raises(Exception, match="missing"):
        idct2d_cells(hole).collect()


def test_record_beyond_the_bound_is_refused(spark, monkeypatch):
    from wavemill.operators import matrix

    monkeypatch.setattr(matrix, "RECORD_VALUES", 29)
    with pytest.raises(Exception, match="functions on rows"):
        dense_from_rows(rows_of(spark, {"m": np.ones((10, 3))})).collect()
    assert dense_from_rows(rows_of(spark, {"m": np.ones((9, 3))})).count() == 1
