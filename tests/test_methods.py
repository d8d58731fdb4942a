"""Factors, low rank, rounding and adapter counts against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import cells, dense_of, rows_of
from wavemill.operators import approx, catalog, factor

RNG = np.random.default_rng(11)
RANK_TWO = RNG.standard_normal((40, 2)) @ RNG.standard_normal((2, 5))
MATRICES = {
    "tall": RNG.standard_normal((500, 6)), "square": RNG.standard_normal((6, 6)), "wide": RNG.standard_normal((3, 8)),
    "one": np.array([[2.5]]), "thin": RNG.standard_normal((30, 1)), "deficient": RANK_TWO,
}


@pytest.fixture(scope="module")
def rows(spark):
    """Rows in shuffled order over several partitions, so every matrix is split."""
    return rows_of(spark, MATRICES).repartition(5).cache()


def stacked(rows, column="row"):
    out = {}
    for r in rows.collect():
        out.setdefault(r.matrix_id, []).append((r.i, r[column]))
    return {n: np.array([x for _, x in sorted(v)]) for n, v in out.items()}


def test_qr_gives_the_gram_matrix_back(rows):
    got = stacked(factor.qr_r(rows))
    for name, m in MATRICES.items():
        r = got[name]
        assert np.allclose(r.T @ r, m.T @ m, atol=1e-9), name
        assert np.allclose(r, np.triu(r))
        if name in ("tall", "square", "thin", "one"):
            assert np.allclose(np.abs(r), np.abs(np.linalg.qr(m, mode="r")), atol=1e-9)


def test_many_matrices_in_one_task(spark, monkeypatch):
    """More matrices than a task keeps open at a time, and more rounds than pieces."""
    monkeypatch.setattr(factor, "OPEN_VALUES", 64)
    many = {f"m{n}": RNG.standard_normal((4, 3)) for n in range(150)}
    got = stacked(factor.qr_r(rows_of(spark, many).repartition(1)))
    assert all(np.allclose(got[n].T @ got[n], m.T @ m) for n, m in many.items())


def test_gram_and_cholesky(rows):
    got = {(r.matrix_id, r.i, r.j): r.v for r in factor.gram(rows).collect()}
    for name, m in MATRICES.items():
        want = m.T @ m
        assert all(np.isclose(got[name, i, j], want[i, j], atol=1e-9) for i, j in np.ndindex(want.shape))
    for r in factor.cholesky_r(rows).collect():
        u, m = np.array(r.factor).reshape(r.n_rows, r.n_cols), MATRICES[r.matrix_id]
        assert np.allclose(u, np.triu(u))
        assert np.allclose(u.T @ u, m.T @ m + 1e-6 * np.eye(m.shape[1]), atol=1e-9)


def test_rows_by_factor_norm(rows):
    got = {}
    for r in factor.select_qr_rows(rows, 0.5).collect():
        got.setdefault(r.matrix_id, set()).add((r.k, r.l))
    for name in ("tall", "square", "one", "thin"):
        m = MATRICES[name]
        norms = np.zeros(len(m))
        r = np.linalg.qr(m, mode="r")
        norms[: len(r)] = np.linalg.norm(r, axis=1)
        top = np.argsort(-norms, kind="stable")[: max(1, len(m) // 2)]
        assert got[name] == {(int(k), l) for k in top for l in range(m.shape[1])}, name


def truncated(m, rank):
    u, s, v = np.linalg.svd(m, full_matrices=False)
    return (u[:, :rank] * s[:rank]) @ v[:rank]


@pytest.mark.parametrize("rank", [1, 2, 8])
def test_low_rank(rows, rank):
    got = stacked(factor.low_rank(rows, rank), "approx")
    for name, m in MATRICES.items():
        assert np.allclose(got[name], truncated(m, rank), atol=1e-8), name


def weight_of(m):
    x = np.arange(m.shape[0])[:, None] / max(m.shape[0] - 1, 1)
    y = np.arange(m.shape[1])[None, :] / max(m.shape[1] - 1, 1)
    return 0.5 + 0.5 * np.cos(np.pi * (x + y))


def test_cosine_low_rank(rows):
    for blend, floor in ((True, 0.3), (False, 0.01)):
        got = stacked(approx.cosine_low_rank(rows, 2, blend), "approx")
        for name, m in MATRICES.items():
            w = weight_of(m)
            divided = truncated(m * w, 2) / np.maximum(w, floor)
            want = w**2 * divided + (1 - w**2) * m if blend else divided
            assert np.allclose(got[name], want, atol=1e-7), (name, blend)


def test_rounding(spark):
    m = {"a": [[7.0, -3.5, 2.5, 0.4]], "zero": [[0.0, 1e-9]], "one": [[-2.0]]}
    got = {}
    for r in approx.quantize(cells(dense_of(spark, m), v="vals")).collect():
        got.setdefault(r.matrix_id, {})[r.j] = r.approx
    # Halves go to the even step.
    assert got["a"] == {0: 7.0, 1: -4.0, 2: 2.0, 3: 0.0}
    assert got["zero"] == {0: None, 1: None}
    assert got["one"] == {0: -2.0}


def test_rounding_per_block(spark):
    m = {"a": [[7.0, 3.4, 0.7, 0.3]]}
    table = cells(dense_of(spark, m), v="vals").withColumn("block", F.floor(F.col("j") / 2))
    got = {r.j: r.approx for r in approx.quantize(table, scope=("matrix_id", "block")).collect()}
    assert np.allclose([got[j] for j in range(4)], [7.0, 3.0, 0.7, 0.3])


def test_topk_sizes(spark):
    shapes = [(50, 64), (12, 7), (1, 1)]
    df = spark.createDataFrame(shapes, "n_rows int, n_cols int")
    got = df.select(approx.parameter_count().alias("a"), approx.parameter_count(0.08).alias("b")).collect()
    assert [tuple(r) for r in got] == [(912, 256), (84, 6), (1, 1)]


def catalog_of(spark):
    rows = [("a.q", "a.q", "a", 0, 2, 10, 4, 4), ("a.v", "a.v", "a", 1, 2, 3, 4, 4), ("b.q", "b.q", "b", 2, 1, 5, 1, 4)]
    return spark.createDataFrame(
        rows, "matrix_id string, name string, kind string, ord int, n_dims int, n_rows int, n_cols int, bytes_per_value int"
    )


def names(df):
    return sorted(r.name for r in df.collect())


def test_catalog_choice(spark):
    entries = catalog_of(spark)
    assert names(catalog.select_named(entries, ["q"])) == ["a.q"]
    assert names(catalog.select_named_or_small(entries, ["q"], 5)) == ["a.q"]
    assert names(catalog.select_named_or_small(entries, ["zzz"], 5)) == ["a.v"]
    assert names(catalog.first_entries(entries, 2)) == ["a.q", "a.v"]
    assert names(catalog.first_entries_by(entries, "kind", 1)) == ["a.q", "b.q"]


def test_adapter_counts(spark):
    row = approx.adapter_ratio(catalog_of(spark), F.col("n_dims") == 2, 2).first()
    assert row.trainable == 2 * (14 + 7) and row.total == 40 + 12 + 5 + 42
    none = approx.adapter_ratio(catalog_of(spark), F.lit(False), 2).first()
    assert none.trainable == 0 and none.ratio == 0.0
