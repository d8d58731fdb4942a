"""Tall matrices in strips beside numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import cosine
from wavemill.operators import strips
from wavemill.operators.matrix import ID


def frame(spark, matrices):
    rows = [(name, i * 3 - 50, [float(x) for x in r]) for name, m in matrices.items() for i, r in enumerate(m)]
    return strips.vectors_by_key(spark.createDataFrame(rows, "g string, k bigint, v array<double>").repartition(5), "g", "k", "v")


def cases():
    rng = np.random.default_rng(4)
    odd = rng.normal(size=(4, 5))
    odd[1, 2] = np.nan
    ties = np.zeros((6, 7))
    ties[0, :] = 2.0
    return {
        "a": rng.normal(size=(37, 20)), "one": np.array([[3.0]]), "flat": np.full((9, 11), 2.5), "zero": np.zeros((5, 4)),
        "tall": rng.normal(size=(300, 3)), "wide": rng.normal(size=(2, 50)), "nan": odd, "ties": cosine.inverse_2d(ties[None])[0],
    }


def coefficients(m):
    return cosine.forward_2d(np.asarray(m)[None])[0]


def expected_energy(c, tau):
    e = (c * c).ravel()
    if np.isnan(e).any():
        return np.zeros(len(e), bool)
    order = np.lexsort((np.arange(len(e)), -e))
    keep = np.zeros(len(e), bool)
    keep[order] = np.cumsum(e[order]) <= tau * e.sum()
    return keep


@pytest.fixture
def small_segments(monkeypatch):
    monkeypatch.setattr(strips, "SEGMENT_VALUES", 40)


@pytest.mark.parametrize("width", [1, 8, 64])
def test_forward_and_inverse(spark, small_segments, width):
    matrices = {n: m for n, m in cases().items() if n != "nan"}
    segments = strips.forward(frame(spark, matrices), width)
    got = {(r[ID], r.k, r.l): r.c for r in strips.coefficient_cells(segments).collect()}
    for name, m in matrices.items():
        want = coefficients(m)
        assert np.allclose([[got[name, k, l] for l in range(m.shape[1])] for k in range(m.shape[0])], want, atol=1e-9)
    back = {(r[ID], r.i): r.row for r in strips.inverse(segments).collect()}
    for name, m in matrices.items():
        assert np.allclose([back[name, i] for i in range(len(m))], m, atol=1e-9)


def integral(spark, matrices):
    """Segments with given coefficients, in strips of 3 columns and segments of at most 4 rows."""
    rows = []
    for name, c in matrices.items():
        n, m = c.shape
        for l0 in range(0, m, 3):
            for k0 in range(0, n, 4):
                part = c[k0 : k0 + 4, l0 : l0 + 3]
                rows.append((name, n, m, k0, 1, l0, part.shape[1], [float(x) for x in part.ravel()]))
    return spark.createDataFrame(rows, strips.SEGMENT)


@pytest.mark.parametrize("near", [1 << 16, 2])
def test_selections_are_exact_with_ties(spark, monkeypatch, near):
    monkeypatch.setattr(strips, "NEAR", near)
    rng = np.random.default_rng(8)
    matrices = {f"m{n}": rng.integers(-3, 4, size=(rng.integers(1, 12), rng.integers(1, 12))).astype(float) for n in range(12)}
    matrices |= {"flat": np.full((9, 11), 2.0), "zero": np.zeros((5, 4)), "one": np.array([[7.0]]), "close": 1000 + np.arange(60.0).reshape(6, 10) * 1e-9}
    matrices["nan"] = np.array([[1.0, np.nan], [2.0, 3.0]])
    segments = integral(spark, matrices)
    for tau in (0.0, 0.85):
        marked = strips.select_energy(segments, tau)
        got = {(r[ID], r.k, r.l): r.keep for r in strips.coefficient_cells(marked, keep="keep").collect()}
        for name, c in matrices.items():
            have = np.array([[got[name, k, l] for l in range(c.shape[1])] for k in range(c.shape[0])])
            assert np.array_equal(have.ravel(), expected_energy(c, tau)), (name, tau)
        totals = {r[ID]: r for r in strips.retained(marked).collect()}
        assert totals["flat"].total == 99 and totals["flat"].kept == int(expected_energy(matrices["flat"], tau).sum())
    marked = strips.select_largest(segments, strips.fraction_count(0.25))
    got = {(r[ID], r.k, r.l): r.keep for r in strips.coefficient_cells(marked, keep="keep").collect()}
    for name, c in matrices.items():
        if name == "nan":
            continue
        flat = np.abs(c).ravel()
        order = np.lexsort((np.arange(len(flat)), -flat))[: max(1, int(0.25 * len(flat)))]
        assert {(k * c.shape[1] + l) for (n, k, l), keep in got.items() if n == name and keep} == set(order.tolist()), name


def test_projection_onto_a_selection(spark, small_segments):
    m = cases()["a"]
    marked = strips.select_energy(strips.forward(frame(spark, {"a": m})), 0.6)
    back = {r.i: r.row for r in strips.inverse(strips.keep_only(marked)).collect()}
    c = coefficients(m)
    want = cosine.inverse_2d((c * expected_energy(c, 0.6).reshape(c.shape))[None])[0]
    assert np.allclose([back[i] for i in range(len(m))], want, atol=1e-9)


def test_unequal_rows_are_an_error(spark):
    rows = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("a", 2, [1.0])], "g string, k bigint, v array<double>")
    with pytest.raises(Exception, match="unequal"):
        strips.forward(strips.vectors_by_key(rows, "g", "k", "v")).collect()


def test_a_label_of_200000_vectors(spark):
    """Beyond any record: 12.8 million values. One cosine a column, so the selection is known."""
    n, m = 200_000, 64
    k = F.col("id")
    value = lambda j: F.cos(F.lit(np.pi / (2 * n)) * (2 * k + 1) * (j + 1)) * (m - j)
    rows = spark.range(n).select(F.lit("x").alias("g"), k, F.array(*[value(j) for j in range(m)]).alias("v"))
    segments = strips.written_segments(strips.vectors_by_key(rows, "g", "id", "v"))
    assert segments.agg(F.max(F.size("coef"))).first()[0] <= strips.SEGMENT_VALUES
    got = strips.retained(strips.select_energy(segments, 0.9)).first()
    # Row k = j + 1 holds (m - j) times sqrt(n / 2) times column j's row of the basis: its energy is that of the values.
    basis = cosine.basis(m)
    energy = np.sort(((np.arange(m, 0, -1)[:, None] * basis.T) ** 2).ravel() * n / 2)[::-1]
    kept = int((np.cumsum(energy) <= 0.9 * energy.sum()).sum())
    assert got.total == n * m and abs(got.kept - kept) <= 2 and abs(got.retained - energy[:kept].sum() / energy.sum()) < 1e-3
