"""Block Krylov directions, packed rows and tiled Cholesky factors against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from test_methods import MATRICES, stacked, truncated
from wavemill.operators import blocks, krylov, tiles

RNG = np.random.default_rng(23)
SLOPE = RNG.standard_normal((90, 90)) @ np.diag(0.8 ** np.arange(90)) @ RNG.standard_normal((90, 150))
WIDE = {"slope": SLOPE, "flat": RNG.standard_normal((400, 130)), "zero": np.zeros((5, 70)), "one row": RNG.standard_normal((1, 140))}


@pytest.mark.parametrize("rank", [1, 2, 8])
def test_spanned_matrices_are_exact(spark, rank):
    rows = rows_of(spark, MATRICES).repartition(5)
    got = stacked(krylov.low_rank(rows, rank), "approx")
    for name, m in MATRICES.items():
        assert np.allclose(got[name], truncated(m, rank), atol=1e-8), name


def test_wide_matrices_tell_how_exact_they_are(spark):
    """Beyond passes * (rank + oversample) columns: energies from below, residuals that bound their error."""
    got = {r.matrix_id: r for r in krylov.leading_directions(rows_of(spark, WIDE).repartition(7), 4, passes=5, oversample=6).collect()}
    assert set(got) == set(WIDE)
    for name, m in WIDE.items():
        r = got[name]
        v, held, rests = np.array(r.directions).reshape(4, -1), np.array(r.held), np.array(r.residuals)
        exact = np.linalg.eigvalsh(m.T @ m)[::-1][:4]
        assert np.isclose(r.energy, (m * m).sum())
        assert np.all(held <= exact + 1e-9 * max(exact[0], 1)) and held.sum() >= 0.97 * exact.sum()
        assert np.all(np.min(np.abs(held[:, None] - exact), axis=1) <= rests + 1e-9 * max(exact[0], 1)), name
        real = held > 1e-9
        assert np.allclose((v @ v.T)[np.ix_(real, real)], np.eye(real.sum()), atol=1e-9)
        assert np.allclose(rests, np.linalg.norm(m.T @ (m @ v.T) - v.T * held, axis=0), atol=1e-7 * max(exact[0], 1))
    assert np.allclose(got["slope"].held, np.linalg.eigvalsh(SLOPE.T @ SLOPE)[::-1][:4], rtol=1e-9)


def test_same_directions_again(spark):
    rows = rows_of(spark, {"flat": WIDE["flat"]})
    first, second = (krylov.leading_directions(rows.repartition(n), 3, passes=2).first() for n in (2, 5))
    assert np.allclose(first.directions, second.directions, atol=1e-9)


def test_rows_of_any_kind(spark):
    """NaN counts as 0 in the directions and stays in its row; extra columns pass; no rows give none; odd lengths are told."""
    m = RNG.standard_normal((20, 4))
    m[3, 1] = np.nan
    rows = rows_of(spark, {"m": m}).withColumns({"directions": F.lit("mine"), "n": F.lit(7), "lines": F.lit(None).cast("int")})
    got = krylov.low_rank(rows, 1)
    assert got.columns == [*rows.columns, "approx"]
    lines = {r.i: r for r in got.collect()}
    want = truncated(np.nan_to_num(m), 1)
    assert len(lines) == 20 and all(r.directions == "mine" and r.n == 7 and r.lines is None for r in lines.values())
    assert np.isnan(lines[3].approx).all() and all(np.allclose(lines[i].approx, want[i], atol=1e-8) for i in lines if i != 3)
    assert krylov.low_rank(rows.limit(0), 1).count() == 0
    ragged = rows.unionByName(rows.limit(1).withColumn("row", F.array(F.lit(1.0))))
    with pytest.raises(Exception, match="unequal length"):
        krylov.low_rank(ragged, 1).collect()


def test_pieces_leave_a_full_task(spark, monkeypatch):
    monkeypatch.setattr(krylov, "OPEN_VALUES", 100)
    many = {f"m{n}": RNG.standard_normal((3, 5)) for n in range(40)}
    got = stacked(krylov.low_rank(rows_of(spark, many).repartition(2), 2), "approx")
    assert all(np.allclose(got[n], truncated(m, 2), atol=1e-8) for n, m in many.items())


def test_packed_rows(spark):
    rows = rows_of(spark, MATRICES).repartition(3)
    packed = blocks.packed(rows, 60).cache()
    back = packed.select("matrix_id", F.inline("lines")).select(*rows.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert max(r.n for r in packed.select(F.aggregate("lines", F.lit(0), lambda acc, x: acc + F.size(x["row"])).alias("n")).collect()) < 60 + 8
    assert packed.where("matrix_id = 'tall'").count() < 60


@pytest.mark.parametrize("side", [1, 3, 4, 512])
def test_tiled_cholesky(spark, side):
    got = stacked(tiles.cholesky_rows(rows_of(spark, MATRICES).repartition(5), 1e-6, side))
    assert set(got) == set(MATRICES)
    for name, m in MATRICES.items():
        u = got[name]
        assert u.shape == (m.shape[1], m.shape[1]) and np.allclose(u, np.triu(u))
        assert np.allclose(u.T @ u, m.T @ m + 1e-6 * np.eye(m.shape[1]), atol=1e-9), name


def test_tiles_leave_a_full_task(spark, monkeypatch):
    monkeypatch.setattr(tiles, "OPEN_VALUES", 30)
    m = RNG.standard_normal((60, 23))
    got = stacked(tiles.cholesky_rows(rows_of(spark, {"m": m}).repartition(4), 0.5, 5, width=23))["m"]
    assert np.allclose(got, np.linalg.cholesky(m.T @ m + 0.5 * np.eye(23)).T, atol=1e-9)
    assert tiles.cholesky_rows(rows_of(spark, {"m": m}).limit(0), 0.5, 5).count() == 0
