"""Columns in parts beside numpy, with factors and as convolutions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from wavemill.functions import cosine
from wavemill.operators import columns, strips
from wavemill.operators.matrix import ID


def matrices():
    rng = np.random.default_rng(11)
    heights = {"one": 1, "two": 2, "prime": 97, "composite": 360, "square": 49, "twice": 62, "three": 3}
    return {n: rng.normal(size=(h, 5)) for n, h in heights.items()} | {"wide": rng.normal(size=(12, 23))}


def test_factors():
    assert columns.factors(360, 20) == (18, 20, False) and columns.factors(1, 20) == (1, 1, False)
    a, b, chirp = columns.factors(97, 20)
    assert chirp and a == b and a * a >= 2 * 97 - 1 and (a - 1) ** 2 < 2 * 97 - 1


@pytest.mark.parametrize("width,limit", [(4, 20), (64, 1 << 20), (64, 1)])
def test_forward_and_inverse(spark, monkeypatch, width, limit):
    """Below the limit a length is factored, above it (97 and 62 at 20; all but 1 at 1) it is a convolution."""
    monkeypatch.setattr(strips, "SEGMENT_VALUES", 40)
    held = matrices()
    segments = columns.forward(rows_of(spark, held).repartition(5), width, limit)
    got = {(r[ID], r.k, r.l): r.c for r in strips.coefficient_cells(segments).collect()}
    assert len(got) == sum(m.size for m in held.values())
    for name, m in held.items():
        want = cosine.forward_2d(m[None])[0]
        assert np.allclose([[got[name, k, l] for l in range(m.shape[1])] for k in range(m.shape[0])], want, atol=1e-9), name
    back = {(r[ID], r.i): r.row for r in columns.inverse(segments, limit).collect()}
    for name, m in held.items():
        assert np.allclose([back[name, i] for i in range(len(m))], m, atol=1e-9), name


def test_selection_on_interleaved_segments(spark):
    m = matrices()["composite"]
    marked = strips.select_energy(columns.forward(rows_of(spark, {"x": m})), 0.6)
    c = cosine.forward_2d(m[None])[0]
    order = np.argsort(-(c * c).ravel(), kind="stable")
    wanted = set(order[: (np.cumsum((c * c).ravel()[order]) <= 0.6 * (c * c).sum()).sum()].tolist())
    kept = strips.coefficient_cells(marked, keep="keep").where("keep").collect()
    assert {r.k * m.shape[1] + r.l for r in kept} == wanted
    back = {r.i: r.row for r in columns.inverse(strips.keep_only(marked)).collect()}
    mask = np.isin(np.arange(c.size), list(wanted)).reshape(c.shape)
    assert np.allclose([back[i] for i in range(len(m))], cosine.inverse_2d((c * mask)[None])[0], atol=1e-9)


@pytest.mark.parametrize("rows,message", [
    ([("a", 0, [1.0]), ("a", 2, [1.0])], "positions"), ([("a", 0, [1.0]), ("a", 1, [1.0, 2.0])], "unequal"),
])
def test_faulty_rows_are_errors(spark, rows, message):
    with pytest.raises(Exception, match=message):
        columns.forward(spark.createDataFrame(rows, f"{ID} string, i bigint, row array<double>")).collect()


@pytest.mark.parametrize("height", [50_000, 50_021])
def test_long_columns(spark, height):
    """A factored and a prime height, the latter as a convolution: one cosine a column, so all is known."""
    k = F.col("id")
    value = lambda j: F.cos(F.lit(np.pi / (2 * height)) * (2 * k + 1) * (3 * j + 1))
    rows = spark.range(height).select(F.lit("x").alias(ID), k.alias("i"), F.array(*[value(j) for j in range(3)]).alias("row"))
    segments = columns.forward(rows, limit=1000)
    longest = segments.agg(F.max(F.size("coef") / F.col("width"))).first()[0]
    assert longest <= 1000
    cells = strips.coefficient_cells(segments).where(F.abs("c") > 1e-6).collect()
    got = {(r.k, r.l): r.c for r in cells}
    want = {(3 * j + 1, l): cosine.basis(3)[l, j] * np.sqrt(height / 2) for j in range(3) for l in range(3)}
    want = {p: v for p, v in want.items() if abs(v) > 1e-6}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-6 for p in want)
