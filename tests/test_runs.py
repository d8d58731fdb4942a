"""Masks as runs beside sets of places."""

import numpy as np
import pytest

from wavemill.operators import runs
from wavemill.operators.matrix import ID


def held(table):
    out = {}
    for r in table.collect():
        assert r.first <= r.last and r.first >> runs.BITS == r.block == r.last >> runs.BITS
        out.setdefault(r[ID], []).append((r.first, r.last))
    for name, ends in out.items():
        ends.sort()
        # Runs neither overlap nor touch, but at the border of a block.
        assert all(b[0] > a[1] + 1 or b[0] >> runs.BITS > a[1] >> runs.BITS for a, b in zip(ends, ends[1:])), name
    return {n: {p for a, b in ends for p in range(a, b + 1)} for n, ends in out.items()}


def mask_of(spark, sets, n_cols=7):
    rows = [(name, n_cols, p // n_cols, p % n_cols) for name, s in sets.items() for p in s]
    return spark.createDataFrame(rows, f"{ID} string, n_cols int, k int, l int")


@pytest.fixture(params=[2, 20])
def bits(request, monkeypatch):
    monkeypatch.setattr(runs, "BITS", request.param)
    monkeypatch.setattr(runs, "BLOCK", 1 << request.param)


def test_algebra(spark, bits):
    rng = np.random.default_rng(2)
    draw = lambda share: {int(p) for p in np.flatnonzero(rng.random(60) < share)}
    a = {f"m{n}": draw(n / 8) for n in range(9)} | {"alone": {3, 4, 9}}
    b = {f"m{n}": draw(0.5) for n in range(9)} | {"other": {1}}
    names = a.keys() | b.keys()
    left, right = (runs.from_places(mask_of(spark, s)) for s in (a, b))
    want = {
        runs.both: lambda x, y: x & y, runs.either: lambda x, y: x | y, runs.first_only: lambda x, y: x - y,
    }
    for f, g in want.items():
        got = held(f(left, right))
        for n in names:
            assert got.get(n, set()) == g(a.get(n, set()), b.get(n, set())), (f, n)
    kept = {r[ID]: r.kept for r in runs.counts(left).collect()}
    assert kept == {n: len(s) for n, s in a.items() if s}
    back = {(r[ID], r.k * 7 + r.l) for r in runs.places(left).collect()}
    assert back == {(n, p) for n, s in a.items() for p in s}


def test_stretches_that_touch_overlap_and_repeat(spark, bits):
    rows = [("x", 4, 0, 5), ("x", 4, 6, 9), ("x", 4, 8, 12), ("x", 4, 8, 12), ("x", 4, 20, 19), ("y", 4, 3, 3)]
    table = spark.createDataFrame(rows, f"{ID} string, n_cols int, first bigint, last bigint")
    assert held(runs.merged(table)) == {"x": set(range(13)), "y": {3}}


def test_large_masks_stay_small(spark):
    """Twelve billion places take one row for each block."""
    ends = spark.createDataFrame([("x", 64, 0, 12 * 10**9 - 1)], f"{ID} string, n_cols int, first bigint, last bigint")
    r = runs.counts(runs.merged(ends)).first()
    assert r.kept == 12 * 10**9 and r.runs == -(-12 * 10**9 // runs.BLOCK)
