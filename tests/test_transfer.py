"""Selections carried from one matrix to another, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import dct, rows_of
from wavemill.operators import strips, transfer
from wavemill.operators.matrix import ID

RNG = np.random.default_rng(31)
MATRICES = {"a": RNG.standard_normal((23, 9)), "b/sv": RNG.standard_normal((40, 9)), "c": RNG.standard_normal((40, 9)),
            "zero": np.zeros((6, 9)), "one": RNG.standard_normal((1, 9)), "thin": RNG.standard_normal((5, 3))}


def by_weight(share, tau):
    flat = share.ravel()
    order = np.lexsort((np.arange(len(flat)), -flat))
    keep = np.zeros(len(flat), bool)
    keep[order] = np.cumsum(flat[order]) <= tau * flat.sum()
    return keep.reshape(share.shape)


def by_size(c, fraction=0.25):
    flat = np.abs(c).ravel()
    keep = np.zeros(len(flat), bool)
    keep[np.lexsort((np.arange(len(flat)), -flat))[: max(1, int(len(flat) * fraction))]] = True
    return keep.reshape(c.shape)


def wanted(source, target, tau):
    """Baseline, transfer and full as parts of the target's energy."""
    height = max(len(source), len(target))

    def whole(m):
        return np.vstack([m, np.zeros((height - len(m), m.shape[1]))])

    def steps(m):
        return np.vstack([np.zeros((1, m.shape[1])), np.diff(m, axis=0)])

    sv, tv, sg, tg = (dct(whole(x)) for x in (source, target, steps(source), steps(target)))
    ss, ts = (c * c / ((c * c).sum() + 1e-12) for c in (sv, tv))
    shared = (ss + ts) / 2
    xs = shared * np.clip(ts / np.maximum(shared, 1e-6), 0.5, 2.0)
    masks = by_weight(ss, tau) & by_size(sg), by_weight(xs, tau) & by_size(tg), by_weight(ts, tau) & by_size(tg)
    return [(tv * tv * m).sum() / ((tv * tv).sum() + 1e-12) for m in masks]


def test_transfer_between_matrices_of_any_height(spark, monkeypatch):
    """Higher, lower and equal targets, a matrix paired with itself and with zeros, in strips of 4 columns and short segments."""
    monkeypatch.setattr(strips, "SEGMENT_VALUES", 30)
    pairs = [("a", "b/sv"), ("b/sv", "a"), ("b/sv", "c"), ("a", "a"), ("c", "one"), ("c", "zero"), ("a", "gone")]
    rows = transfer.with_steps(rows_of(spark, MATRICES).repartition(4))
    got = {(r.src, r.tgt): r for r in transfer.transfer_scores(rows, spark.createDataFrame(pairs, "src string, tgt string"), 0.8, width=4).collect()}
    assert set(got) == set(pairs[:-1])
    for s, t in pairs[:-1]:
        r = got[s, t]
        assert np.allclose([r.baseline, r.transfer, r.full], wanted(MATRICES[s], MATRICES[t], 0.8), atol=1e-9), (s, t)


def test_unequal_widths_are_an_error_and_no_pairs_give_nothing(spark):
    rows = transfer.with_steps(rows_of(spark, MATRICES))
    none = spark.createDataFrame([], "src string, tgt string")
    assert transfer.transfer_scores(rows, none).count() == 0
    with pytest.raises(Exception, match="unequal width"):
        transfer.transfer_scores(rows, spark.createDataFrame([("a", "thin")], "src string, tgt string")).collect()


def test_steps_between_rows(spark):
    got = {(r[ID], r.i): r.grad for r in transfer.with_steps(rows_of(spark, MATRICES)).collect()}
    for name, m in MATRICES.items():
        want = np.vstack([np.zeros((1, m.shape[1])), np.diff(m, axis=0)])
        assert np.allclose([got[name, i] for i in range(len(m))], want)


def test_missing_rows_of_placed_matrices_are_zero(spark):
    m = MATRICES["a"].copy()
    m[[3, 7, 8]] = 0
    rows = rows_of(spark, {"m": m}).where(~F.col("i").isin(3, 7, 8)).withColumnRenamed("i", "at")
    back = {r.i: r.row for r in strips.inverse(strips.forward(rows, 4, placed=True)).collect()}
    assert np.allclose([back[i] for i in range(len(m))], m, atol=1e-9)


def test_weights_are_selected_with_ties(spark):
    shares = np.array([[0.5, 0.25, 0.25], [0.25, 0.25, 0.0]])
    segment = spark.createDataFrame([("m", 2, 3, 0, 1, 0, 3, shares.ravel().tolist())], strips.SEGMENT)
    kept = strips.select_weight(segment, 0.7).first().keep
    assert kept == by_weight(shares, 0.7).ravel().tolist()
