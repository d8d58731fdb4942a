"""Exact discrete noise: its law, its tail, its grid."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions.discrete import bit_stream, discrete_gaussian
from wavemill.operators import privacy


@pytest.mark.parametrize("scale", [1, 2, 5])
def test_law(scale):
    count = 40_000
    drawn = np.array([discrete_gaussian(bit_stream("s", f"{scale}:{n}"), scale) for n in range(count)])
    support = np.arange(-8 * scale, 8 * scale + 1)
    mass = np.exp(-support.astype(float) ** 2 / (2 * scale * scale))
    mass /= mass.sum()
    seen = np.array([(drawn == z).sum() for z in support])
    expected = count * mass
    common = expected > 5
    chi = ((seen - expected) ** 2 / expected)[common].sum()
    assert chi < common.sum() + 5 * math.sqrt(2 * common.sum())
    far = mass[np.abs(support) > 3 * scale].sum() * count
    assert abs((np.abs(drawn) > 3 * scale).sum() - far) < 5 * math.sqrt(far)


def test_wide_scale_is_normal():
    scale = 1_500_000
    drawn = np.array([discrete_gaussian(bit_stream("s", str(n)), scale) for n in range(20_000)]) / scale
    assert abs(drawn.mean()) < 0.04 and abs(drawn.std() - 1) < 0.03 and abs((drawn**4).mean() - 3) < 0.3


def test_bits_are_uniform_and_keyed():
    below = bit_stream("s", "n")
    drawn = np.array([below(7) for _ in range(7000)])
    assert np.all(np.abs(np.bincount(drawn, minlength=7) - 1000) < 200) and below(1) == 0
    assert [bit_stream("s", "n")(1 << 64)] != [bit_stream("t", "n")(1 << 64)]


def released(spark, rows, secret="k", release="1"):
    table = spark.createDataFrame(rows, "coord string, v double, scale double")
    out = privacy.add_discrete_noise(table.repartition(3), ["coord"], "v", F.col("scale"), secret, release, "released")
    assert out.columns == ["coord", "v", "scale", "released"]
    return {r.coord: r.released for r in out.collect()}


def test_noise_lies_on_its_grid_and_repeats(spark):
    rows = [(f"c{n}", 3.25 * n, 10.0) for n in range(200)]
    first = released(spark, rows)
    assert first == released(spark, rows) and first != released(spark, rows, release="2") != released(spark, rows, "other")
    step = Fraction(2) ** (3 - privacy.GRID_BITS)
    assert all((Fraction(x) / step).denominator == 1 for x in first.values())
    noise = np.array([first[c] - v for c, v, _ in rows])
    assert abs(noise.mean()) < 3 and abs(noise.std() - 10) < 2
    # One coordinate by hand.
    drawn = discrete_gaussian(bit_stream("k", "1:2:c4"), 10 * 2**17)
    assert first["c4"] == float(step * (round(Fraction(13) / step) + drawn))


def test_missing_and_odd_values_give_null(spark):
    rows = [("a", None, 1.0), ("b", float("nan"), 1.0), ("c", 1.0, 0.0), ("d", 1.0, -1.0), ("e", 1.0, float("inf")), ("f", 1.0, None), (None, 1.0, 1.0)]
    got = released(spark, rows)
    assert all(got[c] is None for c in "abcdef") and got[None] is not None
    assert released(spark, []) == {}
