"""Statistics and privacy against brute force and known values."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import hashing
from wavemill.functions.tails import normal_two_sided, signed_rank_exact, t_two_sided
from wavemill.operators import privacy, stats

RNG = np.random.default_rng(21)
VALUES = "method string, seed bigint, value double"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("t,df,p", [(2.228139, 10, 0.05), (12.706205, 1, 0.05), (2.750, 30, 0.01), (1.959964, 20000, 0.05), (0.0, 5, 1.0)])
def test_t_tail(spark, t, df, p):
    """Values of printed tables."""
    assert abs(one(spark, t_two_sided(F.lit(float(t)), F.lit(float(df)))) - p) < 5e-5


def test_infinite_t(spark):
    assert one(spark, t_two_sided(F.lit(float("inf")), F.lit(3.0))) == 0.0


@pytest.mark.parametrize("z", [0.0, 0.5, 1.96, -2.5758, 6.0])
def test_normal_tail(spark, z):
    assert np.isclose(one(spark, normal_two_sided(F.lit(float(z)))), math.erfc(abs(z) / math.sqrt(2)), rtol=1e-6)


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_exact_signed_rank_by_enumeration(spark, n):
    sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product([0, 1], repeat=n)]
    for w in range(n * (n + 1) // 4 + 1):
        want = min(1.0, 2 * sum(s <= w for s in sums) / 2**n)
        assert np.isclose(one(spark, signed_rank_exact(F.lit(float(w)), F.lit(n).cast("bigint"))), want)


def test_exact_signed_rank_at_fifty(spark):
    assert np.isclose(one(spark, signed_rank_exact(F.lit(434.0), F.lit(50).cast("bigint"))), 0.0495, atol=5e-4)


def table(spark, groups):
    rows = [(m, s, None if v is None else float(v)) for m, vs in groups.items() for s, v in vs]
    return spark.createDataFrame(rows, VALUES)


def test_metric_values_drop_null_and_nan(spark):
    rows = [("a", "d", 1, "x", 1.0), ("a", "d", 2, "x", None), ("a", "d", 3, "x", float("nan")), ("a", "d", 4, "y", 9.0)]
    from wavemill.sources.schemas import RESULTS

    got = stats.metric_values(spark.createDataFrame(rows, RESULTS), "x").collect()
    assert [r.value for r in got] == [1.0]


def test_summary_of_one_value(spark):
    got = {r.method: r for r in stats.summarize(table(spark, {"one": [(1, 5.0)], "two": [(1, 1.0), (2, 3.0)]})).collect()}
    assert got["one"].n == 1 and got["one"].std is None
    assert np.isclose(got["two"].std, np.sqrt(2))


@pytest.mark.parametrize("boot", [stats.bootstrap_exact, stats.bootstrap_poisson])
def test_bootstrap_interval(spark, boot):
    x = RNG.standard_normal(400) + 10
    values = table(spark, {"a": list(enumerate(x)), "one": [(7, 3.0)]}).repartition(7)
    got = {r.method: r for r in boot(values).collect()}
    error = x.std(ddof=1) / 20
    assert abs(got["a"].ci_low - (x.mean() - 1.96 * error)) < 0.4 * error
    assert abs(got["a"].ci_high - (x.mean() + 1.96 * error)) < 0.4 * error
    assert got["one"].ci_low == got["one"].ci_high == 3.0
    # The same draws whatever the partitioning.
    again = {r.method: r for r in boot(values.repartition(2)).collect()}
    assert np.isclose(again["a"].ci_low, got["a"].ci_low)
    assert boot(values.where("false")).count() == 0


def test_exact_bootstrap_over_many_buckets(spark):
    x = RNG.standard_normal(401) + 10
    values = table(spark, {"a": list(enumerate(x)), "same": [(i, 4.0) for i in range(70)]})
    got = {r.method: r for r in stats.bootstrap_exact(values, bits=3).collect()}
    error = x.std(ddof=1) / np.sqrt(401)
    assert abs(got["a"].ci_low - (x.mean() - 1.96 * error)) < 0.4 * error
    assert abs(got["a"].ci_high - (x.mean() + 1.96 * error)) < 0.4 * error
    assert got["same"].ci_low == got["same"].ci_high == 4.0


def test_local_draws_follow_the_generator(spark):
    first, second, draws = np.array([5, 2**30 - 1]), np.array([7, 2**30 - 1]), np.array([3, 4])
    rows = spark.createDataFrame([(k, (int(a), int(b))) for k, a, b in zip((0, 1), first, second)], "k int, s struct<first:bigint,second:bigint>")
    values = RNG.standard_normal(13)
    want = [0.0, 0.0]
    for r in hashing.with_draws(rows, "s", 4).collect():
        if r.b < draws[r.k]:
            want[r.k] += values[r.x * 13 // hashing.MODULUS]
    assert np.allclose(hashing.held_sums(values, draws, first, second), want)


def groups():
    base = RNG.standard_normal(12) + 1
    return {
        "target": list(enumerate(base)),
        "same": list(enumerate(base)),
        "other": list(enumerate(base * 0.5 + RNG.standard_normal(12))),
        "tied": list(enumerate(base + np.array([1.0, -1.0] * 6))),
        "shifted": [(s + 1, v) for s, v in enumerate(base + 0.3)],
        "short": list(enumerate(base[:5] + 1)),
        "single": [(0, 1.0)],
    }


def test_compare(spark):
    data = groups()
    got = {r.compare.removeprefix("target vs "): r for r in stats.compare(table(spark, data), "target").collect()}
    assert set(got) == {"same", "other", "tied", "shifted", "short"}
    base = np.array([v for _, v in data["target"]])
    for name in got:
        y = np.array([v for _, v in data[name]])
        r = got[name]
        assert np.isclose(r.mean_diff, base.mean() - y.mean())
        pooled = np.sqrt((base.var(ddof=1) + y.var(ddof=1)) / 2)
        assert np.isclose(r.cohens_d, (base.mean() - y.mean()) / pooled)
        assert r.paired == (name in ("same", "other", "tied"))
        if r.paired and name != "same":
            d = base - y
            assert np.isclose(r.t, d.mean() / (d.std(ddof=1) / np.sqrt(12)))
        elif not r.paired:
            error = np.sqrt(base.var(ddof=1) / len(base) + y.var(ddof=1) / len(y))
            assert np.isclose(r.t, (base.mean() - y.mean()) / error) and r.p_wilcoxon is None
    # All differences zero: no test statistic, and no part in the correction.
    assert got["same"].t is None and got["same"].p_t is None and got["same"].p_holm is None
    known = sorted((r.p_t, n) for n, r in got.items() if r.p_t is not None)
    running = 0.0
    for at, (p, name) in enumerate(known):
        running = max(running, (len(known) - at) * p)
        assert np.isclose(got[name].p_holm, min(1.0, running))


def test_constant_difference_has_infinite_t(spark):
    data = {"target": [(s, float(s)) for s in range(4)], "below": [(s, s - 2.0) for s in range(4)]}
    r = stats.compare(table(spark, data), "target").first()
    assert r.t == float("inf") and r.p_t == 0.0


def ranks(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_signed_ranks(spark):
    data = {"target": [(s, 0.0) for s in range(60)]}
    cases = {
        "small": RNG.standard_normal(10), "large": RNG.standard_normal(60) - 0.3,
        "tied": RNG.integers(1, 4, 20) * RNG.choice([-1.0, 1.0], 20), "zeros": np.array([0.0, 1.0, -2.0, 3.0]), "nothing": np.zeros(5),
    }
    for name, d in cases.items():
        data[name] = [(s, -v) for s, v in enumerate(d)]
    got = {r.method: r for r in stats.wilcoxon(stats.pair_with(table(spark, data), "target")).collect()}
    for name, d in cases.items():
        d = d[d != 0]
        r = got[name]
        if not len(d):
            assert r.w is None and r.p is None
            continue
        rk = ranks(np.abs(d))
        w = min(rk[d > 0].sum(), rk[d < 0].sum())
        assert np.isclose(r.w, w) and r.exact == (name == "small")
        if not r.exact:
            n, t = len(d), np.unique(np.abs(d), return_counts=True)[1]
            spread = np.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (t**3 - t).sum() / 48)
            assert np.isclose(r.p, math.erfc(abs(w - n * (n + 1) / 4) / spread / math.sqrt(2)), rtol=1e-5)


def test_holm_by_family_and_missing(spark):
    rows = [("x", 0.01), ("x", 0.04), ("x", 0.03), ("x", None), ("x", float("nan")), ("y", 0.5)]
    got = stats.holm(spark.createDataFrame(rows, "family string, p double"), "p", ["family"]).collect()
    by = {(r.family, r.p): r.p_holm for r in got if r.p is not None and r.p == r.p}
    assert np.isclose(by["x", 0.01], 0.03) and np.isclose(by["x", 0.03], 0.06) and np.isclose(by["x", 0.04], 0.06)
    assert by["y", 0.5] == 0.5
    assert sum(r.p_holm is None for r in got) == 2


UPDATES = "party string, coord int, v double"


def test_clip(spark):
    rows = [("long", 0, 3.0), ("long", 1, 4.0), ("exact", 0, 0.6), ("exact", 1, 0.8), ("zero", 0, 0.0)]
    got = {(r.party, r.coord): r.clipped for r in privacy.clip_contributors(spark.createDataFrame(rows, UPDATES)).collect()}
    assert np.isclose(got["long", 0], 0.6) and np.isclose(got["long", 1], 0.8)
    assert got["exact", 0] == 0.6 and got["zero", 0] == 0.0


def test_ledger_overspends(spark):
    rows = [(total, t, total) for total in (1, 2, 3, 5) for t in range(total)]
    got = privacy.ledger(spark.createDataFrame(rows, "plan int, t int, total int"), ["plan"]).collect()
    for total in (1, 2, 3, 5):
        last = max((r for r in got if r.plan == total), key=lambda r: r.t)
        assert np.isclose(last.spent, 3.0 * (sum(1 / k for k in range(1, total + 2)) - 1))
        assert last.overspent == (total >= 3)


def test_sigma(spark):
    assert np.isclose(one(spark, privacy.sigma(1.0, F.lit(1.5))), np.sqrt(2 * np.log(1.5 / 1e-5)) / 1.5)
    assert one(spark, privacy.sigma(1.0, F.lit(0.0))) > 1e6


def test_noise_is_repeatable_and_normal(spark):
    zero = spark.range(20000).select(F.col("id").alias("coord"), F.lit(0.0).alias("v"))
    noised = privacy.add_noise(zero, ["coord"], "v", F.lit(2.0), "s", "r1", "out")
    row = noised.agg(F.avg("out").alias("m"), F.stddev("out").alias("s"), F.kurtosis("out").alias("k")).first()
    assert abs(row.m) < 0.06 and abs(row.s - 2.0) < 0.05 and abs(row.k) < 0.2
    again = privacy.add_noise(zero.repartition(3), ["coord"], "v", F.lit(2.0), "s", "r1", "out")
    assert noised.exceptAll(again).count() == 0


def parties(spark, values):
    return spark.createDataFrame([(f"p{n}", c, float(v)) for n, v in enumerate(values) for c in range(16)], UPDATES)


def test_agreement(spark):
    updates = parties(spark, (1.0, 1.0, 1.0, 0.9))
    medians = privacy.robust_median(updates)
    assert {r.median for r in medians.collect()} == {1.0}
    report = privacy.agreement(updates, medians, 4, 1).first()
    assert (report.parties, report.agreeing, report.valid, report.quorum, report.agreed) == (4, 3, True, True, True)


@pytest.mark.parametrize("values,nodes,flags", [
    ((1.0, 1.0), 4, (True, False, True)),
    ((1.0, 2.0, 3.0, 4.0), 4, (True, True, False)),
    ((1.0, 1.0, 1.0), 3, (False, True, True)),
])
def test_disagreement(spark, values, nodes, flags):
    updates = parties(spark, values)
    report = privacy.agreement(updates, privacy.robust_median(updates), nodes, 1)
    row = report.first()
    assert (row.valid, row.quorum, row.agreed) == flags
    with pytest.raises(Exception, match="do not agree"):
        privacy.require_agreement(report).collect()


def test_private_update(spark):
    updates = parties(spark, (0.1, 0.1, 0.1, 5.0))
    original = spark.range(20).select(F.col("id").cast("int").alias("coord"), F.lit(1.0).alias("v"))
    got = {r.coord: r for r in privacy.private_update(original, updates, "k", "r1", epsilon=1e9).collect()}
    assert all(np.isclose(got[c].updated, 1.1, atol=1e-6) for c in range(16))
    assert all(got[c].updated == 1.0 for c in range(16, 20))


def test_t_tail_is_smooth_in_df(spark):
    rows = spark.createDataFrame([(9_999.0,), (10_000.0,), (10_001.0,), (1e6,), (3.0,)], "df double")
    p = {r.df: r.p for r in rows.select("df", t_two_sided(F.lit(1.96), F.col("df")).alias("p")).collect()}
    assert abs(p[10_001.0] - p[10_000.0]) < 1.1 * abs(p[10_000.0] - p[9_999.0]) + 1e-12
    z, density = 1.96, math.exp(-(1.96**2) / 2) / math.sqrt(2 * math.pi)
    expansion = math.erfc(z / math.sqrt(2)) + density * (z**3 + z) / 2e6  # first term in 1/df beyond the normal tail
    assert p[1e6] == pytest.approx(expansion, abs=1e-9) and p[3.0] == pytest.approx(0.14485, abs=1e-4)
    assert p[9_999.0] > p[10_000.0] > p[10_001.0] > p[1e6]


def test_releases_have_noise_of_their_own(spark):
    zero = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "coord string, v double")
    one, two = ({r.coord: r.out for r in privacy.add_noise(zero, ["coord"], "v", F.lit(1.0), "s", n, "out").collect()} for n in ("r1", "r2"))
    assert all(one[c] != two[c] for c in one)
