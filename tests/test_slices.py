"""Splits, caps, filters, ranks under skew, sources and sinks."""

import hashlib
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions.numeric import magnitude_level
from wavemill.operators import ranking, slices
from wavemill.sources import sinks, tables
from wavemill.sources.schemas import RESULTS


def docs(spark):
    """A hot segment, a NULL one, a single row and exactly ten rows."""
    sizes = {"hot": 500, None: 7, "single": 1, "ten": 10}
    rows, n = [], 0
    for segment, size in sizes.items():
        rows += [(n + i, segment) for i in range(size)]
        n += size
    return spark.createDataFrame(rows, "id bigint, segment string"), sizes


def hashed(key, seed=42):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("bits", [1, 4, 16])
def test_exact_split(spark, bits):
    df, sizes = docs(spark)
    got = slices.split_exact(df, ["segment"], "id", bits=bits).collect()
    assert len(got) == sum(sizes.values()) and len({r.id for r in got}) == len(got)
    for segment, n in sizes.items():
        members = sorted((hashed(r.id), r.id) for r in got if r.segment == segment)
        test = {k for _, k in members[: -(-n * 2 // 10)]}
        assert {r.id for r in got if r.segment == segment and r.split == "test"} == test


def test_hash_split(spark):
    df, _ = docs(spark)
    for r in slices.split_hash(df, "id").collect():
        assert (r.split == "test") == (hashed(r.id) < 0.2 * 2**32)


def test_hash_split_of_a_stream(spark):
    """Row-wise functions hold no state, so they take a stream as it is."""
    path = tempfile.mkdtemp(prefix="run-") + "/in"
    df, sizes = docs(spark)
    df.write.parquet(path)
    stream = slices.split_hash(spark.readStream.schema(df.schema).parquet(path), "id")
    run = stream.writeStream.format("memory").queryName("split_stream").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("split_stream").count() == sum(sizes.values())
    same = slices.split_hash(df, "id").exceptAll(spark.table("split_stream"))
    assert same.count() == 0


def test_caps(spark):
    df, sizes = docs(spark)
    first = sorted((hashed(r.id), r.id) for r in df.collect())[:20]
    assert {r.id for r in slices.sample_cap(df, "id", 20).collect()} == {k for _, k in first}
    by = slices.sample_cap_by(df, ["segment"], "id", 10).groupBy("segment").count().collect()
    assert {r.segment: r["count"] for r in by} == {s: min(n, 10) for s, n in sizes.items()}


def test_filters(spark):
    df = spark.createDataFrame([(1, "EN"), (2, None), (3, "de")], "id int, lang string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(df.where(slices.equals_nocase("lang", "en", "english"))) == [1]
    assert ids(df.where(slices.equals_nocase("lang", "English", "english"))) == [2]
    assert ids(df.where(slices.equals_nocase(None, "english", "english"))) == [1, 2, 3]
    assert ids(slices.filter_or_all(df, F.col("lang") == "de")) == [3]
    assert ids(slices.filter_or_all(df, F.col("lang") == "xx")) == [1, 2, 3]
    assert slices.filter_or_all(df.limit(0), F.col("lang") == "de").count() == 0


def test_report_shows_empty_slices(spark):
    df, _ = docs(spark)
    expected = spark.createDataFrame([("hot",), ("nobody",), (None,)], "segment string")
    report = slices.split_report(slices.split_exact(df, ["segment"], "id"), "segment", expected)
    got = {(r.segment, r.split): r.n for r in report.collect()}
    assert got == {("hot", "train"): 400, ("hot", "test"): 100, ("nobody", "train"): 0, ("nobody", "test"): 0,
                   (None, "train"): 5, (None, "test"): 2}


def test_ranks_match_a_plain_sort(spark):
    rng = np.random.default_rng(3)
    ids = [int(x) for x in rng.choice(2**45, 300, replace=False)] + [-5, 0, -(2**40)]
    rows = [(k, None if n % 3 == 0 else "g") for n, k in enumerate(ids)]
    got = ranking.rank_by_id(spark.createDataFrame(rows, "id bigint, g string"), ["g"], "id").collect()
    assert len(got) == len(rows)
    for group in (None, "g"):
        want = {k: n for n, k in enumerate(sorted(k for k, g in rows if g == group))}
        assert {r.id: r["rank"] for r in got if r.g == group} == want


def test_magnitude_levels_never_fall(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal(300) * 10.0 ** rng.integers(-20, 20, 300), [0.0, -1.0, 1.0, 2.0, 4.0, 0.5, 3.0],
                        np.nextafter([2.0, 4.0, 0.5, 1.0], 0), 2.0 ** np.arange(-60, 60), [1e308, -1e308, 1e-310]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for bits in (0, 3, 12):
        got = sorted((r.x, r.level) for r in df.select("x", magnitude_level(F.col("x"), bits).alias("level")).collect())
        assert all(a[1] <= b[1] for a, b in zip(got, got[1:]))


def test_average_ranks_and_median(spark):
    rng = np.random.default_rng(9)
    data = {"a": rng.integers(-5, 5, 101) / 4.0, "b": rng.standard_normal(40), "c": np.array([3.0]), "hot": np.full(400, 2.5)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, v double")
    got = {(r.g, r.v): (r.ties, r.avg_rank) for r in ranking.average_ranks(df, ["g"], "v", bits=2).collect()}
    for g, vs in data.items():
        for v in set(vs):
            below, same = int((vs < v).sum()), int((vs == v).sum())
            assert got[g, v] == (same, below + (same + 1) / 2)
    medians = {r.g: r.median for r in ranking.group_median(df, ["g"], "v").collect()}
    assert all(np.isclose(medians[g], np.median(vs)) for g, vs in data.items())


def test_results_keep_nulls_and_skip_blank_lines(spark):
    path = tempfile.mkdtemp(prefix="run-")
    rows = [("m", "d", 1, "accuracy", 0.1 + 0.2), ("m", "d", 2, "accuracy", None)]
    sinks.write_results(spark.createDataFrame(rows, RESULTS), f"{path}/out")
    text = "".join(r.value for r in spark.read.text(f"{path}/out").collect())
    assert '"value":null' in text
    assert sorted(tuple(r) for r in tables.read_results(spark, f"{path}/out").collect()) == rows
    with open(f"{path}/blank.jsonl", "w") as f:
        f.write('{"method":"m","seed":1,"metric":"x","value":2.0}\n\n   \n{"method":"n","seed":2,"metric":"x","value":3.0}\n')
    assert tables.read_results(spark, f"{path}/blank.jsonl").where("method is not null").count() == 2


def test_readers_follow_the_file_name(spark):
    path = tempfile.mkdtemp(prefix="run-")
    df = spark.range(3).withColumn("name", F.lit("x"))
    df.write.json(f"{path}/a.jsonl")
    df.write.parquet(f"{path}/a.parquet")
    df.write.option("header", True).csv(f"{path}/a.csv")
    for end in ("jsonl", "parquet", "csv"):
        got = tables.read_table(spark, f"{path}/a.{end}", df.schema)
        assert got.dtypes == df.dtypes and got.count() == 3


def test_summary_file_reads_as_a_table(spark):
    path = tempfile.mkdtemp(prefix="run-") + "/summary"
    rows = [("b", "1.0±0.1", "[0.9, 1.1]"), ("a", "2.0±0.1", "[1.9, 2.1]")]
    sinks.write_summary(spark.createDataFrame(rows, "method string, mean_std string, ci string"), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines == ["| Method | Mean±Std | 95% CI |", "|---|---|---|", "| a | 2.0±0.1 | [1.9, 2.1] |", "| b | 1.0±0.1 | [0.9, 1.1] |"]


def test_full_buckets_are_cut_by_further_bits(spark):
    """A narrow and a constant column, negative values and magnitudes far apart: ranks as numpy's, small buckets."""
    from wavemill.functions.numeric import finer_levels, magnitude_level

    rng = np.random.default_rng(2)
    columns = {
        "narrow": 1000 + rng.random(3000), "negative": -1000 - rng.random(1500), "constant": np.full(2000, 3.25),
        "wide": np.concatenate([10.0 ** rng.uniform(-290, 300, 500), -(10.0 ** rng.uniform(-290, 300, 500)), [0.0, 1.0, 2.0, 0.5]]),
        "neighbours": np.nextafter(np.full(64, 1.0), 2) + np.arange(64) * 2.0**-52,
    }
    df = spark.createDataFrame([(g, float(v)) for g, c in columns.items() for v in c], "g string, v double")
    got = {(r.g, r.v): (r.ties, r.avg_rank) for r in ranking.average_ranks(df, ["g"], "v", bucket_values=16).collect()}
    for g, c in columns.items():
        values, counts = np.unique(c, return_counts=True)
        after = np.cumsum(counts)
        for v, n, e in zip(values.tolist(), counts.tolist(), after.tolist()):
            assert got[g, v] == (n, e - n + (n + 1) / 2)
    x = F.col("v")
    levels = {"a": magnitude_level(x, 12)} | {f"b{n}": c for n, c in enumerate(finer_levels(x, 12))}
    cut = ranking.refined(df.distinct(), ["g"], levels, 16)
    assert cut.groupBy("g", *levels).count().agg(F.max("count")).first()[0] <= 16


@pytest.mark.parametrize("share, quota", [("0.125", lambda n: -(-n // 8)), (0.15, lambda n: -(-n * 3 // 20)), (0, lambda n: 0), (1, lambda n: n)])
def test_any_test_share(spark, share, quota):
    df, sizes = docs(spark)
    got = slices.split_exact(df, ["segment"], "id", share).where("split = 'test'").groupBy("segment").count().collect()
    assert {r.segment: r["count"] for r in got} == {s: quota(n) for s, n in sizes.items() if quota(n)}


def test_slices_are_cut_into_files_by_bytes(spark):
    df, sizes = docs(spark)
    rows = slices.split_exact(df, ["segment"], "id").withColumn("text", F.repeat(F.lit("x"), 100)).repartition(16)
    with tempfile.TemporaryDirectory() as folder:
        path = f"{folder}/slices"
        sinks.write_slices(rows, path, key="id", whole=True, file_bytes=20_000)
        back = spark.read.schema("id bigint, text string, segment string, split string").json(path)
        files = {}
        for r in back.select("segment", "split", F.input_file_name().alias("file")).distinct().collect():
            files.setdefault((r.segment, r.split), set()).add(r.file)
        # 500 rows of some 160 bytes: four or five files for the whole hot slice, one for each small one.
        assert 4 <= len(files["hot", "all"]) <= 5 and 3 <= len(files["hot", "train"]) <= 4 and len(files["hot", "test"]) == 1
        assert all(len(f) == 1 for (segment, _), f in files.items() if segment != "hot")
        counts = {(r.segment, r.split): r["count"] for r in back.groupBy("segment", "split").count().collect()}
        for segment, n in sizes.items():
            assert counts[segment, "all"] == n == counts[segment, "test"] + counts.get((segment, "train"), 0)
        sinks.write_slices(rows.where("false"), f"{folder}/empty", whole=True)
