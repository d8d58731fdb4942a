"""Shuffle files end with the table they made; shards are written in turns, ids fall into ranges."""

import time

from pyspark.sql import functions as F
from wavemill.llm import training_order
from wavemill.llm.common import written
from wavemill.llm.queries import END_OF_TEXT, table, tokenizer

SF = "/root/testdata/sf0.001"


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = written(spark.range(50_000).groupBy((F.col("id") % 977).alias("k")).agg(F.sum("id").alias("s")), "few")
    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and rows.count() == 977


def test_ranges_of_ids(spark):
    for bounds in ([], [5], list(range(-300, 300, 3)), [-(1 << 63), 0, (1 << 63) - 1]):
        ids = [None, -(1 << 63), -301, -300, -299, 0, 5, 6, 299, 1 << 40, (1 << 63) - 1]
        got = spark.createDataFrame([(x,) for x in ids], "x bigint").select("x", training_order.range_of(F.col("x"), bounds).alias("k")).collect()
        assert all(r.k == (0 if r.x is None else sum(b < r.x for b in bounds)) for r in got)


def test_shards_are_shuffled_in_turns(spark, tmp_path, monkeypatch):
    held = []
    monkeypatch.setattr(training_order, "written", lambda df, label: held.append((label, out := written(df, label))) or out)
    docs = table(spark, SF, "documents")
    whole = training_order.materialise(docs, tokenizer("byte_bpe_50k.json"), f"file://{tmp_path}", END_OF_TEXT, length=64, per_shard=32)
    turns = [df.count() for label, df in held if label == "stream-manifest"]
    assert len(turns) == training_order.TURNS and sum(turns) == whole.count() and max(turns) < 0.4 * sum(turns)
    slots = sorted(r.slot for r in whole.select("slot").collect())
    assert slots == list(range(len(slots)))
