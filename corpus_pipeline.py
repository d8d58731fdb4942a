"""A training corpus from ``documents``: language, quality, near-duplicates, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. The
rows of a stage are written before the next one is called, as ``run`` does: a stage begins by
deleting the scratch tables of the one before. Null, empty and very long texts, repeated rows, empty tables and
columns of any name pass through all stages; where a stage rejects them, its docstring says so.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from wavemill.llm import bpe, language_id, mixing, near_dedup, quality
from wavemill.llm.common import drop_tables, recording, small_batches, written
from wavemill.llm.queries import table, tokenizer

#: The mix repeats documents and cuts one per source, so no SQL gives its rows; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


#: A stage's own key of a row. Ids may be missing or repeated, so no stage judges by them.
ROW = "__stage_row"


_scratch: list[str] = []


def staged(stage):
    """``stage`` with its scratch tables noted, and those of the stage before deleted. Its rows, which the caller
    writes, go to Python in small batches: the session keeps that setting."""

    @wraps(stage)
    def run_stage(spark, docs, sf_dir):
        drop_tables(spark, _scratch)
        small_batches(spark)
        with recording(_scratch):
            return stage(spark, docs, sf_dir)

    return run_stage


def keyed(docs, label):
    """``docs`` with a key of every row, written once: the same whenever it is read."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), f"keyed-{label}")


def whole_rows(docs):
    """``docs`` with each row as one column, ROW, beside those that the stage reads: an operator that carries it
    decides where the row lies, and nothing is joined to it afterwards."""
    return docs.select(F.struct("*").alias(ROW), "*")


def kept_rows(rows, kept):
    """The rows whose key is in ``kept``, with the columns the stage was given."""
    return rows.join(kept.select(ROW), ROW, "left_semi").drop(ROW)


@staged
def language_stage(spark, docs, sf_dir):
    """Documents whose language is told with confidence. A text without letters tells none and goes."""
    model = language_id.train_trigrams(docs, "text", "lang")
    return language_id.identify(whole_rows(docs), model, [ROW], f"{ROW}.text", F.col("lang"), F.col("source")).where("kept").select(f"{ROW}.*")


@staged
def quality_stage(spark, docs, sf_dir):
    """Documents that pass the base rule and the boosted trees. Labels belong to ids; rows without id are judged alike."""
    counted = written(quality.document_counts(whole_rows(docs), ROW, f"{ROW}.text"), "text-counts")
    trees = quality.fit(counted.withColumn("doc_id", F.col(f"{ROW}.doc_id")).drop(ROW), table(spark, sf_dir, "labels"))
    return quality.judge(counted, trees, ROW).where("kept").select(f"{ROW}.*")


@staged
def dedup_stage(spark, docs, sf_dir):
    """One document of each group of near-duplicates, by shingles of five words: the smallest id, rows without id last.

    Texts without words are like no other; of those only rows that share an id are one document.
    """
    rows = keyed(docs, "dedup")
    found = near_dedup.near_duplicates(rows, ROW)
    empty = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    placed = found.join(rows.select(ROW, "doc_id"), ROW).select(
        F.when(~empty, F.col("component_id")).alias("group"),
        F.when(empty, F.col("doc_id")).alias("empty_id"),
        F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW).alias("place"),
    )
    first = placed.groupBy("group", "empty_id").agg(F.min("place").alias("place"))
    return kept_rows(rows, first.select(F.col(f"place.{ROW}").alias(ROW)))


@staged
def mix_stage(spark, docs, sf_dir):
    """The documents as the mix takes them, a row per copy. Texts without words are never taken; a null source is a source."""
    return mixing.mixed_documents(docs)


@staged
def encode_stage(spark, docs, sf_dir):
    """Token ids of every copy, with the digests of a round trip; none for a null or empty text."""
    return bpe.round_trip(docs, tokenizer("byte_bpe_50k.json"), carry=("doc_id", "source"), ids=True)


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("near_dedup", dedup_stage),
    ("source_mix", mix_stage),
    ("bpe_encoding", encode_stage),
]


def run(spark, sf_dir):
    """All stages on ``documents``, each written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        rows, now = stage(spark, docs, sf_dir), []
        with recording(now):
            docs = written(rows, f"pipeline-{name}")
        drop_tables(spark, before)
        before = now
    drop_tables(spark, _scratch)
    return docs
