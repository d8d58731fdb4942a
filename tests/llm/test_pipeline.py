"""The pipeline beside a plain run of its decisions, and its stages on odd rows."""

import sys
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from wavemill.llm import language_id, mixing, near_dedup, quality
from wavemill.llm.queries import table, tokenizer
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "source_mix", "bpe_encoding"]


def test_rows_match_the_decisions(spark):
    docs = table(spark, SF, "documents")
    model = language_id.train_trigrams(docs, "text", "lang")
    ids = lambda df: [r.doc_id for r in df.where("kept").collect()]
    kept = docs.where(F.col("doc_id").isin(ids(language_id.identify(docs, model, ["doc_id"], "text", F.col("lang"), F.col("source")))))
    kept = kept.where(F.col("doc_id").isin(ids(quality.quality_rules(kept, table(spark, SF, "labels")))))
    kept = kept.where(F.col("doc_id").isin(ids(near_dedup.near_duplicates(kept))))
    want = Counter()
    for r in mixing.mix(kept).collect():
        if r.copies:
            want[r.doc_id] = len(r.copies)
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == want and all(r.same_text for r in got)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_the_columns(spark, odd_docs, no_docs, name, stage):
    kept = stage(spark, odd_docs, SF)
    assert kept.columns == odd_docs.columns
    kept.collect()
    assert stage(spark, no_docs, SF).count() == 0


def test_rows_without_an_id_of_their_own(spark, odd_docs):
    """Missing ids, ids shared by clean and rejected texts, repeated rows."""
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", "source").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(-1, "1 2 3", "en", "a")], docs.schema))  # no letters: rejected
    language, quality_, dedup, *_ = (stage for _, stage in corpus_pipeline.STAGES)
    counted = lambda df: Counter(r.text for r in df.select("text").collect())
    want = counted(language(spark, docs, SF))
    assert len(want) > 50 and "1 2 3" not in want
    for same in (None, 7):
        assert counted(language(spark, docs.withColumn("doc_id", F.lit(same).cast("bigint")), SF)) == want
    good, bad = " ".join(f"word{i}" for i in range(60)), "too short"
    shared = spark.createDataFrame([(-5, good), (-5, bad), (None, good), (None, bad)], "doc_id bigint, text string")
    assert counted(quality_(spark, shared, SF)) == Counter({good: 2})
    repeated = spark.createDataFrame([(3, good), (3, good), (None, good), (2, good), (None, "one two three four five six"), (9, ""), (9, "")], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.text) for r in dedup(spark, repeated, SF).collect())
    assert got == sorted([(2, good), (0, "one two three four five six"), (9, "")])


def test_last_stage_gives_the_librarys_ids(spark, odd_docs):
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    rows = corpus_pipeline.STAGES[-1][1](spark, odd_docs, SF).collect()
    want = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want


def test_last_stage_on_odd_rows(spark, odd_docs, no_docs):
    stage = corpus_pipeline.STAGES[-1][1]
    assert stage(spark, odd_docs, SF).count() == odd_docs.count() and stage(spark, no_docs, SF).count() == 0
    assert "corpus_pipeline" in sys.modules
