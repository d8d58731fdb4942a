"""What a Python worker is given at once."""

import pyarrow as pa

import corpus_pipeline
from wavemill.llm.common import BATCH_ROWS, MOST_ROWS, written


def largest_batch(spark, write):
    """Rows of the largest batch that a Python worker is given."""
    rows = spark.range(0, 9000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n bigint")
    return max(r.n for r in write(rows).collect())


def test_written_rows_go_in_small_batches(spark, no_docs):
    before = spark.conf.get(BATCH_ROWS)
    try:
        spark.conf.set(BATCH_ROWS, "10000")
        assert largest_batch(spark, lambda df: written(df, "batches")) <= MOST_ROWS
        assert spark.conf.get(BATCH_ROWS) == "10000"
        corpus_pipeline.STAGES[-1][1](spark, no_docs, None)
        assert largest_batch(spark, lambda df: df) <= MOST_ROWS  # the caller writes the stage's rows
        spark.conf.set(BATCH_ROWS, "7")
        assert largest_batch(spark, lambda df: written(df, "batches")) == 7
    finally:
        spark.conf.set(BATCH_ROWS, before)
