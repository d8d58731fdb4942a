"""Texts stay beside their verdicts: no stage that judges rows one by one joins them to what it found."""

import pytest

import corpus_pipeline
from wavemill.llm.queries import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,joins", [("language_id", 1), ("quality_rules", 0)])
def test_texts_stay_where_they_are_judged(spark, name, joins):
    """A language's table is joined to the rows; no verdict is."""
    docs = table(spark, SF, "documents")
    kept = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == joins and "Aggregate" not in plan
    assert kept.schema.simpleString() == docs.schema.simpleString()
    assert 0 < kept.count() == kept.join(docs, docs.columns, "left_semi").count()
