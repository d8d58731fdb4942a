"""Few texts are moved for the sets of few nodes."""

from pyspark.sql import functions as F
from wavemill.llm import near_dedup
from wavemill.llm.common import maybe_among

def test_filter_by_key_bits_loses_no_key(spark):
    rows = spark.range(100_000).select("id", F.lit("x").alias("text"))
    keys = rows.where("id % 50 = 0").select("id").unionByName(spark.createDataFrame([(0,), (-7,)], "id bigint"))
    left = {r.id for r in maybe_among(rows, keys, "id").collect()}
    assert set(range(0, 100_000, 50)) <= left and len(left) < 10_000
    assert maybe_among(rows, keys.where("false"), "id").count() == 0
    docs = rows.unionByName(spark.createDataFrame([(100, None), (None, "a")], "id bigint, text string"))
    sets = near_dedup.element_sets(keys.withColumnRenamed("id", "node"), docs, "id", "text", 2)
    assert sorted(r.node for r in sets.collect()) == sorted([*range(0, 100_000, 50), 100])
    plan = sets._jdf.queryExecution().optimizedPlan().toString()  # the filter by bits lies below the join by id
    assert plan.index("getbit") > plan.index("Join Inner") and "LeftSemi" not in plan and plan.count("Join Inner") == 2
