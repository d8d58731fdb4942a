"""Schemas at the boundaries of the library."""

from pyspark.sql import types as T

RESULTS = T.StructType(
    [
        T.StructField("method", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("seed", T.LongType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
