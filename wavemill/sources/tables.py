"""Reading datasets and result lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from wavemill.sources.schemas import RESULTS


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of a dataset; the format follows the file name (Parquet unless .json/.jsonl/.csv)."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    name = path.rstrip("/").lower()
    if name.endswith((".json", ".jsonl")):
        return reader.json(path)
    if name.endswith(".csv"):
        return reader.option("header", True).csv(path)
    return reader.parquet(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType = RESULTS) -> DataFrame:
    """Result rows from JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)
