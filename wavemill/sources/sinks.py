"""Writing slices, results, summaries and comparisons. Every task writes its own part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from wavemill.operators.ranking import join_null_safe

#: Name of the undivided slice among the splits.
WHOLE = "all"
FILE_BYTES = 256 << 20
#: Up to so many slices, their table of sizes is broadcast.
BROADCAST_SLICES = 100_000


def write_slices(
    df: DataFrame, path: str, segment: str = "segment", split: str = "split", key: str | None = None,
    whole: bool = False, file_bytes: int = FILE_BYTES,
) -> None:
    """Folders by segment and split, JSON lines inside, in files of about ``file_bytes``.

    A first pass sums the bytes of each slice; a slice gets as many files as its bytes need, and
    one shuffle brings every file's rows into a task of its own, so the number of files follows
    the bytes, not tasks times slices. Rows are dealt to the files of a slice by a hash of ``key``
    (unique; without it, of the whole row, where equal rows share a file). ``whole`` writes the
    undivided slice too, as split "all". An empty table leaves an empty folder.
    """
    rows = df.withColumn(split, F.explode(F.array(F.col(split), F.lit(WHOLE)))) if whole else df
    line = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns]))) + 1
    files = F.ceil(F.sum(line) / F.lit(file_bytes)).alias("__files")
    sizes = rows.groupBy(segment, split).agg(files)
    # One row a slice, so the running sum is small.
    before = F.sum("__files").over(Window.orderBy(segment, split)) - F.col("__files")
    placed = sizes.withColumn("__before", before)
    total = sizes.agg(F.count(F.lit(1)).alias("slices"), F.sum("__files").alias("files")).first()
    if total["slices"] <= BROADCAST_SLICES:
        placed = F.broadcast(placed)
    spread = F.xxhash64(*([key] if key else df.columns))
    dealt = join_null_safe(rows, placed, [segment, split], "inner").withColumn(
        "__file", (F.col("__before") + F.pmod(spread, F.col("__files"))).cast("int")
    )
    one_each = dealt.repartitionById(max(1, total["files"] or 0), "__file").select(*df.columns)
    one_each.write.mode("overwrite").partitionBy(segment, split).json(path)


def write_subsets(df: DataFrame, path: str, subset: str = "subset") -> None:
    df.write.mode("overwrite").partitionBy(subset).json(path)


def write_results(df: DataFrame, path: str) -> None:
    """Result rows as JSON lines, with NULL fields written out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_summary(table: DataFrame, path: str) -> None:
    """Formatted summary (method, mean_std, ci) as a text table, headings first."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "method", "mean_std", "ci"), F.lit(" |"))
    # The heading of the table format.
    head = table.sparkSession.createDataFrame(
        [(0, "| Method | Mean±Std | 95% CI |"), (1, "|---|---|---|")], "at int, value string"
    )
    body = table.select(F.lit(2).alias("at"), line.alias("value"))
    # One line per method: the table is a printed report, so one file is right.
    ordered = head.unionByName(body).orderBy("at", "value").select("value")
    ordered.coalesce(1).write.mode("overwrite").text(path)


def write_comparison(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)
