"""Two-dimensional cosine transform of matrix collections.

Bounded matrices are dense records: Arrow hands tasks batches of them (at most
``spark.sql.execution.arrow.maxBytesPerBatch``) and equal shapes are stacked, so
there is no shuffle and no call per matrix. Larger matrices go through
``dct2d_rows``: rows first, then blocks of columns, so several tasks share one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavemill.functions import cosine
from wavemill.operators.matrix import ID, SHAPE, cells


def _stacked(batch: pa.RecordBatch, column: str, kernel) -> pa.Array:
    """Run ``kernel`` on (count, rows, cols) stacks of the equal-shaped matrices of a batch."""
    array = batch.column(column)
    offsets = np.asarray(array.offsets, dtype=np.int64)
    flat = array.values.to_numpy(zero_copy_only=False)
    out = np.empty_like(flat, dtype=np.float64)
    shapes = np.stack([np.asarray(batch.column(s), dtype=np.int64) for s in SHAPE], axis=1)
    if (np.diff(offsets) != shapes.prod(axis=1)).any():
        raise ValueError(f"{column}: a record does not hold rows x columns values")
    for shape in np.unique(shapes, axis=0):
        members = np.flatnonzero((shapes == shape).all(axis=1))
        where = offsets[members][:, None] + np.arange(shape[0] * shape[1])[None, :]
        stack = flat[where].reshape(len(members), *shape)
        out[where] = kernel(stack).reshape(len(members), -1)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))


def map_matrices(dense: DataFrame, arrays: dict[str, str], kernel: Callable) -> DataFrame:
    """Add (or replace) array columns: ``arrays`` maps new names to the arrays ``kernel`` is applied to.

    Every other column passes through the worker: select what is needed first.
    """
    kept = [f for f in dense.schema.fields if f.name not in arrays]
    schema = T.StructType([*kept, *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in arrays]])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                done = [_stacked(batch, source, kernel) for source in arrays.values()]
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *done], names)

    return dense.mapInArrow(run, schema)


def dct2d(dense: DataFrame, **arrays: str) -> DataFrame:
    """Forward transform: ``dct2d(d, coef="vals")``; several arrays share one pass.

    Without names ``vals`` is turned into ``coef`` and does not come back.
    """
    if not arrays:
        dense, arrays = dense.withColumnRenamed("vals", "coef"), {"coef": "coef"}
    return map_matrices(dense, arrays, cosine.forward_2d)


def idct2d(dense: DataFrame, **arrays: str) -> DataFrame:
    """Inverse transform: ``idct2d(d, vals="coef")``; without names ``coef`` is turned into ``vals``."""
    if not arrays:
        dense, arrays = dense.withColumnRenamed("coef", "vals"), {"vals": "vals"}
    return map_matrices(dense, arrays, cosine.inverse_2d)


def _row_pass(rows: DataFrame, kernel) -> DataFrame:
    """Transform every row's array."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            array = batch.column("row")
            lengths = np.diff(np.asarray(array.offsets))
            flat = array.values.to_numpy(zero_copy_only=False)
            starts = np.asarray(array.offsets)[:-1]
            done = np.empty_like(flat)
            for size in np.unique(lengths):
                where = starts[lengths == size][:, None] + np.arange(size)[None, :]
                done[where] = kernel(flat[where])
            yield pa.RecordBatch.from_arrays(
                [batch.column(ID), batch.column("i"), pa.ListArray.from_arrays(array.offsets, pa.array(done))],
                [ID, "i", "row"],
            )

    return rows.select(ID, F.col("i").cast("bigint").alias("i"), "row").mapInArrow(
        run, f"{ID} string, i bigint, row array<double>"
    )


def _rows_along(rows: DataFrame, kernel, width: int) -> DataFrame:
    """Transform every row's array, then cut it into strips of ``width`` columns."""
    passed = _row_pass(rows, kernel)
    starts = F.sequence(F.lit(0), F.size("row") - 1, F.lit(width))
    return passed.select(
        ID,
        "i",
        F.explode(
            F.transform(starts, lambda s: F.struct(s.alias("first"), F.slice("row", s + 1, F.lit(width)).alias("part")))
        ).alias("strip"),
    ).select(ID, "i", "strip.first", "strip.part")


def dct2d_rows(rows: DataFrame, width: int = 64, max_rows: int = 1 << 22) -> DataFrame:
    """Transform of matrices given as rows: one map over rows, one shuffle by strip of columns.

    A task holds one strip (all rows of ``width`` columns). Matrices with more than
    ``max_rows`` rows are refused rather than cut short: tile them first.
    """
    forward = cosine.forward_last
    strips = _rows_along(rows, forward, width)

    def column_pass(table: pa.Table) -> pa.Table:
        if table.num_rows > max_rows:
            raise ValueError(f"matrix has {table.num_rows} rows, more than {max_rows}: use tile_rows first")
        table = table.sort_by("i")
        part = table.column("part").combine_chunks()
        block = part.values.to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        done = np.ascontiguousarray(forward(block.T).T)
        out = pa.ListArray.from_arrays(part.offsets, pa.array(done.ravel()))
        return table.set_column(table.schema.get_field_index("part"), "part", out)

    done = strips.groupBy(ID, "first").applyInArrow(
        column_pass, f"{ID} string, i bigint, first int, part array<double>"
    )
    return done.select(
        ID,
        F.col("i").cast("int").alias("k"),
        F.posexplode("part").alias("offset", "c"),
        "first",
    ).select(ID, "k", (F.col("first") + F.col("offset")).alias("l"), "c")


def idct2d_cells(coef: DataFrame, c: str = "c", width: int = 64) -> DataFrame:
    """Inverse of ``dct2d_rows``: rows (``i, row``) from all coefficient cells (``k, l``) of matrices of any height.

    Columns first, a strip of ``width`` of them in a task, then rows; two shuffles. A missing cell is an error.
    """
    inverse = cosine.inverse_last
    kept = coef.select(
        ID, F.col("k").cast("bigint").alias("k"), F.col("l").cast("int").alias("l"), F.col(c).cast("double").alias("c"),
        F.floor(F.col("l") / F.lit(width)).cast("int").alias("strip"),
    )

    def column_pass(table: pa.Table) -> pa.Table:
        table = table.sort_by([("l", "ascending"), ("k", "ascending")])
        k, l = table.column("k").to_numpy(), table.column("l").to_numpy()
        height, first = int(k.max()) + 1, int(l[0])
        count = int(l[-1]) - first + 1
        if (k != np.tile(np.arange(height), count)[: len(k)]).any() or len(k) != height * count:
            raise ValueError("coefficient cells are missing")
        block = np.ascontiguousarray(inverse(table.column("c").to_numpy().reshape(count, height)).T)
        offsets = np.arange(height + 1) * count
        return pa.table(
            {
                ID: pa.array([table.column(ID)[0].as_py()] * height, pa.string()),
                "i": pa.array(np.arange(height), pa.int64()),
                "first": pa.array(np.full(height, first), pa.int32()),
                "part": pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(block.ravel())).cast(pa.list_(pa.float64())),
            }
        )

    strips = kept.groupBy(ID, "strip").applyInArrow(column_pass, f"{ID} string, i bigint, first int, part array<double>")
    parts = F.sort_array(F.collect_list(F.struct("first", "part")))
    rows = strips.groupBy(ID, "i").agg(F.flatten(F.transform(parts, lambda p: p["part"])).alias("row"))
    return _row_pass(rows, inverse)


def dct_axis(table: DataFrame, axis: str, value: str = "v", size: int | None = None) -> DataFrame:
    """One-axis transform of a tensor given as cells: each line along ``axis`` is a 1-row matrix.

    ``size`` is the extent of the axis; without it the largest position of the whole table
    decides. Every line has that length: missing cells and NULL values are 0 at their
    position, lines without any cell are left out, a position beyond ``size`` is an error.
    Lines are gathered into arrays, so a value is shuffled once rather than once per frequency.
    """
    others = [c for c in table.columns if c not in (axis, value)]
    if size is None:
        extent = table.agg((F.max(axis) + 1).cast("int").alias("extent")).scalar()
    else:
        beyond = F.raise_error(F.lit(f"{axis} holds positions beyond {size}")).cast("int")
        table = table.withColumn(axis, F.when(F.col(axis) >= size, beyond).otherwise(F.col(axis)))
        extent = F.lit(size)
    cell = F.struct(F.col(axis).cast("int").alias("at"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x"))

    def zeros(count):
        return F.array_repeat(F.lit(0.0), count.cast("int"))

    def with_gap(p, t):
        before = F.when(t > 0, F.col("__line")[F.greatest(t - 1, F.lit(0))]["at"]).otherwise(F.lit(-1))
        return F.concat(zeros(p["at"] - before - 1), F.array(p["x"]))

    tail = zeros(F.col("__extent") - F.element_at("__line", -1)["at"] - 1)
    lines = (
        table.groupBy(*others)
        .agg(F.sort_array(F.collect_list(cell)).alias("__line"))
        .withColumn("__extent", extent)
        .select(
            *others,
            F.lit(1).alias("n_rows"),
            F.col("__extent").alias("n_cols"),
            F.when(F.size("__line") == F.col("__extent"), F.transform("__line", lambda p: p["x"]))
            .otherwise(F.concat(F.flatten(F.transform("__line", with_gap)), tail))
            .alias("__vals"),
        )
    )
    done = dct2d(lines, __coef="__vals")
    return done.select(*others, F.posexplode("__coef").alias(axis, value)).select(*table.columns)


def coefficients(dense: DataFrame, **arrays: str) -> DataFrame:
    """Coefficient cells at (k, l); by default column ``c`` from array ``coef``."""
    return cells(dense, at=("k", "l"), **(arrays or {"c": "coef"}))
