"""Rows packed into blocks where they lie, so that a join carries its other side once a block, not once a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wavemill.operators.matrix import ID

#: Values of a block at most (8 MB); one row may be larger.
BLOCK_VALUES = 1 << 20


def packed(rows: DataFrame, limit: int = BLOCK_VALUES) -> DataFrame:
    """``matrix_id, lines``: consecutive rows of a matrix as an array of structs of all other columns; no shuffle.

    A block ends with its Arrow batch or at ``limit`` values of ``row``. Missing and empty rows are packed as well.
    """
    others = [f for f in rows.schema.fields if f.name != ID]
    inner = T.StructType(others)
    names = inner.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(ID).dictionary_encode()
            keys = codes.indices.fill_null(len(codes.dictionary)).to_numpy()
            order = np.argsort(keys, kind="stable")
            lengths = batch.column("row").value_lengths().fill_null(0).to_numpy()[order].astype(np.int64)
            keys = keys[order]
            fresh = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            before = np.cumsum(lengths) - lengths
            chunk = (before - np.repeat(before[fresh], np.diff(np.r_[fresh, len(keys)]))) // max(limit, 1)
            cut = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (chunk[1:] != chunk[:-1])])
            placed = pa.array(order)
            lines = pa.StructArray.from_arrays([batch.column(c).take(placed) for c in names], fields=list(batch.select(names).schema))
            ends = pa.array(np.r_[cut, len(keys)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(ID).take(pa.array(order[cut])), pa.ListArray.from_arrays(ends, lines)], [ID, "lines"]
            )

    schema = T.StructType([T.StructField(ID, T.StringType()), T.StructField("lines", T.ArrayType(inner))])
    return rows.select(ID, *names).mapInArrow(run, schema)


def block_of(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of one matrix as an array of ``width`` columns; rows of another length are an error."""
    lengths = lists.value_lengths().fill_null(0).to_numpy()
    if (lengths != width).any():
        raise ValueError(f"rows of unequal length: {width} and {lengths[lengths != width][0]}")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)
