"""Triangular factors and low-rank approximation of row tables of any height.

Rows never have to meet: each task reduces the rows it sees to small n x n
pieces, and the pieces are combined in rounds of small fan-in.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavemill.operators import runs
from wavemill.operators.matrix import ID, dense_from_cells
from wavemill.operators.transform import map_matrices

# Fixed value: added to the diagonal before the Cholesky factorisation.
RIDGE = 1e-6
#: Values of the pieces a task keeps open at most (128 MB); one piece may be larger.
OPEN_VALUES = 1 << 24
#: Groups of pieces in the rounds of a merge, last to one piece a matrix.
ROUNDS = (1024, 32, 1)


def _reduce_in_tasks(rows: DataFrame, start: Callable, fold: Callable) -> DataFrame:
    """Fold each matrix's rows into one piece per task; pieces beyond OPEN_VALUES values are emitted, oldest first."""

    def run(batches):
        part = TaskContext.get().partitionId()
        open_pieces: OrderedDict = OrderedDict()
        held = 0

        def emit(items):
            ids, at, lines = [], [], []
            for matrix, piece in items:
                for index, line in enumerate(piece):
                    ids.append(matrix)
                    at.append(index)
                    lines.append(line)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.string()),
                    pa.array([part] * len(ids), pa.int32()),
                    pa.array(at, pa.int32()),
                    pa.array(lines, pa.list_(pa.float64())),
                ],
                [ID, "part", "at", "row"],
            )

        for batch in batches:
            spare = []
            names = batch.column(ID).dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False)
            array = batch.column("row")
            offsets = np.asarray(array.offsets)
            flat = array.values.to_numpy(zero_copy_only=False)
            for code, matrix in enumerate(names.dictionary.to_pylist()):
                members = np.flatnonzero(codes == code)
                width = offsets[members[0] + 1] - offsets[members[0]]
                block = flat[offsets[members][:, None] + np.arange(width)[None, :]]
                piece = open_pieces.pop(matrix, None)
                held -= 0 if piece is None else piece.size
                open_pieces[matrix] = fold(start(width) if piece is None else piece, block)
                held += open_pieces[matrix].size
                while held > OPEN_VALUES and len(open_pieces) > 1:
                    spare.append(open_pieces.popitem(last=False))
                    held -= spare[-1][1].size
                if sum(p.size for _, p in spare) > OPEN_VALUES:
                    yield emit(spare)
                    spare = []
            if spare:
                yield emit(spare)
        if open_pieces:
            yield emit(open_pieces.items())

    return rows.select(ID, "row").mapInArrow(run, f"{ID} string, part int, at int, row array<double>")


def _triangle(block: np.ndarray) -> np.ndarray:
    """R of a block with a diagonal that is not negative; NaN rows give a NaN factor."""
    r = np.linalg.qr(block, mode="r")
    signs = np.where(np.diagonal(r) < 0, -1.0, 1.0)
    return signs[:, None] * r


def qr_r(rows: DataFrame, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """Upper-triangular R of each matrix as rows (matrix_id, i, row), diagonal >= 0.

    R is unique up to signs when the leading columns have full rank, so the order
    of the rows does not matter. The rows of a piece stand for the rows it was made from, so
    pieces are folded as rows are: a round sends them to ``g`` groups of a matrix and folds
    what arrives as it is read, holding one piece and one batch whatever the fan-in.
    """
    def fold(piece, block):
        return _triangle(np.concatenate([piece, block]))

    pieces = _reduce_in_tasks(rows, lambda width: np.empty((0, width)), fold)
    for groups in rounds:
        # In the order of the matrices: a piece is whole before the next one is opened.
        met = pieces.withColumn("part", F.col("part") % F.lit(groups)).repartition(ID, "part").sortWithinPartitions(ID, "part")
        pieces = _reduce_in_tasks(met, lambda width: np.empty((0, width)), fold)
    return pieces.select(ID, F.col("at").alias("i"), "row")


def gram(rows: DataFrame) -> DataFrame:
    """Products of column pairs, WᵀW, as cells (matrix_id, n_rows, n_cols, i, j, v)."""

    def fold(piece, block):
        return piece + block.T @ block

    pieces = _reduce_in_tasks(rows, lambda width: np.zeros((width, width)), fold)
    return (
        pieces.select(ID, F.col("at").alias("i"), F.size("row").alias("n"), F.posexplode("row").alias("j", "v"))
        .groupBy(ID, "n", "i", "j")
        .agg(F.sum("v").alias("v"))
        .select(ID, F.col("n").alias("n_rows"), F.col("n").alias("n_cols"), "i", "j", "v")
    )


def _upper_factor(stack: np.ndarray) -> np.ndarray:
    return np.swapaxes(np.linalg.cholesky(stack), -1, -2)


def cholesky_r(rows: DataFrame, eps: float = RIDGE) -> DataFrame:
    """Upper factor of WᵀW + eps*I per matrix, as dense records with array ``factor``."""
    ridge = F.when(F.col("i") == F.col("j"), F.lit(float(eps))).otherwise(F.lit(0.0))
    square = dense_from_cells(gram(rows), vals=F.col("v") + ridge)
    return map_matrices(square, {"factor": "vals"}, _upper_factor)


def select_qr_runs(rows: DataFrame, fraction: float = 0.25) -> DataFrame:
    """The rows whose R row has the largest norm, all columns of each, as runs of positions.

    R has at most as many rows as columns; further rows have norm 0 and follow in order, so they are
    one run whatever their number.
    """
    norms = qr_r(rows).select(
        ID,
        F.col("i").cast("bigint").alias("i"),
        F.size("row").alias("n_cols"),
        F.sqrt(F.aggregate("row", F.lit(0.0), lambda acc, x: acc + x * x)).alias("norm"),
    )
    heights = rows.groupBy(ID).agg(F.count(F.lit(1)).alias("m"))
    quota = F.greatest(F.lit(1), F.floor(F.col("m") * F.lit(float(fraction))))
    by_norm = Window.partitionBy(ID).orderBy(F.desc("norm"), "i")
    ranked = norms.join(heights, ID).withColumn("__place", F.row_number().over(by_norm))
    leading = ranked.where(F.col("__place") <= quota).select(ID, "n_cols", F.col("i").alias("low"), F.col("i").alias("high"))
    known = ranked.groupBy(ID, "n_cols", "m").agg(F.count(F.lit(1)).alias("known")).where(quota > F.col("known"))
    trailing = known.select(ID, "n_cols", F.col("known").alias("low"), (quota - 1).alias("high"))
    spans = leading.unionByName(trailing)
    ends = spans.select(ID, "n_cols", (F.col("low") * F.col("n_cols")).alias("first"), ((F.col("high") + 1) * F.col("n_cols") - 1).alias("last"))
    return runs.merged(ends)


def select_qr_rows(rows: DataFrame, fraction: float = 0.25) -> DataFrame:
    """``select_qr_runs`` as places (matrix_id, k, l)."""
    return runs.places(select_qr_runs(rows, fraction))


def leading_directions(rows: DataFrame, rank: int) -> DataFrame:
    """First ``rank`` right singular vectors of each matrix, from its small factor R."""

    def directions(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        packed = table.column("row").combine_chunks()
        r = packed.values.to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        v = np.linalg.svd(np.nan_to_num(r), full_matrices=False)[2][:rank]
        return pa.table(
            {
                ID: pa.array([table.column(ID)[0].as_py()], pa.string()),
                "directions": pa.array([v.ravel()], pa.list_(pa.float64())),
            }
        )

    return qr_r(rows).groupBy(ID).applyInArrow(directions, f"{ID} string, directions array<double>")


def low_rank(rows: DataFrame, rank: int = 8) -> DataFrame:
    """Best approximation of ``rank`` as an extra array column ``approx`` beside each row.

    The directions (rank x n numbers per matrix) are joined to the rows; Spark
    broadcasts them when they are small and splits hot matrices when they are not.
    """
    joined = rows.join(leading_directions(rows, rank), ID)
    keep = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("approx", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            array, packed = batch.column("row"), batch.column("directions")
            offsets, v_offsets = np.asarray(array.offsets), np.asarray(packed.offsets)
            flat = array.values.to_numpy(zero_copy_only=False)
            v_flat = packed.values.to_numpy(zero_copy_only=False)
            out = np.empty_like(flat)
            lengths = np.stack([np.diff(offsets), np.diff(v_offsets)], axis=1)
            for width, size in np.unique(lengths, axis=0):
                members = np.flatnonzero((lengths == (width, size)).all(axis=1))
                where = offsets[members][:, None] + np.arange(width)[None, :]
                v = v_flat[v_offsets[members][:, None] + np.arange(size)[None, :]]
                v = v.reshape(len(members), size // width, width)
                scores = np.einsum("brn,bn->br", v, flat[where])
                out[where] = np.einsum("br,brn->bn", scores, v)
            approx = pa.ListArray.from_arrays(array.offsets, pa.array(out))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], approx], [*keep, "approx"])

    return joined.mapInArrow(run, schema)
