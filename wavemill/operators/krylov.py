"""Leading directions of wide or tall matrices by block Krylov iteration: no n x n piece, no factor of the rows.

Each matrix starts from ``rank + oversample`` seeded random directions. A pass multiplies them by WᵀW: every block of
rows adds its share to an n x s piece where it lies, and the pieces are grouped sums by column index. What the
directions found so far do not span is made orthogonal and becomes the next directions. After the passes the products
with all directions are at hand, so the best combination of them (Rayleigh-Ritz) needs no further pass, and neither does
the residual of every direction, which tells how far it is from an exact one.

A matrix of at most ``passes * (rank + oversample)`` columns is spanned whole, so its result is the exact one; of
wider ones the energy captured is close to the best, and the residuals say how close. A pass reads the rows once and
writes one record of n x s x passes numbers a matrix, from which the next one starts again if executors are lost.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavemill.operators.blocks import block_of, packed
from wavemill.operators.matrix import ID
from wavemill.session import materialize

PASSES, OVERSAMPLE = 3, 24
#: Part of a direction's length below which it counts as spanned already.
SPANNED = 1e-9
#: Values of the pieces a task keeps open at most (128 MB); one piece may be larger.
OPEN_VALUES = 1 << 24
STATE = f"{ID} string, n int, energy double, basis array<double>, images array<double>, next array<double>"


def _orthogonal(z: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Directions of ``z`` outside ``basis``, orthonormal; those without a rest of their own are zero."""
    size = np.linalg.norm(z, axis=0)
    z = np.divide(z, size, out=np.zeros_like(z), where=size > 0)
    for _ in range(2):
        z = z - basis @ (basis.T @ z)
    left, found, _ = np.linalg.svd(z, full_matrices=False)
    out = np.zeros_like(z)
    out[:, : left.shape[1]] = left * (found > SPANNED)
    for _ in range(2):
        out = out - basis @ (basis.T @ out)
    size = np.linalg.norm(out, axis=0)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0.5)


def _vectors(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *[a.size for a in arrays]])
    flat = np.concatenate([a.ravel() for a in arrays]) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.float64()))


def _started(shapes: DataFrame, wide: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, energy in zip(*(batch.column(c).to_pylist() for c in (ID, "n", "energy"))):
                drawn = np.random.default_rng([seed, zlib.crc32(name.encode())]).standard_normal((n, wide))
                nothing = np.empty((n, 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([n], pa.int32()), pa.array([energy], pa.float64()),
                     _vectors([nothing]), _vectors([nothing]), _vectors([_orthogonal(drawn, nothing)])],
                    [ID, "n", "energy", "basis", "images", "next"],
                )

    return shapes.mapInArrow(run, STATE)


def _multiplied(blocks: DataFrame, state: DataFrame, wide: int) -> DataFrame:
    """``matrix_id, image``: WᵀW times the next directions, n x s numbers a matrix."""
    line = f"{ID} string, at int, row array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: OrderedDict = OrderedDict()
        held = 0

        def lines(name: str, piece: np.ndarray) -> pa.RecordBatch:
            at = pa.array(np.arange(len(piece)), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([name] * len(piece)), at, _vectors(list(piece))], [ID, "at", "row"])

        for batch in batches:
            for k, name in enumerate(batch.column(ID).to_pylist()):
                directions = batch.column("next")[k].values.to_numpy(zero_copy_only=False).reshape(-1, wide)
                w = np.nan_to_num(block_of(pa.RecordBatch.from_struct_array(batch.column("lines")[k].values).column("row"), len(directions)))
                piece = pieces.pop(name, None)
                held += directions.size if piece is None else 0
                image = w.T @ (w @ directions)
                pieces[name] = image if piece is None else piece + image
                while held > OPEN_VALUES and len(pieces) > 1:
                    done = pieces.popitem(last=False)
                    held -= done[1].size
                    yield lines(*done)
        for done in pieces.items():
            yield lines(*done)

    shares = blocks.join(state.select(ID, "next"), ID).mapInArrow(run, line)
    summed = shares.groupBy(ID, "at").agg(F.array(*[F.sum(F.col("row")[c]) for c in range(wide)]).alias("row"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "row")))
    return summed.groupBy(ID).agg(F.flatten(F.transform(ordered, lambda x: x["row"])).alias("image"))


def _extended(state: DataFrame, images: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n in enumerate(batch.column("n").to_pylist()):
                held = {c: batch.column(c)[k].values.to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))
                        for c in ("basis", "images", "next", "image")}
                basis = np.hstack([held["basis"], held["next"]])
                seen = np.hstack([held["images"], held["image"]])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(k, 1) for c in (ID, "n", "energy")],
                     _vectors([basis]), _vectors([seen]), _vectors([_orthogonal(held["image"], basis)])],
                    [ID, "n", "energy", "basis", "images", "next"],
                )

    return state.join(images, ID).mapInArrow(run, STATE)


def leading_directions(rows: DataFrame, rank: int, passes: int = PASSES, oversample: int = OVERSAMPLE, seed: int = 0) -> DataFrame:
    """Per matrix the first ``rank`` directions, largest first, with what they hold and how exact they are.

    ``matrix_id, n, energy`` (sum of squares of the matrix), ``directions`` (rank x n numbers; zero beyond the rank of the
    matrix), ``held`` (energy along each), ``residuals`` (length of WᵀWv - held*v). NaN counts as 0 here; matrices
    without columns are left out; rows of unequal length are an error.
    """
    wide = rank + oversample
    square = F.aggregate("row", F.lit(0.0), lambda acc, x: acc + F.nanvl(x * x, F.lit(0.0)))
    shapes = rows.where(F.size("row") > 0).groupBy(ID).agg(F.max(F.size("row")).alias("n"), F.sum(square).alias("energy"))
    blocks = packed(rows.where(F.size("row") > 0).select(ID, "row"))
    state = materialize(_started(shapes, wide, seed), "directions")
    for _ in range(passes):
        state = materialize(_extended(state, _multiplied(blocks, state, wide)), "directions")
        if state.where(F.exists("next", lambda x: x != 0)).isEmpty():
            break  # all matrices are spanned

    def ritz(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, values, rests = [], [], []
            for k, n in enumerate(batch.column("n").to_pylist()):
                basis, seen = (batch.column(c)[k].values.to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("basis", "images"))
                square = basis.T @ seen
                found, mix = np.linalg.eigh((square + square.T) / 2)
                found, mix = found[::-1][:rank], mix[:, ::-1][:, :rank]
                v = basis @ mix
                vectors.append(v.T)
                values.append(np.maximum(found, 0.0))
                rests.append(np.linalg.norm(seen @ mix - v * found, axis=0))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in (ID, "n", "energy")], _vectors(vectors), _vectors(values), _vectors(rests)],
                [ID, "n", "energy", "directions", "held", "residuals"],
            )

    wanted = f"{ID} string, n int, energy double, directions array<double>, held array<double>, residuals array<double>"
    return state.select(ID, "n", "energy", "basis", "images").mapInArrow(ritz, wanted)


def along(rows: DataFrame, directions: DataFrame) -> DataFrame:
    """``rows`` with the array column ``approx``: what the directions of their matrix hold of them.

    Rows travel in blocks, so a block carries the directions once; Spark broadcasts them when they are small and
    splits hot matrices when they are not. Rows of matrices without directions go.
    """
    joined = packed(rows).join(directions.select(ID, "n", "directions"), ID)
    kept = [f.name for f in rows.schema.fields]
    schema = T.StructType([*rows.schema.fields, T.StructField("approx", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, name in enumerate(batch.column(ID).to_pylist()):
                lines = pa.RecordBatch.from_struct_array(batch.column("lines")[k].values)
                v = batch.column("directions")[k].values.to_numpy(zero_copy_only=False).reshape(-1, batch.column("n")[k].as_py())
                w = block_of(lines.column("row"), v.shape[1])
                approx = (w @ v.T) @ v
                own = {c: lines.column(c) for c in kept if c != ID} | {ID: pa.array([name] * len(w))}
                yield pa.RecordBatch.from_arrays([*[own[c] for c in kept], _vectors(list(approx))], [*kept, "approx"])

    return joined.mapInArrow(run, schema)


def low_rank(rows: DataFrame, rank: int, passes: int = PASSES, oversample: int = OVERSAMPLE) -> DataFrame:
    """Approximation of ``rank`` as an extra array column ``approx`` beside each row. ``rows`` is read passes + 2 times at most."""
    return along(rows, leading_directions(rows, rank, passes, oversample))
