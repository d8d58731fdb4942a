"""Cholesky factors in tiles: no task and no record holds an n x n matrix.

WᵀW is summed in tiles of ``side`` columns, in rounds of small fan-in. The factorisation is right-looking: step k
factors the tile on the diagonal, solves the tiles to its right, and subtracts their products from the tiles
that are left. A step joins tiles by their place, holds three tiles at a time and is written, so a lost executor costs one step.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators.matrix import ID
from wavemill.session import materialize

#: Columns of a tile: 2 MB a tile.
SIDE = 512
#: Values of the tiles a task keeps open at most (128 MB).
OPEN_VALUES = 1 << 24
#: Groups of tiles in the rounds of a sum, last to one tile a place.
ROUNDS = (32, 1)
NAMES = [ID, "n", "p", "q", "part", "tile"]
TILE = f"{ID} string, n int, p int, q int, part int, tile array<double>"


def _summed(pieces: Callable, schema: str = TILE) -> Callable:
    """A task function: adds up what ``pieces(batch)`` gives as (place, tile); oldest places go first when too many are open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tiles: OrderedDict = OrderedDict()
        held = 0

        def emit(place: tuple, tile: np.ndarray) -> pa.RecordBatch:
            name, n, p, q = place
            whole = pa.ListArray.from_arrays(pa.array([0, tile.size], pa.int32()), pa.array(tile.ravel()))
            numbers = [pa.array([x], pa.int32()) for x in (n, p, q, part)]
            return pa.RecordBatch.from_arrays([pa.array([name]), *numbers, whole], NAMES)

        for batch in batches:
            for place, tile in pieces(batch):
                known = tiles.pop(place, None)
                held += tile.size if known is None else 0
                tiles[place] = tile if known is None else known + tile
                while held > OPEN_VALUES and len(tiles) > 1:
                    place, tile = tiles.popitem(last=False)
                    held -= tile.size
                    yield emit(place, tile)
        for place, tile in tiles.items():
            yield emit(place, tile)

    return run


def gram_tiles(rows: DataFrame, side: int = SIDE, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """Upper tiles of WᵀW of matrices given by rows: ``matrix_id, n, p, q, part, tile`` (row by row), p <= q.

    A matrix of more than about 5,800 columns has more tiles than a task keeps open, and sends them once an
    Arrow batch of rows. Rows of unequal length are an error; empty rows count for nothing.
    """

    def products(batch: pa.RecordBatch):
        names = batch.column(ID).dictionary_encode()
        codes, array = names.indices.to_numpy(zero_copy_only=False), batch.column("row")
        offsets, flat = np.asarray(array.offsets), array.values.to_numpy(zero_copy_only=False)
        for code, name in enumerate(names.dictionary.to_pylist()):
            members = np.flatnonzero(codes == code)
            n = int(offsets[members[0] + 1] - offsets[members[0]])
            if (offsets[members + 1] - offsets[members] != n).any():
                raise ValueError(f"rows of unequal length in {name}")
            block = flat[offsets[members][:, None] + np.arange(n)]
            cuts = [block[:, a : a + side] for a in range(0, n, side)]
            for p, left in enumerate(cuts):
                for q in range(p, len(cuts)):
                    yield (name, n, p, q), left.T @ cuts[q]

    def again(batch: pa.RecordBatch):
        places = zip(*(batch.column(c).to_pylist() for c in (ID, "n", "p", "q")))
        for k, place in enumerate(places):
            yield place, batch.column("tile")[k].values.to_numpy(zero_copy_only=False)

    tiles = rows.where(F.size("row") > 0).select(ID, "row").mapInArrow(_summed(products), TILE)
    for groups in rounds:
        # In the order of the places: one is whole before the next is opened.
        met = tiles.withColumn("part", F.col("part") % F.lit(groups))
        met = met.repartition(ID, "n", "p", "q", "part").sortWithinPartitions(ID, "n", "p", "q", "part")
        tiles = met.mapInArrow(_summed(again), TILE)
    return tiles


def _step(table: DataFrame, arrays: list[str], work: Callable, side: int) -> DataFrame:
    """``tile`` replaced by ``work`` of the named tiles of a row, each as a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, n, p, q = (batch.column(c)[k].as_py() for c in (ID, "n", "p", "q"))
                given = [batch.column(a)[k].values.to_numpy(zero_copy_only=False) for a in arrays]
                done = np.ascontiguousarray(work(*given, min(side, n - p * side), min(side, n - q * side)))
                whole = pa.ListArray.from_arrays(pa.array([0, done.size], pa.int32()), pa.array(done.ravel()))
                numbers = [pa.array([x], pa.int32()) for x in (n, p, q)]
                yield pa.RecordBatch.from_arrays([pa.array([name]), *numbers, whole], [ID, "n", "p", "q", "tile"])

    return table.mapInArrow(run, f"{ID} string, n int, p int, q int, tile array<double>")


def _diagonal(tile, high, wide):
    return np.linalg.cholesky(tile.reshape(high, wide)).T


def _solved(tile, upper, high, wide):
    return np.linalg.solve(upper.reshape(high, high).T, tile.reshape(high, wide))


def _rest(tile, above, beside, high, wide):
    return tile.reshape(high, wide) - above.reshape(-1, high).T @ beside.reshape(-1, wide)


def cholesky_tiles(tiles: DataFrame, steps: int, side: int = SIDE) -> DataFrame:
    """Upper factor of symmetric positive definite matrices, tile by tile: ``matrix_id, n, p, q, tile``.

    ``steps`` is the number of tiles along the widest matrix; narrower ones end earlier.
    """
    rest = tiles.select(ID, "n", "p", "q", "tile")
    done = None
    for k in range(steps):
        if k:
            rest = materialize(rest, "tiles")
        corner = _step(rest.where((F.col("p") == k) & (F.col("q") == k)), ["tile"], _diagonal, side)
        panel = corner
        if k + 1 < steps:
            corner = materialize(corner, "tiles")
            beside = rest.where((F.col("p") == k) & (F.col("q") > k)).join(corner.select(ID, F.col("tile").alias("upper")), ID)
            beside = materialize(_step(beside, ["tile", "upper"], _solved, side), "tiles")
            panel = corner.unionByName(beside)
            over = beside.select(ID, F.col("q").alias("p"), F.col("tile").alias("above"))
            past = beside.select(ID, "q", F.col("tile").alias("beside"))
            left = rest.where(F.col("p") > k).join(over, [ID, "p"]).join(past, [ID, "q"])
            rest = _step(left, ["tile", "above", "beside"], _rest, side)
        done = panel if done is None else done.unionByName(panel)
    return done


def cholesky_rows(rows: DataFrame, eps: float, side: int = SIDE, width: int | None = None) -> DataFrame:
    """Upper factor of WᵀW + eps*I of matrices given by rows, as rows (matrix_id, i, row).

    ``width`` is the length of the longest row, read from the table by one aggregate if it is not given.
    """
    if width is None:
        width = rows.agg(F.max(F.size("row"))).first()[0]
    steps = max(1, -(-max(width or 0, 0) // side))
    size = F.least(F.lit(side), F.col("n") - F.col("p") * side)
    ridge = F.transform("tile", lambda x, at: x + F.when(at % (size + 1) == 0, F.lit(float(eps))).otherwise(F.lit(0.0)))
    tiles = gram_tiles(rows, side).withColumn("tile", F.when(F.col("p") == F.col("q"), ridge).otherwise(F.col("tile")))
    if steps > 1:
        tiles = materialize(tiles.drop("part"), "tiles")
    factor = cholesky_tiles(tiles, steps, side)
    wide = F.least(F.lit(side), F.col("n") - F.col("q") * side)
    cut = F.transform(F.sequence(F.lit(0), size - 1), lambda r: F.struct(
        (F.col("p") * side + r).alias("i"), F.slice("tile", r * wide + 1, wide).alias("piece")))
    pieces = factor.select(ID, "p", "q", F.explode(cut).alias("line")).select(ID, "p", "q", "line.*")
    ordered = F.array_sort(F.collect_list(F.struct("q", "piece")))
    lines = pieces.groupBy(ID, "i", "p").agg(F.flatten(F.transform(ordered, lambda x: x["piece"])).alias("piece"))
    return lines.select(ID, "i", F.concat(F.array_repeat(F.lit(0.0), F.col("p") * side), "piece").alias("row"))
