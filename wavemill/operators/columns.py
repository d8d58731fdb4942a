"""Cosine transform along columns of any length: a column is never whole in a task.

A column is folded (even places, then odd ones backwards), so that its cosine transform is a
rotation of its Fourier transform, and that is factored. A length N = a * b takes two shuffles: places
n = b * n1 + n2 meet by n2 and are transformed over n1, turned by exp(-2 pi i n2 k1 / N), meet by k1
and are transformed over n2; k = k1 + a * k2. A length without factors of at most LIMIT is written as a
convolution with exp(i pi n n / N) of length M = a * a >= 2 N - 1 (chirp): transform, product and transform
back take a third shuffle. A task holds about sqrt(N) places of a strip of columns.

Coefficients leave as segments of ``strips`` whose rows are ``step`` apart; selections, marks and scores
read them as any others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators import strips
from wavemill.operators.matrix import ID

#: Places of a column that meet in a task at most, where the length has such factors.
LIMIT = 1 << 20
WIDTH = 64
PIECE = f"{ID} string, n_rows bigint, n_cols int, l0 int, a bigint, b bigint, chirp boolean, r bigint, q bigint, part array<double>"
HEAD = (ID, "n_rows", "n_cols", "l0", "a", "b", "chirp")


@lru_cache(maxsize=4096)
def factors(length: int, limit: int) -> tuple[int, int, bool]:
    """``a, b, chirp``: the most even factors, or the side of a square that holds a convolution."""
    a = next(d for d in range(math.isqrt(length), 0, -1) if length % d == 0)
    if length // a <= limit:
        return a, length // a, False
    side = math.isqrt(2 * length - 2) + 1
    return side, side, True


def _with_factors(heights: DataFrame, limit: int) -> DataFrame:
    """``matrix_id, n_rows, a, b, chirp``, a row for each matrix of ``heights``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [factors(n, limit) for n in batch.column("n_rows").to_pylist()]
            more = [pa.array([f[c] for f in found], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(ID), batch.column("n_rows"), *more], [ID, "n_rows", "a", "b", "chirp"])

    return heights.mapInArrow(run, f"{ID} string, n_rows bigint, a bigint, b bigint, chirp boolean")


def _turn(at: np.ndarray, length: int) -> np.ndarray:
    """exp(i pi at / length) for integers, reduced before they are rounded."""
    return np.exp(1j * np.pi * (at % (2 * length)) / length)


def _chirp(at: np.ndarray, length: int) -> np.ndarray:
    """exp(i pi n n / N); the square is reduced in integers (lengths below 2**31)."""
    return _turn(at * at, length)


def _head(table: pa.Table) -> list:
    return [table.column(c)[0].as_py() for c in HEAD]


def _complex(table: pa.Table) -> np.ndarray:
    """Parts, one to a row of the table, as complex numbers."""
    flat = table.column("part").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat).reshape(table.num_rows, -1).view(np.complex128)


def _lists(block: np.ndarray) -> pa.Array:
    width = block.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(block).ravel()))


def _pieces(head: list, r: np.ndarray | int, q: np.ndarray | int, block: np.ndarray) -> pa.Table:
    count = len(block)
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
    columns = [pa.array([v] * count, k) for v, k in zip(head, kinds)]
    columns += [pa.array(np.broadcast_to(np.asarray(x, np.int64), count)) for x in (r, q)]
    return pa.Table.from_arrays([*columns, _lists(np.ascontiguousarray(block).view(np.float64))], [*HEAD, "r", "q", "part"])


def _over_first(table: pa.Table) -> pa.Table:
    """Places b * n1 + r of a strip: transform over n1, turn. Parts of one place are added. A chirp travels as a further column."""
    head, r = _head(table), table.column("r")[0].as_py()
    _, length, _, _, a, b, chirp = head
    parts, n1 = _complex(table), table.column("q").to_numpy()
    block = np.zeros((a, parts.shape[1]), complex)
    np.add.at(block, n1, parts)
    if chirp:
        at = np.arange(a, dtype=np.int64) * b + r
        near = np.where(at < length, at, a * b - at)
        wave = np.where(near < length, _chirp(np.minimum(near, length), length), 0.0)
        # Places from N on hold 0, so the wave behind them does not matter.
        block = np.concatenate([block * np.conj(wave)[:, None], wave[:, None]], axis=1)
    done = np.fft.fft(block, axis=0) * _turn(-2 * r * np.arange(a, dtype=np.int64), a * b)[:, None]
    return _pieces(head, r, np.arange(a), done)


def _over_second(table: pa.Table) -> tuple[list, int, np.ndarray]:
    """All r of one k1: transform over them; row k2 is the coefficient k1 + a * k2."""
    table = table.sort_by("r")
    return _head(table), table.column("q")[0].as_py(), np.fft.fft(_complex(table), axis=0)


def _product(table: pa.Table) -> pa.Table:
    """The product with the chirp's transform, back over k2."""
    head, q, done = _over_second(table)
    a, b = head[4:6]
    back = np.fft.ifft(done[:, :-1] * done[:, -1:], axis=0) * _turn(2 * q * np.arange(b, dtype=np.int64), a * b)[:, None]
    return _pieces(head, np.arange(b), q, back)


def _convolved(table: pa.Table) -> tuple[list, int, np.ndarray]:
    """Back over k1: row n1 is the Fourier coefficient b * n1 + r, as far as the length goes."""
    table = table.sort_by("q")
    head, r = _head(table), table.column("r")[0].as_py()
    _, length, _, _, a, b, _ = head
    at = np.arange(a, dtype=np.int64) * b + r
    inside = at < length
    done = np.fft.ifft(_complex(table), axis=0)[inside]
    return head, r, done * np.conj(_chirp(at[inside], length))[:, None]


def _fourier(placed: DataFrame, chirp: bool, finish, schema: str) -> DataFrame:
    """Fourier transform of ``placed`` (PIECE, place = b * q + r); ``finish(head, first, step, block)`` makes the result."""

    def direct(table: pa.Table) -> pa.Table:
        head, q, done = _over_second(table)
        return finish(head, q, head[4], done)

    def chirped(table: pa.Table) -> pa.Table:
        head, r, done = _convolved(table)
        return finish(head, r, head[5], done)

    turned = placed.groupBy(ID, "l0", "r").applyInArrow(_over_first, PIECE)
    if not chirp:
        return turned.groupBy(ID, "l0", "q").applyInArrow(direct, schema)
    product = turned.groupBy(ID, "l0", "q").applyInArrow(_product, PIECE)
    return product.groupBy(ID, "l0", "r").applyInArrow(chirped, schema)


def forward(rows: DataFrame, width: int = WIDTH, limit: int = LIMIT) -> DataFrame:
    """Segments of the two-dimensional transform of matrices given as ``matrix_id, i, row`` with i = 0, 1, ...

    A part holds ``width`` columns. Rows of unequal length are an error, as are positions whose extent and
    number differ; a repeat that fills in for a gap is not told (``rows_from_vectors`` makes neither).
    """
    checked = rows.groupBy(ID).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("i").alias("low"), F.max("i").alias("high"),
        F.min(F.size("row")).alias("short"), F.max(F.size("row")).alias("long"),
    )
    fault = (F.col("low") != 0) | (F.col("high") != F.col("n_rows") - 1)
    heights = checked.select(
        ID,
        F.when(fault, F.raise_error(F.lit("positions are not 0, 1, ..")).cast("bigint"))
        .when(F.col("short") != F.col("long"), F.raise_error(F.lit("rows of unequal length")).cast("bigint"))
        .otherwise(F.col("n_rows")).alias("n_rows"),
    )
    factored = _with_factors(heights, limit)

    def placed(chirp: bool) -> DataFrame:
        # The kind is settled before a row is transformed, so each row goes one way only.
        sized = factored.where(F.col("chirp") == F.lit(chirp))
        parts = strips.parts_of_rows(rows.join(sized.select(ID), ID).withColumnRenamed("i", "at"), width).join(sized, ID)
        half = F.floor(F.col("at") / 2).cast("bigint")
        place = F.when(F.col("at") % 2 == 0, half).otherwise(F.col("n_rows") - 1 - half)
        return parts.withColumn("p", place).select(
            ID, "n_rows", "n_cols", "l0", "a", "b", "chirp", (F.col("p") % F.col("b")).alias("r"),
            F.floor(F.col("p") / F.col("b")).cast("bigint").alias("q"),
            F.flatten(F.transform("part", lambda x: F.array(x, F.lit(0.0)))).alias("part"),
        )

    def finish(head: list, first: int, step: int, block: np.ndarray) -> pa.Table:
        name, length, n_cols, l0 = head[:4]
        k = first + step * np.arange(len(block), dtype=np.int64)
        scale = np.where(k == 0, np.sqrt(1.0 / length), np.sqrt(2.0 / length))
        coef = (block * (scale * np.exp(-0.5j * np.pi * k / length))[:, None]).real
        return pa.Table.from_batches(list(strips.segments_of(name, coef, n_cols, l0, length, first, step)))

    kinds = (_fourier(placed(chirp), chirp, finish, strips.SEGMENT) for chirp in (False, True))
    return next(kinds).unionByName(next(kinds))


def inverse(segments: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``matrix_id, i, row`` of matrices given as segments, of whatever steps."""
    heights = segments.groupBy(ID).agg(F.first("n_rows").alias("n_rows"))
    factored = _with_factors(heights, limit)
    kept = [*HEAD, "k0", "step", "width", "coef"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The conjugate spectrum: coefficient k adds to the places k and N - k."""
        for batch in batches:
            for row in range(batch.num_rows):
                head = [batch.column(c)[row].as_py() for c in HEAD]
                k0, step, width = (batch.column(c)[row].as_py() for c in ("k0", "step", "width"))
                length, b = head[1], head[5]
                block = batch.column("coef")[row].values.to_numpy(zero_copy_only=False).reshape(-1, width)
                k = k0 + step * np.arange(len(block), dtype=np.int64)

                def weight(at: np.ndarray) -> np.ndarray:
                    scale = np.where(at == 0, np.sqrt(float(length)), np.sqrt(length / 2.0))
                    return scale * np.exp(-0.5j * np.pi * at / length)

                own = block * weight(k)[:, None]
                yield from _pieces(head, k % b, k // b, own).to_batches()
                rest = length - k[k > 0]
                if len(rest):
                    mirrored = 1j * block[k > 0] * weight(rest)[:, None]
                    yield from _pieces(head, rest % b, rest // b, mirrored).to_batches()

    def finish(head: list, first: int, step: int, block: np.ndarray) -> pa.Table:
        name, length, _, l0 = head[:4]
        p = first + step * np.arange(len(block), dtype=np.int64)
        at = np.where(p < (length + 1) // 2, 2 * p, 2 * (length - 1 - p) + 1)
        count = len(block)
        columns = [pa.array([name] * count, pa.string()), pa.array(at), pa.array(np.full(count, l0, np.int32))]
        return pa.Table.from_arrays([*columns, _lists(block.real / length)], [ID, "at", "l0", "part"])

    def parts(chirp: bool) -> DataFrame:
        sized = segments.drop("n_rows").join(factored.where(F.col("chirp") == F.lit(chirp)), ID)
        return _fourier(sized.select(*kept).mapInArrow(spread, PIECE), chirp, finish, strips.PART)

    return strips.rows_from_parts(parts(False).unionByName(parts(True)))
