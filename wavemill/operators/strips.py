"""Tall matrices that stay in strips of columns: transform, selection, inverse and scores without a whole record.

Rows are transformed where they lie, cut into strips of a few columns and sent to their strip by
one shuffle; the order of the rows is that of their key, so none has to be ranked before. A strip
is transformed along its columns and handed on in segments: (matrix_id, n_rows, n_cols, k0, step, l0,
width, coef), ``coef`` the coefficients of rows k0, k0 + step, .. and columns l0..l0 + width, row by row.
Columns too long for a task go through ``columns``, which gives segments too. All later steps read segments; no record of a matrix is gathered and no cell becomes a row.

Selections descend by radix. The key of a coefficient is the bits of its value, largest first, then
its position; it is cut into digits of DIGIT bits. Each pass sums the weights of one digit for the
coefficients that still share the edge's digits, map-side first, and finds the digit in which
the limit is passed. Where NEAR coefficients or fewer share the first digit, those are put in order
instead. The last digit leaves one coefficient as the edge, so a selection is exact
whatever the number of equal or close values, and no task orders the coefficients of a matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions import cosine
from wavemill.operators.matrix import ID
from wavemill.operators.selection import TAU, TINY, TOP_FRACTION
from wavemill.session import materialize

WIDTH = 8
#: Values of a segment at most (or one row of its strip): 8 MB.
SEGMENT_VALUES = 1 << 20
DIGIT = 21
#: Digits of a value's bits (63 of them, the sign is never set), then of the position.
VALUE_DIGITS, PLACE_DIGITS = 3, 2
#: So many coefficients that share the edge's first digit are put in order at once; more go digit by digit.
NEAR = 1 << 16
SEGMENT = f"{ID} string, n_rows bigint, n_cols int, k0 bigint, step bigint, l0 int, width int, coef array<double>"
PART = f"{ID} string, at bigint, l0 int, part array<double>"
NAMES = [ID, "n_rows", "n_cols", "k0", "step", "l0", "width", "coef"]
PLACE = ("k0", "step", "l0", "width", "n_cols")


def vectors_by_key(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """``matrix_id, at, row``: the vectors of a group are the rows of its matrix, in the order of ``at``."""
    return df.select(F.col(group).cast("string").alias(ID), F.col(key).alias("at"), F.col(vector).cast("array<double>").alias("row"))


def _rows_of(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    values = batch.column(column)
    offsets = np.asarray(values.offsets)
    flat = values.values.to_numpy(zero_copy_only=False)
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield flat[a:b]


def _along_rows(rows: DataFrame, kernel: Callable) -> DataFrame:
    """``kernel`` on every row, rows of one length together."""
    schema = f"{ID} string, at {dict(rows.dtypes)['at']}, row array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            array = batch.column("row")
            offsets = np.asarray(array.offsets)
            flat = array.values.to_numpy(zero_copy_only=False)
            done = np.empty(len(flat))
            lengths = np.diff(offsets)
            for size in np.unique(lengths[lengths > 0]):
                where = offsets[:-1][lengths == size][:, None] + np.arange(size)
                done[where] = kernel(flat[where])
            yield pa.RecordBatch.from_arrays([batch.column(ID), batch.column("at"), pa.ListArray.from_arrays(array.offsets, pa.array(done))], [ID, "at", "row"])

    return rows.select(ID, "at", "row").mapInArrow(run, schema)


def parts_of_rows(rows: DataFrame, width: int) -> DataFrame:
    """``matrix_id, at, n_cols, l0, part``: rows transformed along themselves and cut into ``width`` columns."""
    passed = _along_rows(rows, cosine.forward_last)
    starts = F.sequence(F.lit(0), F.size("row") - 1, F.lit(width))
    pieces = F.transform(starts, lambda s: F.struct(s.alias("l0"), F.slice("row", s + 1, F.lit(width)).alias("part")))
    cut = passed.where(F.size("row") > 0).select(ID, "at", F.size("row").alias("n_cols"), F.explode(pieces).alias("s"))
    return cut.select(ID, "at", "n_cols", "s.l0", "s.part")


def forward(rows: DataFrame, width: int = WIDTH, placed: bool = False) -> DataFrame:
    """Segments of the two-dimensional transform of matrices given as ``matrix_id, at, row``; one shuffle.

    A task holds ``width`` columns of a matrix. Rows of unequal length are an error. ``at`` orders the rows; if
    ``placed``, it is their position from 0, and rows that are missing before the last one are zero.
    """
    strips = parts_of_rows(rows, width)

    def down(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n_cols = np.unique(table.column("n_cols").to_numpy())
        if len(n_cols) > 1:
            raise ValueError(f"rows of unequal length: {n_cols[0]} and {n_cols[-1]}")
        table = table.sort_by("at")
        l0 = table.column("l0")[0].as_py()
        block = table.column("part").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        if placed:
            at = table.column("at").to_numpy()
            whole = np.zeros((at[-1] + 1, block.shape[1]))
            whole[at] = block
            block = whole
        done = np.ascontiguousarray(cosine.forward_last(np.ascontiguousarray(block.T)).T)
        return segments_of(table.column(ID)[0].as_py(), done, int(n_cols[0]), l0)

    def each(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(down(table)))

    return strips.groupBy(ID, "l0").applyInArrow(each, SEGMENT)


def segments_of(name: str, block: np.ndarray, n_cols: int, l0: int, n_rows: int | None = None, k0: int = 0, step: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows k0, k0 + step, .. of a strip as records of SEGMENT_VALUES values at most."""
    height, width = block.shape
    rows = max(1, SEGMENT_VALUES // width)
    for start in range(0, height, rows):
        part = block[start : start + rows]
        values = pa.ListArray.from_arrays(pa.array([0, part.size], pa.int32()), pa.array(part.ravel()))
        columns = [[name], [n_rows or height], [n_cols], [k0 + step * start], [step], [l0], [width]]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), values], NAMES)


def _places(k0: int, step: int, l0: int, width: int, n_cols: int, size: int) -> np.ndarray:
    """Position in the matrix, row by row, of each value of a segment."""
    at = np.arange(size, dtype=np.int64)
    return (k0 + step * (at // width)) * n_cols + l0 + at % width


def _digits(values: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """Digits of the keys, most significant first; each falls as the order goes on but those of the place, which rise."""
    bits, mask = values.view(np.int64), (1 << DIGIT) - 1
    of_value = [bits >> DIGIT * (VALUE_DIGITS - 1 - d) & mask for d in range(VALUE_DIGITS)]
    return of_value + [places >> DIGIT * (PLACE_DIGITS - 1 - d) & mask for d in range(PLACE_DIGITS)]


def _digit_sums(segments: DataFrame, state: DataFrame, depth: int, measure: Callable) -> DataFrame:
    """The columns of ``state`` with ``digit`` and ``w``: weights by the digit at ``depth``, of what shares the edge's
    digits before it. A segment without any gives digit -1 and weight 0, so no matrix is lost."""
    carried = [ID, "limit", "before", *[f"d{d}" for d in range(depth)]]
    joined = segments.join(state, ID).select(*carried, *PLACE, "coef")
    schema = ", ".join(f"{c} {t}" for c, t in joined.dtypes if c in carried) + ", digit bigint, w double, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            digits, weights, counts = [], [], []
            shapes = zip(*(batch.column(c).to_pylist() for c in (*PLACE, *carried[3:])))
            for (k0, step, l0, width, n_cols, *edge), c in zip(shapes, _rows_of(batch, "coef")):
                value, weight = measure(c)
                cut = _digits(value, _places(k0, step, l0, width, n_cols, len(c)))
                inside = np.ones(len(c), bool)
                for have, want in zip(cut, edge):
                    inside &= have == want
                some, at = np.unique(cut[depth][inside], return_inverse=True)
                sums = np.bincount(at, weights=weight[inside], minlength=len(some))
                digits.append(some if len(some) else np.array([-1]))
                weights.append(sums if len(some) else np.zeros(1))
                counts.append(np.bincount(at, minlength=len(some)) if len(some) else np.zeros(1, np.int64))
            rows = pa.array(np.repeat(np.arange(batch.num_rows), [len(d) for d in digits]))
            columns = [batch.column(c).take(rows) for c in carried]
            more = [pa.array(np.concatenate(x), t) for x, t in ((digits, pa.int64()), (weights, pa.float64()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, *more], [*carried, "digit", "w", "n"])

    return joined.mapInArrow(run, schema).groupBy(*carried, "digit").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))


def _near_edge(segments: DataFrame, state: DataFrame, measure: Callable) -> DataFrame:
    """``state`` with all digits, for matrices of which few coefficients share the edge's first: those are put in order.

    A segment without any gives a row of digits -1 and weight 0, so no matrix is lost.
    """
    joined = segments.join(state, ID).select(ID, "limit", "before", "d0", *PLACE, "coef")
    rest = [f"d{d}" for d in range(1, VALUE_DIGITS + PLACE_DIGITS)]
    schema = ", ".join([f"{ID} string, limit double, before double, d0 bigint", *(f"{d} bigint" for d in rest), "w double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found, weights, counts = [], [], []
            shapes = zip(*(batch.column(c).to_pylist() for c in (*PLACE, "d0")))
            for (k0, step, l0, width, n_cols, first), c in zip(shapes, _rows_of(batch, "coef")):
                value, weight = measure(c)
                cut = _digits(value, _places(k0, step, l0, width, n_cols, len(c)))
                inside = cut[0] == first
                found.append(np.stack(cut[1:], axis=1)[inside] if inside.any() else np.full((1, len(rest)), -1))
                weights.append(weight[inside] if inside.any() else np.zeros(1))
                counts.append(len(weights[-1]))
            rows = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            digits = np.concatenate(found)
            columns = [batch.column(c).take(rows) for c in (ID, "limit", "before", "d0")]
            columns += [pa.array(np.ascontiguousarray(digits[:, d]), pa.int64()) for d in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(weights), pa.float64())], [ID, "limit", "before", "d0", *rest, "w"])

    known = [ID, "limit", "before", "d0"]
    falls = [F.col(f"d{d}").desc() for d in range(1, VALUE_DIGITS)] + [F.col(d).asc() for d in rest[VALUE_DIGITS - 1 :]]
    order = Window.partitionBy(*known).orderBy(*falls)
    run_sum = F.col("before") + F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = joined.mapInArrow(run, schema).withColumn("run", run_sum).withColumn("at", F.row_number().over(order))
    passed = F.when((F.col("run") > F.col("limit")) | F.isnan("limit"), F.struct("at", *rest))
    edge = placed.groupBy(*known).agg(F.min(passed).alias("edge"))
    return edge.select(*known, *[F.coalesce(f"edge.{d}", F.lit(-1)).alias(d) for d in rest])


def _edges(segments: DataFrame, limits: DataFrame, measure: Callable) -> DataFrame:
    """``matrix_id, limit, d0, d1, ..``: digits of the first coefficient in order with which a matrix passes its limit.

    A digit of -1 at a value stands for "none: all are kept". A limit of NaN lets nothing through.
    """
    state, near = limits.select(ID, "limit", F.lit(0.0).alias("before")), None
    for depth in range(VALUE_DIGITS + PLACE_DIGITS):
        falls = depth < VALUE_DIGITS
        known = [ID, "limit", "before", *[f"d{d}" for d in range(depth)]]
        order = Window.partitionBy(*known).orderBy(F.desc("digit") if falls else F.asc("digit"))
        run = F.col("before") + F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))
        sums = _digit_sums(segments, state, depth, measure).withColumn("run", run)
        passed = F.when((F.col("run") > F.col("limit")) | F.isnan("limit"), F.struct("digit", (F.col("run") - F.col("w")).alias("next"), "n"))
        edge = sums.groupBy(*known).agg((F.max if falls else F.min)(passed).alias("edge"))
        state = edge.select(
            ID, "limit", F.coalesce("edge.next", "before").alias("before"), *known[3:], F.coalesce("edge.digit", F.lit(-1)).alias(f"d{depth}"),
            F.coalesce("edge.n", F.lit(0)).alias("n"),
        )
        if depth == 0:
            near = _near_edge(segments, state.where(F.col("n") <= NEAR), measure)
            state = state.where(F.col("n") > NEAR)
        state = state.drop("n")
    return state.unionByName(near).drop("before")


def _mark(segments: DataFrame, edges: DataFrame, measure: Callable, out: str) -> DataFrame:
    """Add ``out``: which coefficients of each segment come before their matrix's edge."""
    names = [f"d{d}" for d in range(VALUE_DIGITS + PLACE_DIGITS)]
    joined = segments.join(edges, ID)
    kept = [c for c in segments.columns if c != out]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in segments.dtypes if c != out), f"`{out}` array<boolean>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            shapes = zip(*(batch.column(c).to_pylist() for c in (*PLACE, "limit", *names)))
            for (k0, step, l0, width, n_cols, limit, *edge), c in zip(shapes, _rows_of(batch, "coef")):
                if np.isnan(limit):
                    marks.append(np.zeros(len(c), bool))
                    continue
                cut = _digits(measure(c)[0], _places(k0, step, l0, width, n_cols, len(c)))
                keep, even = np.zeros(len(c), bool), np.ones(len(c), bool)
                for d, (have, want) in enumerate(zip(cut, edge)):
                    keep |= even & (have > want if d < VALUE_DIGITS else have < want)
                    even &= have == want
                marks.append(keep)
            offsets = batch.column("coef").offsets
            flags = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(marks) if marks else np.zeros(0, bool)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), flags], [*kept, out])

    return joined.select(*kept, "limit", *names).mapInArrow(run, schema)


def _energy(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return c * c, c * c


def _weight(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return c, c


def _size(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.abs(c), np.ones(len(c))


def _array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def select_energy(segments: DataFrame, tau: float = TAU, out: str = "keep") -> DataFrame:
    """Keep the largest coefficients while their energy stays within ``tau`` of the matrix's; the one that crosses
    is left out. An all-zero matrix keeps everything, one with a NaN nothing.

    The segments are read once a digit: pass a written table.
    """
    energy = _array_sum(F.transform("coef", lambda c: c * c))
    limits = segments.groupBy(ID).agg((F.lit(float(tau)) * F.sum(energy)).alias("limit"))
    return _mark(segments, _edges(segments, limits, _energy), _energy, out)


def select_weight(segments: DataFrame, tau: float = TAU, out: str = "keep") -> DataFrame:
    """``select_energy`` of numbers that are weights already (not negative), such as shares."""
    limits = segments.groupBy(ID).agg((F.lit(float(tau)) * F.sum(_array_sum(F.col("coef")))).alias("limit"))
    return _mark(segments, _edges(segments, limits, _weight), _weight, out)


def select_largest(segments: DataFrame, count: Column, out: str = "keep") -> DataFrame:
    """Keep the ``count`` (from n_rows and n_cols) largest magnitudes of each matrix, ties by position."""
    limits = segments.groupBy(ID).agg(F.first("n_rows").alias("n_rows"), F.first("n_cols").alias("n_cols")).select(ID, count.cast("double").alias("limit"))
    return _mark(segments, _edges(segments, limits, _size), _size, out)


def fraction_count(fraction: float = TOP_FRACTION) -> Column:
    return F.greatest(F.lit(1), F.floor(F.col("n_rows") * F.col("n_cols") * F.lit(float(fraction))))


def retained(marked: DataFrame, keep: str = "keep") -> DataFrame:
    """``matrix_id, total, kept, retained``: coefficients, those kept and their part of the energy; sums of segments."""
    energy = F.transform("coef", lambda c: c * c)
    part = F.zip_with(energy, keep, lambda e, k: F.when(k, e).otherwise(0.0))
    sums = marked.groupBy(ID).agg(
        F.sum(F.size("coef").cast("bigint")).alias("total"),
        F.sum(F.size(F.filter(keep, lambda k: k)).cast("bigint")).alias("kept"),
        F.sum(_array_sum(part)).alias("__kept"), F.sum(_array_sum(energy)).alias("__energy"),
    )
    share = F.col("__kept") / (F.col("__energy") + F.lit(TINY))
    return sums.select(ID, "total", "kept", F.nanvl(share, F.lit(0.0)).alias("retained"))


def keep_only(marked: DataFrame, keep: str = "keep") -> DataFrame:
    """Segments whose coefficients are 0 where they are not kept: what an inverse projects onto the selection."""
    zeroed = F.zip_with("coef", keep, lambda c, k: F.when(k, c).otherwise(0.0))
    return marked.select(*[c for c in NAMES if c != "coef"], zeroed.alias("coef"))


def inverse(segments: DataFrame) -> DataFrame:
    """``matrix_id, i, row`` of matrices given as segments: a strip's columns in a task, then each row; two shuffles.

    For segments of ``forward``; those of ``columns.forward`` go back by ``columns.inverse``.
    """

    def up(table: pa.Table) -> pa.Table:
        table = table.sort_by("k0")
        width = table.column("width")[0].as_py()
        block = table.column("coef").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, width)
        if len(block) != table.column("n_rows")[0].as_py() or table.column("step")[0].as_py() != 1:
            raise ValueError("segments of a strip are missing, or interleaved")
        done = np.ascontiguousarray(cosine.inverse_last(np.ascontiguousarray(block.T)).T)
        offsets = pa.array(np.arange(len(done) + 1, dtype=np.int32) * width)
        columns = [pa.array([table.column(ID)[0].as_py()] * len(done)), pa.array(np.arange(len(done))), pa.array(np.full(len(done), table.column("l0")[0].as_py(), np.int32))]
        return pa.Table.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(done.ravel()))], [ID, "at", "l0", "part"])

    return rows_from_parts(segments.groupBy(ID, "l0").applyInArrow(up, PART))


def _gathered(parts: DataFrame) -> DataFrame:
    """The parts of a row (``matrix_id, at, l0, part``) put in order: ``matrix_id, at, row``. As many parts as strips."""
    ordered = F.array_sort(F.collect_list(F.struct("l0", "part")))
    return parts.groupBy(ID, "at").agg(F.flatten(F.transform(ordered, lambda p: p["part"])).alias("row"))


def rows_from_parts(parts: DataFrame) -> DataFrame:
    """Parts of rows put together and inverted along the row: ``matrix_id, i, row``."""
    return _along_rows(_gathered(parts), cosine.inverse_last).withColumnRenamed("at", "i")


def coefficient_rows(segments: DataFrame) -> DataFrame:
    """``matrix_id, i, row``: the coefficients with k = i, for what weighs a row of the matrix by them."""
    starts = F.sequence(F.lit(0), F.floor(F.size("coef") / F.col("width")).cast("int") - 1)
    cut = F.transform(
        starts,
        lambda r: F.struct(
            (F.col("k0") + F.col("step") * r).alias("at"), F.slice("coef", r * F.col("width") + 1, F.col("width")).alias("part")
        ),
    )
    parts = segments.select(ID, "l0", F.explode(cut).alias("s")).select(ID, "s.at", "l0", "s.part")
    return _gathered(parts).withColumnRenamed("at", "i")


def energy_profile(segments: DataFrame, out: str = "share") -> DataFrame:
    """Segments with each coefficient's part of its matrix's energy; one number a matrix is joined."""
    energy = segments.groupBy(ID).agg(F.sum(_array_sum(F.transform("coef", lambda c: c * c))).alias("__energy"))
    share = F.transform("coef", lambda c: c * c / (F.col("__energy") + F.lit(TINY)))
    return segments.join(energy, ID).select(*segments.columns, share.alias(out))


def blend(rows: DataFrame, marked: DataFrame, projected: DataFrame) -> DataFrame:
    """``matrix_id, i, row, projected, share, blended`` of matrices of any height, arrays by row.

    ``rows`` (matrix_id, i, row) holds the original, ``projected`` what the inverse made of the kept
    coefficients, ``marked`` the coefficients; the share of (k, l) weighs the cell at (i, j) = (k, l).
    All three meet by (matrix_id, i), so only rows are shuffled, never a matrix.
    """
    energy = marked.groupBy(ID).agg(F.sum(_array_sum(F.transform("coef", lambda c: c * c))).alias("__energy"))
    weights = coefficient_rows(marked).withColumnRenamed("row", "__coef")
    met = rows.select(ID, "i", "row").join(projected.select(ID, "i", F.col("row").alias("projected")), [ID, "i"]).join(weights, [ID, "i"])
    shared = met.join(energy, ID).withColumn("share", F.transform("__coef", lambda c: c * c / (F.col("__energy") + F.lit(TINY))))
    mixed = F.transform(
        F.arrays_zip("row", "projected", "share"), lambda x: x["projected"] * x["share"] + x["row"] * (F.lit(1.0) - x["share"])
    )
    return shared.select(ID, "i", "row", "projected", "share", mixed.alias("blended"))


def coefficient_cells(segments: DataFrame, c: str = "c", **more: str) -> DataFrame:
    """``matrix_id, k, l, c`` (and further arrays by name) of every coefficient."""
    arrays = {c: "coef", **more}
    zipped = segments.select(*NAMES[:-1], F.posexplode(F.arrays_zip(*[F.col(v).alias(n) for n, v in arrays.items()])).alias("p", "x"))
    k = (F.col("k0") + F.col("step") * F.floor(F.col("p") / F.col("width"))).cast("int")
    l = (F.col("l0") + F.col("p") % F.col("width")).cast("int")
    return zipped.select(ID, k.alias("k"), l.alias("l"), *[F.col("x")[n].alias(n) for n in arrays])


def written_segments(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """The segments of ``forward`` as a written table, for what reads them more than once."""
    return materialize(forward(rows, width), "segments")
