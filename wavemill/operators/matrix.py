"""Matrices as tables.

``dense``: matrix_id STRING, n_rows INT, n_cols INT, plus ARRAY<DOUBLE> columns in
row order, one row per matrix. ``cells``: one row per entry. ``rows``: one row per
matrix row, for matrices too tall for one record. A record holds a whole matrix; one of
more than RECORD_VALUES values is an error, never another matrix: it goes through
the functions on rows and cells, which give the same results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.operators.ranking import rank_by_id

ID = "matrix_id"
SHAPE = ["n_rows", "n_cols"]
#: A record of this many values takes 32 MB.
RECORD_VALUES = 1 << 22


def rows_from_vectors(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """One matrix per group value, one row per vector, ordered by a unique integer key."""
    ranked = rank_by_id(df.select(group, key, vector), [group], key, "i")
    return ranked.select(
        F.col(group).cast("string").alias(ID), F.col("i"), F.col(vector).cast("array<double>").alias("row")
    )


def rows_in_any_order(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Rows without a position, for factors that do not depend on it: nothing is ranked or shuffled."""
    return df.select(F.col(group).cast("string").alias(ID), F.col(vector).cast("array<double>").alias("row"))


def tile_rows(rows: DataFrame, height: int) -> DataFrame:
    """Cut each matrix into bands of ``height`` rows, matrices of their own named ``<matrix>/<band>``."""
    band = F.floor(F.col("i") / F.lit(height)).cast("bigint")
    return rows.select(
        F.concat_ws("/", F.col(ID), band.cast("string")).alias(ID),
        (F.col("i") % F.lit(height)).cast("int").alias("i"),
        "row",
    )


def dense_from_rows(rows: DataFrame) -> DataFrame:
    """Gather the rows of each (bounded) matrix into one record. A row beyond the bound fails before the gathering."""
    fits = (F.col("i") + 1) * F.size("row") <= RECORD_VALUES
    refused = F.raise_error(F.lit(f"a matrix of more than {RECORD_VALUES} values: use the functions on rows"))
    rows = rows.withColumn("row", F.when(fits | F.col("row").isNull(), F.col("row")).otherwise(refused.cast("array<double>")))
    ordered = F.sort_array(F.collect_list(F.struct("i", "row")))
    return (
        rows.groupBy(ID)
        .agg(ordered.alias("__rows"))
        .select(
            ID,
            F.size("__rows").alias("n_rows"),
            F.size(F.element_at("__rows", 1)["row"]).alias("n_cols"),
            F.when(
                F.forall("__rows", lambda r: F.size(r["row"]) == F.size(F.element_at("__rows", 1)["row"])),
                F.flatten(F.transform("__rows", lambda r: r["row"])),
            )
            .otherwise(F.raise_error(F.lit("rows of one matrix differ in length")).cast("array<double>"))
            .alias("vals"),
        )
    )


def dense_from_vectors(df: DataFrame, group: str, key: str, vector: str, height: int | None = None) -> DataFrame:
    """One record per group value, of any height; bands of ``height`` rows only where that is asked for."""
    rows = rows_from_vectors(df, group, key, vector)
    return dense_from_rows(rows if height is None else tile_rows(rows, height))


def _grid_position(i: Column, j: Column, n_rows: int, n_cols: int) -> Column:
    inside = i.between(0, n_rows - 1) & j.between(0, n_cols - 1)
    return F.when(inside, (i * F.lit(n_cols) + j).cast("int")).otherwise(
        F.raise_error(F.lit(f"fact outside the {n_rows} x {n_cols} grid")).cast("int")
    )


def dense_from_facts(
    df: DataFrame, matrix: Column, i: Column, j: Column, n_rows: int, n_cols: int, **values: Column
) -> DataFrame:
    """Sum facts onto a fixed grid, one array per named value; cells without facts are 0.

    Facts are summed per cell before the shuffle, so a matrix with very many facts
    still arrives as at most n_rows * n_cols values. Facts off the grid are an error.
    """
    names = list(values)
    sums = (
        df.select(
            matrix.cast("string").alias(ID),
            _grid_position(i, j, n_rows, n_cols).alias("pos"),
            *[values[n].cast("double").alias(n) for n in names],
        )
        .groupBy(ID, "pos")
        .agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names])
    )
    gathered = sums.groupBy(ID).agg(F.sort_array(F.collect_list(F.struct("pos", *names))).alias("__at"))
    size = n_rows * n_cols

    def fill(name):
        """Values in position order, each preceded by the zeros of the gap before it."""

        def with_gap(x, at):
            before = F.coalesce(F.get("__at", at - 1)["pos"], F.lit(-1))
            return F.concat(F.array_repeat(F.lit(0.0), x["pos"] - before - 1), F.array(x[name]))

        rest = F.lit(size - 1) - F.element_at("__at", -1)["pos"]
        filled = F.concat(F.flatten(F.transform("__at", with_gap)), F.array_repeat(F.lit(0.0), rest))
        return filled.alias(name)

    return gathered.select(
        ID, F.lit(n_rows).alias("n_rows"), F.lit(n_cols).alias("n_cols"), *[fill(n) for n in names]
    )


def cells(dense: DataFrame, at=("i", "j"), carry=(), **arrays: str) -> DataFrame:
    """Explode arrays of dense records side by side: ``cells(d, v="vals", c="coef")``."""
    row, col = at
    zipped = F.arrays_zip(*[F.col(source).alias(name) for name, source in arrays.items()])
    return dense.select(ID, *SHAPE, *carry, F.posexplode(zipped).alias("__pos", "__cell")).select(
        ID,
        *SHAPE,
        *carry,
        F.floor(F.col("__pos") / F.col("n_cols")).cast("int").alias(row),
        (F.col("__pos") % F.col("n_cols")).cast("int").alias(col),
        *[F.col("__cell")[name].alias(name) for name in arrays],
    )


def dense_from_cells(table: DataFrame, at=("i", "j"), carry=(), **values: Column | str) -> DataFrame:
    """Gather cells into dense records; missing cells are 0. A table already laid out by matrix is not shuffled again."""
    row, col = at
    pos = F.col(row) * F.col("n_cols") + F.col(col)
    entries = F.struct(
        pos.alias("pos"),
        *[(F.col(e) if isinstance(e, str) else e).cast("double").alias(n) for n, e in values.items()],
    )
    gathered = table.groupBy(ID, *SHAPE, *carry).agg(F.sort_array(F.collect_list(entries)).alias("__c"))

    size = F.col("n_rows") * F.col("n_cols")

    def pick(name):
        """Values by position; a missing cell is 0, a complete record is taken as it is."""

        def with_gap(c, at):
            before = F.coalesce(F.get("__c", at - 1)["pos"], F.lit(-1))
            return F.concat(F.array_repeat(F.lit(0.0), (c["pos"] - before - 1).cast("int")), F.array(c[name]))

        rest = F.array_repeat(F.lit(0.0), (size - 1 - F.element_at("__c", -1)["pos"]).cast("int"))
        filled = F.concat(F.flatten(F.transform("__c", with_gap)), rest)
        return F.when(F.size("__c") == size, F.transform("__c", lambda c: c[name])).otherwise(filled).alias(name)

    return gathered.select(ID, *SHAPE, *carry, *[pick(n) for n in values])


def crop(table: DataFrame, rows: Column | int, cols: Column | int, at=("i", "j")) -> DataFrame:
    """Leading sub-block of each matrix; the shape columns follow."""
    rows = F.lit(rows) if isinstance(rows, int) else rows
    cols = F.lit(cols) if isinstance(cols, int) else cols
    kept = table.where((F.col(at[0]) < rows) & (F.col(at[1]) < cols))
    return kept.withColumns(
        {
            "n_rows": F.least(F.col("n_rows"), rows).cast("int"),
            "n_cols": F.least(F.col("n_cols"), cols).cast("int"),
        }
    )


def tile(table: DataFrame, height: int, width: int, at=("i", "j")) -> DataFrame:
    """Cut matrices into blocks named ``<matrix>/<band>/<strip>``; the last ones may be smaller."""
    row, col = at
    band = F.floor(F.col(row) / height).cast("int")
    strip = F.floor(F.col(col) / width).cast("int")
    return table.withColumns(
        {
            ID: F.concat_ws("/", F.col(ID), band.cast("string"), strip.cast("string")),
            "n_rows": F.least(F.lit(height), F.col("n_rows") - band * height).cast("int"),
            "n_cols": F.least(F.lit(width), F.col("n_cols") - strip * width).cast("int"),
            row: (F.col(row) % height).cast("int"),
            col: (F.col(col) % width).cast("int"),
        }
    )


def weighted_sum(dense: DataFrame, left: str, right: str, a: float, b: float, out: str) -> DataFrame:
    """Elementwise a*left + b*right of two arrays of the same record."""
    return dense.withColumn(
        out, F.zip_with(left, right, lambda x, y: F.lit(float(a)) * x + F.lit(float(b)) * y)
    )
