"""Projection on selected coefficients, and the blends built from it.

All work on dense records: the selection, the profile and the original travel in
the same record as the coefficients, so nothing is joined or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions.numeric import clip
from wavemill.operators.matrix import ID, SHAPE, cells, dense_from_cells
from wavemill.operators.selection import first_not_second
from wavemill.operators.transform import dct2d, dct_axis, idct2d

# Weight of the refinement in the third level, bounds of the specific part.
REFINEMENT = 0.1
SHARED_FLOOR = 1e-6
SPECIFIC_RANGE = (0.5, 2.0)


def kept(c: str = "coef", keep: Column | str = "keep") -> Column:
    """Coefficients with 0 in the places that are not kept."""
    return F.zip_with(c, keep, lambda x, k: F.when(k, x).otherwise(F.lit(0.0)))


def project(dense: DataFrame, c: str = "coef", keep: str = "keep", out: str = "projected", carry=()) -> DataFrame:
    """Inverse of the kept coefficients; ``carry`` names further columns of the records to keep."""
    return idct2d(dense.select(ID, *SHAPE, *carry, kept(c, keep).alias(out)), **{out: out})


def blend(projected: Column, share: Column, original: Column) -> Column:
    """projected * share + original * (1 - share); the share at (k, l) weighs the cell at (i, j) = (k, l)."""
    return projected * share + original * (F.lit(1.0) - share)


def spectral_blend(
    dense: DataFrame, c: str = "coef", keep: str = "keep", share: str = "share", v: str = "vals"
) -> DataFrame:
    """Cells with the original ``v``, its projection ``p``, the share ``s`` and the blend.

    ``c`` may be the coefficients of the matrix plus a delta.
    """
    done = project(dense, c, keep, "__p", (share, v))
    return cells(done, p="__p", s=share, v=v).withColumn("blended", blend(F.col("p"), F.col("s"), F.col("v")))


def progressive(
    dense: DataFrame, full: str = "full", low: str = "low", c: str = "coef", c_delta: str | None = None,
    share: str = "share", v: str = "vals",
) -> DataFrame:
    """Cells at the three levels of detail, one row per level.

    L1 blends the low selection, L2 the full one (with the delta, if ``c_delta``
    names its coefficients), L3 adds a tenth of what the full selection has beyond
    the low.
    """
    parts = dense.select(
        ID, *SHAPE, F.col(share).alias("s"), F.col(v).alias("v"),
        kept(c, low).alias("a"), kept(c_delta or c, full).alias("b"), kept(c, first_not_second(full, low)).alias("d"),
    )
    table = cells(idct2d(parts, a="a", b="b", d="d"), a="a", b="b", d="d", s="s", v="v")
    second = blend(F.col("b"), F.col("s"), F.col("v"))
    levels = F.array(
        F.struct(F.lit("L1").alias("level"), blend(F.col("a"), F.col("s"), F.col("v")).alias("value")),
        F.struct(F.lit("L2").alias("level"), second.alias("value")),
        F.struct(F.lit("L3").alias("level"), (second + F.lit(REFINEMENT) * F.col("d")).alias("value")),
    )
    return table.select(ID, *SHAPE, "i", "j", F.inline(levels))


def shared_share(source: Column, target: Column) -> Column:
    return (source + target) / F.lit(2.0)


def specific_share(source: Column, target: Column) -> Column:
    return clip(target / F.greatest(shared_share(source, target), F.lit(SHARED_FLOOR)), *SPECIFIC_RANGE)


def adapted_share(source: Column, target: Column) -> Column:
    """Mean of two profiles times the target's specific part relative to it, bounded."""
    return shared_share(source, target) * specific_share(source, target)


def transfer(
    dense: DataFrame, shared: str, specific: str, c: str = "coef", keep: str = "keep", v: str = "vals"
) -> DataFrame:
    """Blend with the product of a shared and a specific profile."""
    product = F.zip_with(shared, specific, lambda a, b: a * b)
    return spectral_blend(dense.withColumn("__adapted", product), c, keep, "__adapted", v)


def tensor_project(table: DataFrame, profile: DataFrame, layers: int, heads: int) -> DataFrame:
    """Project a tensor (layer, head, i, j) in four steps.

    Transform along layers and keep the first ``layers``, the same along heads,
    then transform each slice, weigh its coefficients by ``profile`` (k, l, share)
    and invert the slice. Layers and heads stay transformed.
    """
    by_layer = dct_axis(table, "layer").where(F.col("layer") < layers)
    by_head = dct_axis(by_layer, "head").where(F.col("head") < heads)
    one_slice = Window.partitionBy(ID, "layer", "head")
    sized = by_head.withColumns(
        {
            "n_rows": (F.max("i").over(one_slice) + 1).cast("int"),
            "n_cols": (F.max("j").over(one_slice) + 1).cast("int"),
        }
    )
    carry = ("layer", "head")
    slices = dct2d(dense_from_cells(sized, carry=carry, vals="v"))
    weighed = cells(slices, at=("k", "l"), carry=carry, c="coef").join(
        profile.select("k", "l", "share"), ["k", "l"]
    )
    scaled = dense_from_cells(weighed, at=("k", "l"), carry=carry, vals=F.col("c") * F.col("share"))
    return cells(idct2d(scaled, vals="vals"), carry=carry, v="vals")


def tensor_ratio(layers: Column, kept_layers: Column, heads: Column, kept_heads: Column, size: Column,
                 kept_cells: Column) -> Column:
    """Compression of a projected tensor; NULL when nothing is kept."""
    return (layers / kept_layers) * (heads / kept_heads) * F.try_divide(size, kept_cells)
