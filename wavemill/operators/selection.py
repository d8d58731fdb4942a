"""Energy profiles and selections of coefficients.

Two regimes. Bounded matrices are dense records and are selected inside the
record: arrays are sorted and cut in place, no cell is shuffled. Matrices too
large for a record are coefficient cells; there the ordering is cut into buckets
and only the bucket in which the selection ends is ranked.

A selection is an ARRAY<BOOLEAN> of the record or a BOOLEAN column of the cells;
``positions`` turns the first into the sparse index set (only kept places).
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions.numeric import magnitude_level
from wavemill.operators.matrix import ID, SHAPE, cells

# Defaults that decide which coefficients are kept.
TAU = 0.95
TOP_FRACTION = 0.25
CLUSTERS = 4
STARTS = 10
TINY = 1e-12

PLACE = ["k", "l"]

# Inside a lambda Spark would evaluate an outer expression once per element, so
# per-record numbers are bound by _let or repeated to an array first.


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def energy_profile(dense: DataFrame, gamma: float = 1.0, c: str = "coef", out: str = "share") -> DataFrame:
    """Each coefficient's part of its matrix's energy, times ``gamma``."""
    total = F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x) + F.lit(TINY)
    scale = F.array_repeat(total, F.size(c))
    return dense.withColumn(out, F.zip_with(c, scale, lambda x, t: F.lit(float(gamma)) * x * x / t))


def _keep_first(dense: DataFrame, values: Column, count, out: str) -> DataFrame:
    """Mark the first entries of a record by falling value, by position among equals; NaN comes last.

    ``count`` maps the negated values in order to the number of entries to keep.
    Plain numbers are sorted, which is much cheaper than pairs with positions: the
    value of the last entry kept decides all others, and only entries equal to it
    are told apart by position.
    """
    ordered = (
        dense.withColumn("__down", F.transform(values, lambda x: -x))
        .withColumn("__sorted", F.sort_array("__down"))
        .withColumn("__n", count(F.col("__sorted")))
    )

    def mark(cut):
        equal = F.filter(F.transform("__down", lambda x, p: F.when(x == cut, p)), lambda p: p.isNotNull())
        spare = F.col("__n") - F.array_position("__sorted", cut).cast("int")

        def by_place(place):
            kept = F.transform("__down", lambda x, p: (x < cut) | ((x == cut) & (p <= place)))
            return F.when(F.col("__n") > 0, kept).otherwise(F.transform("__down", lambda x: F.lit(False)))

        return _let(F.get(equal, spare), by_place)

    marked = _let(F.get("__sorted", F.col("__n") - 1), mark)
    return ordered.withColumn(out, marked).drop("__down", "__sorted", "__n")


def select_energy(dense: DataFrame, tau: float = TAU, share: str = "share", out: str = "keep") -> DataFrame:
    """Keep the largest shares while their running sum stays within ``tau`` of the total.

    The coefficient that crosses the threshold is left out, so one dominant
    coefficient gives an empty selection; an all-zero matrix keeps everything, one
    with a NaN nothing.
    """
    total = F.aggregate(share, F.lit(0.0), lambda acc, x: acc + x)

    def count(ordered):
        def within(limit):
            def step(acc, x):
                run = acc["run"] - x
                return F.struct(run.alias("run"), (acc["n"] + (run <= limit).cast("int")).alias("n"))

            counted = F.aggregate(ordered, F.struct(F.lit(0.0).alias("run"), F.lit(0).alias("n")), step)
            return F.when(F.isnan(limit), F.lit(0)).otherwise(counted["n"])

        return _let(F.lit(float(tau)) * total, within)

    return _keep_first(dense, F.col(share), count, out)


def select_largest(dense: DataFrame, count: Column, c: str = "coef", out: str = "keep") -> DataFrame:
    """Keep the ``count`` largest magnitudes of each matrix; ``count`` may use the shape columns."""
    sizes = F.transform(c, lambda x: F.abs(x))
    return _keep_first(dense, sizes, lambda ordered: F.least(count.cast("int"), F.size(ordered)), out)


def fraction_count(fraction: float) -> Column:
    size = F.col("n_rows").cast("bigint") * F.col("n_cols")
    return F.greatest(F.lit(1), F.floor(size * F.lit(float(fraction))))


def select_gradient(
    dense: DataFrame, fraction: float = TOP_FRACTION, g: str = "gcoef", out: str = "keep"
) -> DataFrame:
    """Keep the top fraction by magnitude of the gradient's coefficients ``g``."""
    return select_largest(dense, fraction_count(fraction), g, out)


def _fit_all(points: DataFrame, clusters: int, seeds) -> list:
    """One k-means fit per seed; the fits are small jobs, so they are submitted side by side."""
    with ThreadPool(min(8, len(seeds))) as pool:
        return pool.map(lambda s: KMeans(k=clusters, seed=s).fit(points), list(seeds))


def _largest_cluster(spark, n_rows: int, n_cols: int, clusters: int, seeds) -> DataFrame:
    """One grid's record (n_rows, n_cols, keep); the lowest cluster number wins a tie."""
    size = n_rows * n_cols
    if size == 1:
        one = spark.range(1).agg(F.max(F.lit(1)).alias("n_rows"), F.max(F.lit(1)).alias("n_cols"))
        return one.withColumn("keep", F.array(F.lit(True)))
    grid = spark.range(0, size, 1, max(1, size // 65536)).select(
        F.col("id").cast("int").alias("pos"),
        F.floor(F.col("id") / n_cols).cast("int").alias("k"),
        (F.col("id") % n_cols).cast("int").alias("l"),
    )
    points = VectorAssembler(inputCols=PLACE, outputCol="features").transform(grid).cache()
    fits = _fit_all(points, min(clusters, size), seeds)
    points.unpersist()
    best = min(fits, key=lambda m: m.summary.trainingCost)
    sizes = best.summary.clusterSizes
    marked = best.transform(points).select("pos", (F.col("prediction") == sizes.index(max(sizes))).alias("in"))
    # The shape comes out of the aggregate: as a constant it would turn the join on it into a loop join.
    return marked.agg(
        F.max(F.lit(n_rows)).alias("n_rows"),
        F.max(F.lit(n_cols)).alias("n_cols"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "in"))), lambda x: x["in"]).alias("keep"),
    )


def select_cluster(
    dense: DataFrame, clusters: int = CLUSTERS, starts: int = STARTS, seed: int = 42, out: str = "keep",
    shapes: DataFrame | None = None,
) -> DataFrame:
    """Keep the largest k-means cluster of the coefficient grid.

    The features are the grid coordinates, so matrices of one shape share one
    clustering, fitted on the grid. ``shapes`` may give the (n_rows, n_cols) of the
    collection where that is cheaper to read; the loop runs over distinct shapes only.
    """
    spark = dense.sparkSession
    shapes = (dense if shapes is None else shapes).select(*SHAPE).distinct()
    seeds = range(seed, seed + starts)
    found = None
    for n_rows, n_cols in [tuple(r) for r in shapes.sort(*SHAPE).toLocalIterator()]:
        part = _largest_cluster(spark, n_rows, n_cols, clusters, seeds)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return dense.withColumn(out, F.lit(None).cast("array<boolean>"))
    return dense.join(found.withColumnRenamed("keep", out), SHAPE)


def both_of(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: x & y)


def either_of(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: x | y)


def first_not_second(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: x & ~y)


def select(
    dense: DataFrame,
    strategy: str = "energy+gradient",
    combine: str = "and",
    tau: float = TAU,
    fraction: float = TOP_FRACTION,
    clusters: int = CLUSTERS,
    share: str = "share",
    g: str = "gcoef",
    out: str = "keep",
    shapes: DataFrame | None = None,
) -> DataFrame:
    """Select by a named strategy. Records need ``share`` for energy and ``g`` for gradient."""
    if strategy in ("energy", "energy-only"):
        return select_energy(dense, tau, share, out)
    if strategy == "gradient":
        return select_gradient(dense, fraction, g, out)
    if strategy == "clustering+gradient":
        both = select_gradient(select_cluster(dense, clusters, out="__a", shapes=shapes), fraction, g, "__b")
        return both.withColumn(out, either_of("__a", "__b")).drop("__a", "__b")
    if strategy == "energy+gradient":
        ways = {"and": both_of, "or": either_of}
        if combine not in ways:
            raise ValueError(f"combine must be 'and' or 'or', not {combine!r}")
        both = select_gradient(select_energy(dense, tau, share, "__a"), fraction, g, "__b")
        return both.withColumn(out, ways[combine]("__a", "__b")).drop("__a", "__b")
    raise ValueError(f"unknown strategy {strategy!r}")


def positions(dense: DataFrame, keep: str = "keep") -> DataFrame:
    """Index set of the kept places: matrix_id, k, l."""
    return cells(dense, at=("k", "l"), kept=keep).where("kept").select(ID, *PLACE)


def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(ID, *PLACE).intersect(b.select(ID, *PLACE))


def mask_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(ID, *PLACE).union(b.select(ID, *PLACE)).distinct()


def mask_and_not(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(ID, *PLACE).distinct().join(b.select(ID, *PLACE), [ID, *PLACE], "left_anti")


def apply_mask(coef: DataFrame, mask: DataFrame, out: str = "keep") -> DataFrame:
    """Mark complete coefficient cells by a sparse index set."""
    hit = mask.select(ID, *PLACE).distinct().withColumn(out, F.lit(True))
    return coef.join(hit, [ID, *PLACE], "left").withColumn(out, F.coalesce(out, F.lit(False)))


# Matrices of any size, as coefficient cells (matrix_id, k, l, ...).


def cell_profile(coef: DataFrame, gamma: float = 1.0, c: str = "c", out: str = "share") -> DataFrame:
    """Energy profile of cells; totals are combined map-side and joined back."""
    square = F.col(c) * F.col(c)
    totals = coef.groupBy(ID).agg((F.sum(square) + F.lit(TINY)).alias("__total"))
    return coef.join(totals, ID).withColumn(out, F.lit(float(gamma)) * square / F.col("__total")).drop("__total")


def _mark_to_edge(coef: DataFrame, value: Column, weight: Column, limit, bits: int, out: str) -> DataFrame:
    """Mark cells by falling ``value`` while the running sum of ``weight`` stays within a limit.

    ``limit`` maps a matrix's total weight to its limit. Weights are summed per
    bucket of ``value`` (binary exponent and ``bits`` mantissa bits) map-side; the
    bucket in which the limit is passed is ranked, the others are decided as wholes.
    The cells are read three times: pass a written table rather than a long plan.
    """
    leveled = coef.withColumns(
        {"__value": value, "__weight": weight}
    ).withColumn("__level", magnitude_level(F.col("__value"), bits))
    whole = Window.partitionBy(ID)
    down = whole.orderBy(F.desc("__level")).rowsBetween(Window.unboundedPreceding, 0)
    edges = (
        leveled.groupBy(ID, "__level")
        .agg(F.sum("__weight").alias("__sum"))
        .select(
            ID,
            "__level",
            F.sum("__sum").over(down).alias("__upto"),
            (F.sum("__sum").over(down) - F.col("__sum")).alias("__before"),
            limit(F.sum("__sum").over(whole)).cast("double").alias("__limit"),
        )
        .where((F.col("__upto") > F.col("__limit")) | F.isnan("__limit"))
        .groupBy(ID)
        .agg(
            F.max("__level").alias("__edge"),
            F.max_by("__before", "__level").alias("__before"),
            F.first("__limit").alias("__limit"),
        )
    )
    tagged = leveled.join(edges, ID, "left")
    clear = tagged.where(F.col("__edge").isNull() | (F.col("__level") != F.col("__edge"))).withColumn(
        out, F.coalesce(F.col("__level") > F.col("__edge"), F.lit(True))
    )
    inside = whole.orderBy(F.desc("__value"), *PLACE).rowsBetween(Window.unboundedPreceding, 0)
    close = tagged.where(F.col("__level") == F.col("__edge")).withColumn(
        out, (F.col("__before") + F.sum("__weight").over(inside) <= F.col("__limit")) & ~F.isnan("__limit")
    )
    return clear.unionByName(close).drop("__value", "__weight", "__level", "__edge", "__before", "__limit")


def select_energy_cells(
    profile: DataFrame, tau: float = TAU, share: str = "share", out: str = "keep", bits: int = 8
) -> DataFrame:
    """``select_energy`` for cells of matrices of any size."""
    value = F.col(share)
    return _mark_to_edge(profile, value, value, lambda total: F.lit(float(tau)) * total, bits, out)


def select_gradient_cells(
    coef: DataFrame, fraction: float = TOP_FRACTION, g: str = "g", out: str = "keep", bits: int = 8
) -> DataFrame:
    """``select_gradient`` for cells of matrices of any size."""

    def quota(n):
        return F.greatest(F.lit(1), F.floor(n * F.lit(float(fraction))))

    return _mark_to_edge(coef, F.abs(F.col(g)), F.lit(1), quota, bits, out)
