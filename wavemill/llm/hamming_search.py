"""Nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample turns vectors into binary codes. A code is split
into SUBSTRINGS bytes, and each byte position has an index of its own. Two codes within
distance R differ by at most r_i at some position i if the r_i + 1 add up to more than
R, so probing every position within its radius retrieves every code within R. What is
retrieved is checked on whole codes, and what lies within R is ranked by the distance
of the original vectors. R is learned on the sample so that RECALL of true neighbours
lie within it; where a block holds fewer than k codes within R, R grows until it does.

All rows are indexed, in blocks; the stated queries, in blocks, meet every block.

Rows of the same id and vector travel as one row with a number of copies, so a hot one is
never gathered.

Defined results: vectors that are null, zero, or hold null or non-finite components take
no part, nor do rows without id. Vectors meet those of their own length only: for the most
frequent length (of equally frequent ones the longest) codes are learned on the sample, for
others each block learns its own from its rows. Fewer candidates than k: all of them. Ties
go to the smaller id. A query leaves out its own row only: other rows of its id are
candidates, and each of several query rows of one id is answered on its own. An empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS, SUBSTRINGS = 64, 8
#: At most so many vectors, the first in the order of a hash of the id, train rotation and radius.
SAMPLE, SAMPLE_QUERIES = 4096, 256
RECALL = 0.98
ROUNDS = 25
ROW_BLOCK, QUERY_BLOCK = 8192, 1024
DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


class Codes:
    """Centre and rotation that turn vectors into codes, and the radius that holds most true neighbours."""

    def __init__(self, sample: np.ndarray, k: int):
        self.centre = sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])
        moved = sample - self.centre
        bits = min(BITS, sample.shape[1])
        values, axes = np.linalg.eigh(moved.T @ moved)
        axes = axes[:, np.argsort(-values, kind="stable")[:bits]]
        turn = np.linalg.qr(np.random.default_rng(0).normal(size=(bits, bits)))[0]
        projected = moved @ axes
        for _ in range(ROUNDS):  # rotate so that the signs lose least
            u, _, vt = np.linalg.svd(np.where(projected @ turn >= 0, 1.0, -1.0).T @ projected)
            turn = (u @ vt).T
        self.axes = axes @ turn
        self.radius = self._radius(sample, k)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """(count, SUBSTRINGS) bytes; bits beyond the dimension are 0."""
        bits = (vectors - self.centre) @ self.axes >= 0
        full = np.zeros((len(vectors), BITS), bool)
        full[:, : bits.shape[1]] = bits
        return np.packbits(full, axis=1)

    def _radius(self, sample: np.ndarray, k: int) -> int:
        if len(sample) < 2:
            return 0
        codes, far = self.of(sample), []
        for at in range(min(SAMPLE_QUERIES, len(sample))):
            apart = ((sample - sample[at]) ** 2).sum(axis=1)
            apart[at] = np.inf
            near = np.argsort(apart, kind="stable")[: min(k, len(sample) - 1)]
            far.append(np.bitwise_count(codes[near] ^ codes[at]).sum(axis=1, dtype=np.int64))
        return int(np.ceil(np.quantile(np.concatenate(far), RECALL)))


class BlockIndex:
    """Rows of a block by the value of each byte of their codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.whole = np.ascontiguousarray(codes).view(np.uint64).ravel()
        self.order = [np.argsort(codes[:, s], kind="stable") for s in range(SUBSTRINGS)]
        self.begin = [np.searchsorted(codes[o, s], np.arange(257)) for s, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes are at most ``radius`` from ``code``: every one of them."""
        found = np.zeros(len(self.codes), bool)
        for s in range(SUBSTRINGS):
            own = (radius + 1 + s) // SUBSTRINGS - 1  # the own + 1 add up to radius + 1
            if own >= 0:
                order, begin = self.order[s], self.begin[s]
                values = np.flatnonzero(DISTANCE[code[s]] <= own)
                for a, b in zip(begin[values].tolist(), begin[values + 1].tolist()):
                    found[order[a:b]] = True
        rows = np.flatnonzero(found)
        target = np.ascontiguousarray(code).view(np.uint64)[0]
        return rows[np.bitwise_count(self.whole[rows] ^ target) <= radius]


def search_block(ids, vectors, copies, query_ids, queries, codes: Codes, k: int):
    """The k nearest rows of a block to each query, of those its code retrieves: positions of queries, ids, scores."""
    index = BlockIndex(codes.of(vectors))
    total = int(copies.sum())
    out = []
    for at, (query, vector, code) in enumerate(zip(query_ids, queries, codes.of(queries))):
        same = np.flatnonzero(ids == query)
        own = same[(vectors[same] == vector).all(axis=1)]  # one row at most, as equal rows are one
        radius, others = codes.radius, total - len(own)
        while True:
            rows = index.within(code, radius)
            count = copies[rows] - np.isin(rows, own)
            if count.sum() >= min(k, others) or radius >= BITS:
                break
            radius += 4
        score = np.sqrt(((vectors[rows] - vector) ** 2).sum(axis=1))
        order = np.lexsort((ids[rows], score))
        order = order[count[order] > 0][:k]  # each gives a copy at least, so k rows are enough
        best = np.repeat(order, np.minimum(count[order], k))[:k]
        out.append((np.full(len(best), at), ids[rows[best]], score[best]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v, n`` (length) of the rows that take part."""
    values = F.col("v")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    named = table.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    good = named.where(F.col("id").isNotNull() & values.isNotNull() & finite & F.exists(values, lambda x: x != 0.0))
    return good.withColumn("n", F.size("v"))


def nearest(table: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id is divisible by ``every``."""
    rows = usable(table, key, vector)
    is_query = F.col("id") % every == 0
    lengths = rows.groupBy("n").agg(F.count(F.lit(1)).alias("rows"), F.count_if(is_query).alias("queries"))
    most = F.max_by(F.struct("n", "rows", "queries"), F.struct("rows", "n"))
    counted = lengths.agg(most.alias("most"), F.sum("rows").alias("rows"), F.sum("queries").alias("queries")).first()
    if counted["most"] is None:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    main = counted["most"]["n"]
    # Ties in the hash are told apart by the vector, so the sample does not depend on the layout.
    sample = rows.where(F.col("n") == main).orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("v").collect()
    codes = Codes(np.array([r["v"] for r in sample], np.float64), k)
    whole = rows.groupBy("id", "v", "n").agg(F.count(F.lit(1)).alias("copies")).withColumn("tag", F.xxhash64("id", "v"))

    def blocks_of(what: str, size: int):
        """Number of blocks of a row's length class: the main length, or all others together."""
        of_main = counted["most"][what]
        main_blocks, other_blocks = (max(1, -(-c // size)) for c in (of_main, counted[what] - of_main))
        return F.when(F.col("n") == main, F.lit(main_blocks)).otherwise(F.lit(other_blocks))

    row_blocks, query_blocks = blocks_of("rows", ROW_BLOCK), blocks_of("queries", QUERY_BLOCK)

    def every_block(count):
        return F.explode(F.sequence(F.lit(0), count - 1))

    def one_block(count):
        return F.pmod("tag", count).cast("int")

    blocks = whole.withColumn("rb", one_block(row_blocks)).withColumn("qb", every_block(query_blocks))
    queries = whole.where(is_query).withColumn("qb", one_block(query_blocks)).withColumn("rb", every_block(row_blocks))

    def matrix(t: pa.Table) -> np.ndarray:
        flat = t.column("v").combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found, tags, copies, names = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)], [], [], []
        if left.num_rows and right.num_rows:
            left = left.sort_by([("id", "ascending"), ("tag", "ascending")])
            vectors = matrix(left)
            by = codes if vectors.shape[1] == main else Codes(vectors[:: -(-len(vectors) // SAMPLE)], k)
            ids, asked = left.column("id").to_numpy(), right.column("id").to_numpy()
            found = search_block(ids, vectors, left.column("copies").to_numpy(), asked, matrix(right), by, k)
            names, tags, copies = (right.column(c).to_numpy()[found[0]] for c in ("id", "tag", "copies"))
        return pa.table(
            {
                "query_id": pa.array(names, pa.int64()), "tag": pa.array(tags, pa.int64()), "copies": pa.array(copies, pa.int64()),
                "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64()),
            }
        )

    groups = ("n", "rb", "qb")
    met = blocks.groupBy(*groups).cogroup(queries.groupBy(*groups)).applyInArrow(
        meet, "query_id bigint, tag bigint, copies bigint, vec_id bigint, score double"
    )
    # A partial top k in each task keeps what meets at a query small; a query is told by id and hash of its vector.
    place = F.row_number().over(Window.partitionBy("query_id", "tag").orderBy("score", "vec_id"))
    best = met.withColumn("rank", place).where(F.col("rank") <= k)
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return best.withColumn("copy", each).select("query_id", "rank", "vec_id", "score")


def exact_nearest(ids: np.ndarray, vectors: np.ndarray, every: int = 100, k: int = 10) -> Iterator[tuple[int, list[int]]]:
    """Brute force, to measure recall."""
    for at in np.flatnonzero(ids % every == 0):
        score = np.sqrt(((vectors - vectors[at]) ** 2).sum(axis=1))
        other = np.flatnonzero(np.arange(len(ids)) != at)
        yield int(ids[at]), ids[other[np.lexsort((ids[other], score[other]))[:k]]].tolist()
