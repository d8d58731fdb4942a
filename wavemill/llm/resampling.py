"""Importance resampling towards a target: hashed n-gram buckets, log ratios, Gumbel draws.

Interning. The n-grams of a batch of texts go into an open-addressed NumPy table: 64-bit
xxhash keys, linear probing, all occurrences in step. A key that is met is taken for equal
only after its bytes are compared with those it was entered with. A slot stores the bucket
and the count of its n-gram, so a bucket is worked out once per distinct n-gram of a
batch, and the slot of each occurrence is all that is needed to gather counts or gains.

Law. Documents hold ``s`` of ``S`` n-grams in a bucket, the target ``t`` of ``T``. The gain of a
bucket is ``floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B))))``; a document weighs the sum over its
n-grams. A Gumbel value from a hash of its id makes the highest scores a draw without
replacement in proportion to the exponential weights. The draw is a rank over scores,
by buckets of the score: only documents above the last bucket wanted are ordered.

Defined results: a null or empty text has no words, weight 0 and is not eligible. Rows
without id are drawn like others, with an empty id in the hash, and come first among ties.
Rows equal in id and score take consecutive ranks. An empty table gives no rows; an empty
target gives the gains of counts 0. A very long text is cut into words in one task, its
n-grams are interned in pieces. Only the columns named are read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions.numeric import integer_levels
from wavemill.llm.common import by_bytes, map_arrow, text_column, written
from wavemill.operators.ranking import prefix_offsets

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, "2024"
#: Occurrences interned in one table.
TABLE_ROWS = 1 << 20
#: A-Z to a-z, and every byte that no word holds to a blank.
FOLDED = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def spans(lengths: np.ndarray, owners: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and owner of all runs of 1 to ``longest`` words of one owner, in words joined by one byte."""
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    first, last, whose = [], [], []
    for n in range(1, longest + 1):
        if len(lengths) < n:
            break
        inside = owners[n - 1 :] == owners[: len(owners) - n + 1]
        first.append(starts[: len(starts) - n + 1][inside])
        last.append(ends[n - 1 :][inside])
        whose.append(owners[n - 1 :][inside])
    if not first:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(first), np.concatenate(last), np.concatenate(whose)


class GramTable:
    """The distinct n-grams among occurrences: ``slot`` of each occurrence; ``bucket`` and ``count`` of each slot."""

    def __init__(self, joined: bytes, start: np.ndarray, end: np.ndarray, buckets: int, keys: np.ndarray | None = None):
        self.text = np.frombuffer(joined, np.uint8)
        self.start, self.size = start, end - start
        if keys is None:
            grams = [joined[a:b] for a, b in zip(start.tolist(), end.tolist())]
            keys = np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams))
        capacity = 1 << max(4, (2 * len(keys)).bit_length())
        self.slot = self._placed(keys, capacity)
        self.count = np.bincount(self.slot, minlength=capacity)
        self.bucket = np.zeros(capacity, np.int64)
        taken = np.flatnonzero(self.entry >= 0)
        at = self.entry[taken]
        first, last = self.start[at].tolist(), (self.start[at] + self.size[at]).tolist()
        self.bucket[taken] = [zlib.crc32(joined[a:b]) % buckets for a, b in zip(first, last)]

    def _placed(self, keys: np.ndarray, capacity: int) -> np.ndarray:
        """Probe all occurrences in step; ``entry`` becomes the occurrence each slot was entered with, -1 if free."""
        mask = capacity - 1
        self.entry = np.full(capacity, -1, np.int64)
        slot = (keys & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            here = slot[todo]
            free = self.entry[here] < 0
            self.entry[here[free]] = todo[free]  # of those that meet in a free slot, one enters it
            owner = self.entry[here]
            found = owner == todo
            met = np.flatnonzero(~found & (keys[owner] == keys[todo]))
            found[met] = self._same_bytes(owner[met], todo[met])
            todo = todo[~found]
            slot[todo] = (slot[todo] + 1) & mask
        return slot

    def _same_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = self.size[a] == self.size[b]
        rows = np.flatnonzero(same)
        size = self.size[a[rows]]
        ends = np.cumsum(size)
        inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        differs = self.text[np.repeat(self.start[a[rows]], size) + inner] != self.text[np.repeat(self.start[b[rows]], size) + inner]
        wrong = np.concatenate([[0], np.cumsum(differs)])
        same[rows] = wrong[ends] == wrong[ends - size]
        return same


def tables(texts: Sequence[bytes], longest: int, buckets: int) -> Iterator[tuple[np.ndarray, GramTable, np.ndarray]]:
    """The n-grams of ``texts`` in tables of about TABLE_ROWS: owners of the occurrences, the table, words per text.

    A text of more words is cut where runs of ``longest`` words can be told apart: each piece
    begins with the last words of the one before, whose runs are counted once.
    """
    held: list[bytes] = []
    owners: list[np.ndarray] = []
    fresh: list[np.ndarray] = []
    n_words = np.zeros(len(texts), np.int64)
    size = 0

    def closed() -> tuple[np.ndarray, GramTable, np.ndarray]:
        owner, new = np.concatenate(owners), np.concatenate(fresh)
        lengths = np.fromiter(map(len, held), np.int64, len(held))
        # Each piece has a number of its own, so that no run crosses from one to the next.
        piece = np.repeat(np.arange(len(owners)), [len(o) for o in owners])
        start, end, of_piece = spans(lengths, piece, longest)
        joined = b" ".join(held)
        last_word = np.searchsorted(np.cumsum(lengths + 1) - 1, end)
        wanted = new[last_word]
        start, end, last_word = start[wanted], end[wanted], last_word[wanted]
        keys = None
        if longest == 1:
            keys = np.fromiter(map(xxhash.xxh64_intdigest, held), np.uint64, len(held))
        return owner[last_word], GramTable(joined, start, end, buckets, keys), n_words

    for at, text in enumerate(texts):
        words = text.translate(FOLDED).split()
        n_words[at] = len(words)
        for begin in range(0, len(words), TABLE_ROWS):
            lead = min(begin, longest - 1)
            piece = words[begin - lead : begin + TABLE_ROWS]
            held += piece
            owners.append(np.full(len(piece), at, np.int64))
            fresh.append(np.arange(len(piece)) >= lead)
            size += len(piece)
            if size >= TABLE_ROWS:
                yield closed()
                held, owners, fresh, size = [], [], [], 0
    if held:
        yield closed()


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: n-grams of all texts in each bucket that holds any. A task hands on one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in by_bytes(batch):
                for _, table, _ in tables(piece.column(0).to_pylist(), longest, buckets):
                    used = np.flatnonzero(table.count)
                    np.add.at(sums, table.bucket[used], table.count[used])
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.int64())], ["bucket", "n"])

    parts = docs.select(text_column(text).alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket, in thousandths. The counts are one number a bucket, whatever the tables hold."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, rows in ((s, docs), (t, target)):
        for bucket, n in bucket_counts(rows, text, longest, buckets).collect():
            counts[bucket] = n
    whole_s, whole_t = float(s.sum() + buckets), float(t.sum() + buckets)
    ratios = [(float(b) + 1.0) * whole_s / ((float(a) + 1.0) * whole_t) for a, b in zip(s.tolist(), t.tolist())]
    return np.array([math.floor(1000.0 * math.log(r)) for r in ratios], np.int64)


def gumbel(key: str) -> int:
    """Thousandths of a standard Gumbel value, from the first 32 bits of the SHA-256 of ``key``."""
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0)))


def scored(
    docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = 1, seed: str = SEED
) -> DataFrame:
    """``key, n_words, n_features, weight, score`` of every row."""
    kept = docs.select(F.col(key).cast("bigint").alias("key"), text_column(text).alias("text"))
    buckets = len(gains)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, n = batch.column(0).to_pylist(), batch.num_rows
        words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
        for owner, table, n_words in tables(batch.column(1).to_pylist(), longest, buckets):
            words = n_words
            gain = gains[table.bucket][table.slot]
            features += np.bincount(owner, minlength=n)
            sums = np.concatenate([[0], np.cumsum(gain)])
            if longest == 1:  # occurrences lie in the order of their texts
                ends = np.searchsorted(owner, np.arange(n), side="right")
                weight += sums[ends] - sums[np.searchsorted(owner, np.arange(n))]
            else:
                np.add.at(weight, owner, gain)
        drawn = np.array([gumbel(f"{seed}:{'' if k is None else k}") for k in keys], np.int64)
        columns = [pa.array(c, pa.int64()) for c in (words, features, weight, weight + drawn)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "n_words", "n_features", "weight", "score"])

    out = map_arrow(kept, run, "key bigint, n_words bigint, n_features bigint, weight bigint, score bigint")
    return out.withColumnRenamed("key", key)


def highest(rows: DataFrame, score: str, key: str, eligible: Column, percent: int) -> DataFrame:
    """Add ``rank``: 1, 2, 3.. for the highest ``percent`` of the eligible rows, ties to the smaller key; else null.

    Scores are counted in three levels of buckets; rows in buckets that end within the quota
    or hold its end are ordered inside one value of the score. Rows equal in all columns and
    in input partition are ordered as one and dealt out again, so copies never meet in one task.
    """
    names = rows.columns
    tagged = rows.withColumn("__in", F.coalesce(eligible, F.lit(False)))
    levels = ["__l0", "__l1", "__l2"]
    cut = [c.alias(n) for n, c in zip(levels, integer_levels(-F.col(score), (16, 6, 0)))]
    quota = tagged.where("__in").count() * percent // 100
    chosen = tagged.where("__in").select("*", F.spark_partition_id().alias("__part")).groupBy(*names, "__part").agg(F.count(F.lit(1)).alias("__n"))
    chosen = chosen.select("*", *cut)
    counts = tagged.where("__in").select(*cut).groupBy(*levels).agg(F.count(F.lit(1)).alias("__n"))
    before = prefix_offsets(counts, [], levels, ["__n"]).where(F.col("before___n") < quota).select(*levels, "before___n")
    order = Window.partitionBy(*levels).orderBy(F.col(key).asc_nulls_first(), *[n for n in names if n not in (key, score)], "__part")
    upto = F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = chosen.join(before, levels, "left_semi").withColumn("__inside", upto).join(before, levels)
    first = F.col("before___n") + F.col("__inside")
    dealt = placed.select(*names, "__n", first.alias("__first"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n"))).alias("__k"))
    rank = F.col("__first") + F.col("__k")
    ranked = dealt.select(*names, F.when(rank <= quota, rank).alias("rank"))
    rest = tagged.where(~F.col("__in")).unionByName(tagged.where("__in").select("*", *cut).join(before, levels, "left_anti").select(*tagged.columns))
    return ranked.unionByName(rest.select(*names, F.lit(None).cast("bigint").alias("rank")))


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", longest: int = 1, buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED,
) -> DataFrame:
    """``key, n_words, n_features, weight, score, rank`` of every row; rows with a rank are the sample, in its order."""
    gains = bucket_gains(docs, target, text, longest, buckets)
    rows = written(scored(docs, gains, key, text, longest, seed), "resample-scores")
    return highest(rows, "score", key, F.col("n_words") >= least_words, percent)


def sample(docs: DataFrame, target: DataFrame, key: str = "doc_id", **more) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; documents are matched by their id, so ids must be unique."""
    drawn = resample(docs, target, key, **more).where(F.col("rank").isNotNull())
    return docs.join(drawn.select(key).distinct(), key, "left_semi")
