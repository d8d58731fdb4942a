"""Training-order materialisation: a keyed Feistel permutation gives every sequence its global slot.

Documents, in the order of their ids, each closed by an end token, form one stream of
token ids, cut into sequences of equal length. A balanced Feistel network over the next
power of four permutes the sequence numbers; a value outside the range walks on until it
falls inside. Slots are dealt to shards in ranges, and each shard is one binary file of
fixed stride: the sequence in slot s starts at ``(s % per_shard) * stride`` of shard ``s //
per_shard``, so a reader goes on from any slot without an index. The last sequence is
filled up with the end token.

Defined results: a null or empty text adds its end token only. Rows without id come first;
rows of equal id stand in the order of their ids' bytes, so equal rows change nothing. An
empty table gives no sequence and no file. A task that is run again writes the same
bytes under a name of its own and renames them, so a lost executor leaves whole files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.llm.bpe import encode
from wavemill.llm.common import map_arrow, written
from wavemill.operators.ranking import prefix_offsets

LENGTH, PER_SHARD, ROUNDS = 1024, 4096, 4
#: The stream is put in order by at most so many ranges of ids.
MOST_RANGES = 4096
#: Shards are written in so many turns, and only the pieces of one turn lie shuffled on disk.
TURNS = 4
STEP, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _round(half: np.ndarray, key: np.uint64) -> np.ndarray:
    x = half + key
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The slot of each number below ``size``: a permutation of range(size) chosen by ``seed``."""
    bits = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << bits) - 1)
    keys = [np.uint64((seed * 2 * ROUNDS + r + 1) * int(STEP) % (1 << 64)) for r in range(ROUNDS)]
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> np.uint64(bits), out[walking] & mask
        for key in keys:
            left, right = right, left ^ (_round(right, key) & mask)
        out[walking] = left << np.uint64(bits) | right
        walking = walking[out[walking] >= size]
    return out.astype(np.int64)


def range_of(x: Column, bounds: list[int], step: int = 64) -> Column:
    """How many of the sorted ``bounds`` are below ``x``, 0 for null: first by every ``step``-th of them, then between two."""
    if not bounds:
        return F.lit(0)

    def below(some: Column) -> Column:
        return F.size(F.filter(some, lambda bound: bound < x))

    tables = [F.lit(bounds[k : k + step]) for k in range(0, len(bounds), step)]
    table = below(F.lit(bounds[::step])) - 1
    return F.when(x > bounds[0], table * step + below(F.get(F.array(*tables), table))).otherwise(0)


def token_stream(docs: DataFrame, path: str, key: str, text: str, width: str) -> tuple[DataFrame, int]:
    """``doc_id, n, ids`` with ``start``, the place of each document's first token in the stream; and its length.

    Ids fall into ranges of like numbers of rows. A range is put in order by one shuffle and written with the place of
    each document inside it; a number a range then gives the place in the stream, and ids are not moved for it.
    """
    ranges = min(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    shares = [k / ranges for k in range(1, ranges)]
    found = docs.select(F.percentile_approx(F.col(key).cast("bigint"), shares, 16 * ranges)).first()[0]
    encoded = encode(docs, path, text, [key], width).select(
        range_of(F.col(key).cast("bigint"), sorted(set(found or []))).alias("place"),
        F.col(key).cast("bigint").alias("doc_id"), (F.col("n_tokens") + 1).alias("n"), "ids",
    )
    w = Window.partitionBy("place").orderBy(F.col("doc_id").asc_nulls_first(), "ids").rowsBetween(Window.unboundedPreceding, -1)
    tokens = written(encoded.withColumn("inside", F.coalesce(F.sum("n").over(w), F.lit(0))), "stream-tokens")
    sums = written(tokens.groupBy("place").agg(F.sum("n").alias("n")), "stream-sums")
    total = sums.agg(F.sum("n")).first()[0] or 0
    before = prefix_offsets(sums, [], ["place"], ["n"]).select("place", "before_n")  # at most MOST_RANGES rows
    joined = tokens.join(F.broadcast(before), "place")
    return joined.select("doc_id", "n", "ids", (F.col("before_n") + F.col("inside")).alias("start")), int(total)


def pieces(
    stream: DataFrame, total: int, end: int, length: int, per_shard: int, seed: int, width: str, first: int, stop: int
) -> DataFrame:
    """``shard, slot, seq, at, doc_id, part``: the stretch of each document in each sequence, of shards ``first`` to
    ``stop`` (left out) only."""
    count = -(-total // length)
    schema = "shard bigint, slot bigint, seq bigint, at int, doc_id bigint, part binary"
    item, filler = np.dtype(width).itemsize, np.array([end]).astype(width).tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        start, n = batch.column("start").to_numpy(), batch.column("n").to_numpy()
        earliest = start // length
        times = (start + n - 1) // length - earliest + 1
        row = np.repeat(np.arange(len(n)), times)
        seq = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + earliest[row]
        slot = permuted(seq, count, seed)
        shard = slot // per_shard
        mine = (shard >= first) & (shard < stop)
        row, seq, slot, shard = (x[mine] for x in (row, seq, slot, shard))
        a = np.maximum(start[row], seq * length) - start[row]
        b = np.minimum(start[row] + n[row], (seq + 1) * length) - start[row]
        at = start[row] + a - seq * length
        ids = batch.column("ids")
        # The end token stands behind the ids; a piece that reaches to it is one longer than they are.
        parts = [ids[r].as_py()[x * item : y * item] + (filler if y == m else b"") for r, x, y, m in zip(row.tolist(), a.tolist(), b.tolist(), n[row].tolist())]
        return pa.RecordBatch.from_arrays(
            [pa.array(shard), pa.array(slot), pa.array(seq), pa.array(at.astype(np.int32)), batch.column("doc_id").take(pa.array(row)), pa.array(parts, pa.binary())],
            ["shard", "slot", "seq", "at", "doc_id", "part"],
        )

    return map_arrow(stream.select("doc_id", "n", "ids", "start"), run, schema)


def _assembled(batches: Iterator[pa.RecordBatch], stride: int, filler: bytes) -> Iterator[tuple]:
    """Whole sequences of sorted pieces: shard, slot, seq, bytes, bytes without filling, ids of the documents."""
    now, held, docs = None, bytearray(), []
    for batch in batches:
        for shard, slot, seq, _, doc, part in zip(*(c.to_pylist() for c in batch.columns)):
            if now is not None and now[1] != slot:
                yield *now, bytes(held) + filler * ((stride - len(held)) // len(filler)), len(held), docs
                held, docs = bytearray(), []
            now = (shard, slot, seq)
            held += part
            docs.append(doc)
    if now is not None:
        yield *now, bytes(held) + filler * ((stride - len(held)) // len(filler)), len(held), docs


def materialise(
    docs: DataFrame, path: str, out: str, end: int, width: str = "<u2", length: int = LENGTH, per_shard: int = PER_SHARD,
    seed: int = 1, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Write the shards below ``out`` (a URI all executors can write) and return a row per sequence:
    ``slot, seq, shard, file, byte_offset, n_tokens`` (without filling), ``crc32`` of its stride and ``doc_ids``."""
    stream, total = token_stream(docs, path, key, text, width)
    item = np.dtype(width).itemsize
    stride, filler = length * item, np.array([end]).astype(width).tobytes()
    shards = max(1, -(-total // (length * per_shard)))
    folder = out.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        names = ["slot", "seq", "shard", "file", "byte_offset", "n_tokens", "crc32", "doc_ids"]
        current, sink, draft, rows = None, None, "", []

        def close():
            if sink is not None:
                sink.close()
                store.move(draft, f"{root}/shard-{current:08d}.bin")

        def table(rows):
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for shard, slot, seq, raw, filled, docs in _assembled(batches, stride, filler):
            if shard != current:
                close()
                current, draft = shard, f"{root}/.draft-{uuid.uuid4().hex}"
                sink = store.open_output_stream(draft)
            sink.write(raw)
            rows.append((slot, seq, shard, f"shard-{shard:08d}.bin", slot % per_shard * stride, filled // item, zlib.crc32(raw), docs))
            if len(rows) == 4096:
                yield table(rows)
                rows = []
        close()
        if rows:
            yield table(rows)

    schema = "slot bigint, seq bigint, shard bigint, file string, byte_offset bigint, n_tokens int, crc32 bigint, doc_ids array<bigint>"
    manifests = []
    for first, stop in pairwise(sorted({shards * turn // TURNS for turn in range(TURNS + 1)})):
        cut = pieces(stream, total, end, length, per_shard, seed, width, first, stop)
        laid = cut.repartitionById(stop - first, (F.col("shard") - first).cast("int")).sortWithinPartitions("slot", "at")
        manifests.append(written(laid.mapInArrow(write, schema), "stream-manifest"))
    return reduce(DataFrame.unionByName, manifests)


def read_sequences(out: str, first: int, count: int, width: str = "<u2", length: int = LENGTH, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """Token ids of ``count`` sequences from slot ``first`` on: where a run stopped, the next one goes on."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(out.rstrip("/"))
    stride = length * np.dtype(width).itemsize
    for slot in range(first, first + count):
        with store.open_input_file(f"{root}/shard-{slot // per_shard:08d}.bin") as f:
            yield np.frombuffer(f.read_at(stride, slot % per_shard * stride), width)
