"""Alignment of two tokenizers: pointer jumping over overlapping tokens.

A byte-level BPE (A) and a sentencepiece BPE with byte fallback (B) cut the same bytes:
a blank and the text. Every token points to the token of the other side that reaches
farthest right among those it overlaps; a B token that ends where an A token ends points to
itself. Pointers never go left, so doubling them (each takes its successor's successor)
ends at the last token of each connected stretch, which labels the group. All stretches of
a batch double in the same numpy steps.

Parts. Both tokenizers cut before a single blank between two characters that are no white
space: A by its piece rule, B because none of its pieces holds a blank behind another
character (checked on the model; else texts stay whole). So the parts of a text are
aligned on their own, each distinct one once, and kept in a bounded cache.

Links and counts. A link is an A token and a B token that end at the same byte. Links
stay in an array per document; pairs of ids are counted over all documents by a grouped
sum, and counts go back to the documents by a broadcast join in blocks of BLOCK_PAIRS
pairs, one block unless there are more pairs.

Defined results: a null or empty text has no tokens, nor has one whose bytes either
tokenizer changes (``groups`` is empty then). Special strings are plain text. Rows are
independent, so repeated rows and rows without id each get a row; ties at a B id's highest
count all count as best. An empty table gives no rows. A very long text is one row of its
parts in one task. Only the columns named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.bpe import Vocabulary, gathered, odd_marks, parts_of
from wavemill.llm.common import Numbered, map_arrow, process_cache, text_column, written

CACHED_PARTS = 300_000
#: Bytes of text aligned together.
BATCH_BYTES = 1 << 20
#: Pairs of ids in one broadcast table, of 17 bytes each.
BLOCK_PAIRS = 1 << 20
BLANK = "▁"


def group_labels(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each A token and each B token, from their end offsets over the same bytes."""
    n = len(ends_a)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(ends_b), np.int64)
    to_b = np.searchsorted(ends_b, ends_a)  # the B token that holds an A token's last byte
    to_a = np.searchsorted(ends_a, ends_b)
    own = np.arange(n, n + len(ends_b))
    closes = ends_a[to_a] == ends_b
    after = np.concatenate([n + to_b, np.where(closes, own, to_a)])
    while True:
        doubled = after[after]
        if np.array_equal(doubled, after):
            break
        after = doubled
    number = np.cumsum(closes) - 1  # terminal tokens in order
    labels = number[after - n]
    return labels[:n], labels[n:]


class Pair:
    """Both tokenizers and the parts aligned so far."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = Vocabulary.of(path_a)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        raw = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.byte_size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.byte_start = np.cumsum(self.byte_size) - self.byte_size
        self.all_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.splits = not any(BLANK in p.lstrip(BLANK) for i, p in enumerate(pieces) if not self.model.is_control(i))
        # Decimal ids, each with every mark that may follow it.
        shown = [b"%d%c" % (i, mark) for i in range(max(len(pieces), len(self.a.bytes_of))) for mark in b",|;"]
        self.shown_size = np.fromiter(map(len, shown), np.int64, len(shown))
        self.shown_start = np.cumsum(self.shown_size) - self.shown_size
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.reset()

    def reset(self):
        self.slot = Numbered()
        none = np.zeros(0, np.int64)
        self.counts = np.zeros((0, 3), np.int64)  # A tokens, B tokens, groups
        self.agrees = np.zeros(0, bool)
        self.link_start, self.text_start, self.text_size = none, none, none
        self.links, self.texts = none, np.zeros(0, np.uint8)

    def fill(self):
        """Align the parts that were numbered since the last call."""
        fresh = self.slot.newest(len(self.agrees))
        if not fresh:
            return
        decoded = [p.decode("utf-8", "replace") for p in fresh]
        ids_a, n_a = self.a.encode_parts([" " + p for p in decoded])
        lists = self.model.encode(decoded, num_threads=1)
        n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        ids_a, ids_b = ids_a.astype(np.int64), np.fromiter(chain.from_iterable(lists), np.int64, int(n_b.sum()))
        agrees = self._same_bytes(fresh, self.a, ids_a, n_a) & self._same_bytes(fresh, self, ids_b, n_b)
        if not agrees.all():
            ids_a, ids_b = ids_a[np.repeat(agrees, n_a)], ids_b[np.repeat(agrees, n_b)]
            n_a, n_b = n_a * agrees, n_b * agrees
        of_a, of_b = group_labels(np.cumsum(self.a.byte_size[ids_a]), np.cumsum(self.byte_size[ids_b]))
        # One link a group: its last tokens are the ones that end together.
        ends_a, ends_b = np.diff(of_a, append=-1) != 0, np.diff(of_b, append=-1) != 0
        links = ids_a[ends_a] << 32 | ids_b[ends_b]
        n_groups = np.diff(np.concatenate([[0], np.cumsum(ends_b)])[np.cumsum(n_b)], prepend=0)
        texts, text_size = self._shown(ids_a, ids_b, of_a, of_b, ends_a, ends_b, n_a + n_b)
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups], axis=1)])
        self.agrees = np.concatenate([self.agrees, agrees])
        self.link_start = np.concatenate([self.link_start, len(self.links) + np.cumsum(n_groups) - n_groups])
        self.links = np.concatenate([self.links, links])
        self.text_start = np.concatenate([self.text_start, len(self.texts) + np.cumsum(text_size) - text_size])
        self.text_size = np.concatenate([self.text_size, text_size])
        self.texts = np.concatenate([self.texts, texts])

    @staticmethod
    def _same_bytes(parts: list[bytes], side, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Whether the tokens of each part (``side``: its tokenizer's bytes) are a blank and the part."""
        want = np.frombuffer(b" " + b" ".join(parts), np.uint8)
        want_size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        sums = np.concatenate([[0], np.cumsum(side.byte_size[ids])])
        ends = np.cumsum(counts)
        same = sums[ends] - sums[ends - counts] == want_size
        if not same.all():
            keep = np.repeat(same, counts)
            ids, want = ids[keep], want[np.repeat(same, want_size)]
        got, _ = gathered(side.all_bytes, side.byte_start[ids], side.byte_size[ids])
        wrong = np.concatenate([[0], np.cumsum(got != want)])
        upto = np.cumsum(want_size[same])
        same[same] = wrong[upto] == wrong[upto - want_size[same]]
        return same

    def _shown(self, ids_a, ids_b, of_a, of_b, ends_a, ends_b, tokens) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;a3|b2;`` of all parts in a row, and how many bytes each part (of so many ``tokens``) has."""
        groups = int(ends_b.sum())
        before_b = np.cumsum(np.bincount(of_b, minlength=groups)) - np.bincount(of_b, minlength=groups)
        upto_a = np.cumsum(np.bincount(of_a, minlength=groups))
        order = np.zeros(len(ids_a) + len(ids_b), np.int64)  # A tokens of a group, then its B tokens
        order[np.arange(len(ids_a)) + before_b[of_a]] = ids_a * 3 + ends_a
        order[np.arange(len(ids_b)) + upto_a[of_b]] = ids_b * 3 + 2 * ends_b
        sizes = self.shown_size[order]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        return gathered(self.shown, self.shown_start[order], sizes)[0], np.diff(sums[np.cumsum(tokens)], prepend=0)

    def align(self, texts: Sequence[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Per text: counts of A tokens, B tokens and groups; the groups as text; all links in a row and how many each has."""
        if len(self.slot) > CACHED_PARTS:
            self.reset()
        odd = odd_marks(texts)
        slots = []
        for text in texts:
            parts = parts_of(text, *odd) if text and self.splits else [b" " + text] if text else []
            if parts:
                parts[0] = parts[0][1:]
            slots.append(np.fromiter(map(self.slot.__getitem__, parts), np.int64, len(parts)))
        self.fill()
        # Bytes that a tokenizer changes in one part are changed in the whole text.
        slots = [s if self.agrees[s].all() else s[:0] for s in slots]
        flat = np.concatenate(slots) if slots else np.zeros(0, np.int64)
        ends = np.cumsum([len(s) for s in slots], dtype=np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(self.counts[flat], axis=0)])
        counts = sums[ends] - sums[begins] if len(ends) else np.zeros((0, 3), np.int64)
        raw, done = gathered(self.texts, self.text_start[flat], self.text_size[flat])
        at = np.concatenate([[0], done])
        groups = [raw[at[a] : max(at[a], at[b] - 1)].tobytes() for a, b in zip(begins.tolist(), ends.tolist())]
        links, _ = gathered(self.links, self.link_start[flat], self.counts[flat, 2])
        return counts, groups, links, counts[:, 2]


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", groups: bool = False) -> DataFrame:
    """``key, n_a, n_b, n_groups, groups_sha256`` of every row, ``links`` (``a << 32 | b`` each); with ``groups`` the
    groups themselves, as ``a1,a2|b1;a3|b2,b3``."""
    kept = docs.select(F.col(key).cast("bigint").alias("key"), text_column(text).alias("text"))
    schema = "key bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links array<bigint>" + (", groups string" if groups else "")
    names = ["key", "n_a", "n_b", "n_groups", "groups_sha256", "links", *["groups"] * groups]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pair = process_cache(f"pair:{path_a}:{path_b}", lambda: Pair(path_a, path_b))
        counts, written_groups, links, n_links = pair.align(batch.column(1).to_pylist())
        offsets = np.concatenate([[0], np.cumsum(n_links)]).astype(np.int32)
        columns = [
            batch.column(0),
            *(pa.array(counts[:, k], pa.int64()) for k in range(3)),
            pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in written_groups], pa.string()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(links, pa.int64())),
        ]
        if groups:
            columns.append(pa.array([g.decode() for g in written_groups], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(kept, run, schema, BATCH_BYTES).withColumnRenamed("key", key)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, count, best`` over all links: ``best`` if no pair with the same B id has a higher count."""
    counts = rows.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    counts = written(counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))), "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def linked_counts(rows: DataFrame, pairs: DataFrame, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``row, n_best, count_sum`` of every row with links, from written ``rows`` and ``pairs``."""
    links = rows.select("row", F.explode("links").alias("pair"))
    blocks = max(1, -(-pairs.count() // block_pairs))
    sums = []
    for k in range(blocks):
        some = pairs.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k) if blocks > 1 else pairs
        met = links.join(F.broadcast(some), "pair")
        sums.append(met.groupBy("row").agg(F.sum(F.col("best").cast("bigint")).alias("n_best"), F.sum("count").alias("count_sum")))
    both = reduce(DataFrame.unionByName, sums)
    return both if blocks == 1 else both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    rows = aligned(docs, path_a, path_b, key, text).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows.withColumnRenamed(key, "key"), "aligned")
    pairs = written(pair_counts(rows), "aligned-pairs")
    counted = rows.drop("links").join(linked_counts(rows, pairs, block_pairs), "row", "left")
    zero = F.lit(0).cast("bigint")
    return counted.select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
