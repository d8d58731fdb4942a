"""Benchmark decontamination: a broadcast hash set of test n-grams meets every window of the training words.

Words are lower-cased (A-Z) runs of letters, digits and characters beyond ASCII. A window
of a benchmark item is ``width`` words in a row; an item of fewer words is one window. The
distinct windows form a table of (hash, size, words) that is broadcast. Documents are cut
into words once and exploded by position; the hash of the words at a position is looked
up, and a find counts only where the words themselves agree. A word inside any window
found is hit. All of it is DataFrame functions, and a document's text is read once.

The set is broadcast in blocks of BLOCK_BYTES at most, so its size is proven: a larger
benchmark takes more passes over the documents, none of them cut short. Windows shared by
many items are looked up once; their items are joined, in blocks likewise, after the
windows of a document are distinct.

Defined results: a null or empty text, and a text without words, has no words and is never
hit; such an item has no windows. Repeated items and windows count once. An item without id
hits words but is not counted or named. Rows are independent: repeated rows and rows
without id each get a row of their own. A very long text is one array of its words in
one task. Empty tables give no rows, or rows without hits. Only the columns named are
read; ``decontaminate`` passes all others through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import fresh_names, written

#: What words are made of and what stands between them; A-Z are lower-cased first where words are compared.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WIDTH = 10
BLOCK_BYTES = 32 << 20
#: Bytes a row of a broadcast table takes beside its strings.
ROW_BYTES = 64


def words_of(text: Column) -> Column:
    """The words of a text in order; none for a null."""
    plain = F.coalesce(text.cast("string"), F.lit(""))
    # In a text of ASCII alone, Spark's own lower-casing does the same and is faster.
    lowered = F.when(F.octet_length(plain) == F.char_length(plain), F.lower(plain)).otherwise(F.translate(plain, UPPER, LOWER))
    return F.array_remove(F.split(lowered, f"{GAP}+"), "")


def window_hash(hashes: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from ``at`` on, from the hashes of the words; words past the end are left out."""
    return F.xxhash64(*[F.get(hashes, at + k) for k in range(size)])


def in_blocks(rows: DataFrame, by: Sequence[str], size: Column, limit: int) -> list[DataFrame]:
    """``rows`` cut by a hash of ``by`` into tables of about ``limit`` bytes, by a sum of ``size``."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    count = max(1, -(-int(total) // limit))
    if count == 1:
        return [rows]
    return [rows.where(F.pmod(F.xxhash64(F.lit("block"), *by), F.lit(count)) == k) for k in range(count)]


class TestSet:
    """The distinct windows of a benchmark and the items they come from, as written tables."""

    __test__ = False

    def __init__(self, items: DataFrame, key: str = "item_id", text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES):
        worded = items.select(F.col(key).cast("string").alias("item"), words_of(F.col(text)).alias("words"))
        size = F.least(F.size("words"), F.lit(width))
        starts = F.sequence(F.lit(0), F.size("words") - size)
        grams = F.transform(starts, lambda i: F.array_join(F.slice("words", i + 1, size), " "))
        cut = worded.where(F.size("words") > 0).select("item", size.alias("size"), F.explode(F.array_distinct(grams)).alias("gram"))
        cut = written(cut.distinct(), "bench-windows")
        parts = F.transform(F.split("gram", " "), lambda w: F.xxhash64(w))
        distinct = cut.groupBy("gram", "size").agg(F.lit(1)).select("gram", "size", window_hash(parts, F.lit(0), width).alias("hash"))
        self.grams = written(distinct.withColumn("id", F.monotonically_increasing_id()), "bench-grams")
        named = cut.where(F.col("item").isNotNull()).join(self.grams.select("gram", "id"), "gram").select("id", "item")
        self.items = written(named, "bench-items")
        self.width = width
        self.sizes = sorted(r[0] for r in self.grams.select("size").distinct().collect())  # at most ``width`` of them
        self.gram_blocks = in_blocks(self.grams, ["gram"], F.octet_length("gram") + ROW_BYTES, block_bytes)
        self.item_blocks = in_blocks(self.items, ["id", "item"], F.octet_length("item") + ROW_BYTES, block_bytes)


def window_hits(docs: DataFrame, tests: TestSet, key: Sequence[str], text: str) -> DataFrame:
    """``k0, k1, .., n_words`` of every row, and beside it, a row each, the windows found: ``at, size, id``.

    The row at the first word of a document (or without any) is always there, so no
    document is lost and none has to be read again.
    """
    names = [f"k{n}" for n in range(len(key))]
    cut = docs.select(*[F.col(k).alias(n) for k, n in zip(key, names)], F.xxhash64(text).alias("h"), words_of(F.col(text)).alias("words"))
    hashed = cut.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    placed = hashed.select("*", F.size("words").cast("bigint").alias("n_words"), F.posexplode_outer("hashes").alias("at", "word")).drop("word")
    sizes = tests.sizes or [tests.width]
    fits = {s: F.when(F.col("at") + s <= F.col("n_words"), window_hash(F.col("hashes"), F.col("at"), s)) for s in sizes}
    if len(sizes) == 1:
        sized = placed.select("*", F.lit(sizes[0]).alias("size"), fits[sizes[0]].alias("hash"))
    else:
        looked = F.array(*[F.struct(F.lit(s).alias("size"), h.alias("hash")) for s, h in fits.items()])
        sized = placed.select("*", F.inline(looked))
    # Not written as an equality: that would become a key of the join, worked out at every position.
    words = F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " ")
    same = words.startswith(F.col("gram")) & (F.octet_length(words) <= F.octet_length("gram"))
    keep = [*names, "h", F.spark_partition_id().alias("part"), "n_words"]
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    found = []
    for n, block in enumerate(tests.gram_blocks):
        grams = F.broadcast(block.select("hash", F.col("size").alias("gram_size"), "gram", "id"))
        met = sized.join(grams, (sized["hash"] == grams["hash"]) & (F.col("size") == F.col("gram_size")) & same, "left" if n == 0 else "inner")
        is_base = (first & (F.col("size") == sizes[0])) if n == 0 else F.lit(False)
        rows = met.where(is_base | F.col("id").isNotNull())
        found.append(rows.select(*keep, is_base.alias("base"), "at", "size", "id"))
    return reduce(DataFrame.unionByName, found)


def hit_documents(docs: DataFrame, tests: TestSet, key: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """A row per row of ``docs``: the ``key`` columns, ``n_words``, ``n_hit`` and ``items`` (ids as sorted strings).

    Rows are told apart by key, text hash and input partition; rows equal in all three are
    counted and repeated at the end, so the copies of one row never meet in one task.
    """
    names = [f"k{n}" for n in range(len(key))]
    whole = [*names, "h", "part"]
    hits = window_hits(docs, tests, key, text)
    window = F.when(F.col("id").isNotNull(), F.struct("at", "size"))
    # A window whose first word a document starts with shows up on the base row as well; sets take it once.
    rows = hits.groupBy(*whole).agg(
        F.first("n_words").alias("n_words"),
        F.sum(F.col("base").cast("bigint")).alias("rows"),
        F.sort_array(F.collect_set(window)).alias("windows"),
        F.collect_set("id").alias("ids"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("reach"), F.lit(0).cast("bigint").alias("hit"))

    def cover(a: Column, w: Column) -> Column:
        end = (w["at"] + w["size"]).cast("bigint")
        more = F.greatest(F.lit(0).cast("bigint"), end - F.greatest(a["reach"], w["at"].cast("bigint")))
        return F.struct(F.greatest(a["reach"], end).alias("reach"), (a["hit"] + more).alias("hit"))

    counted = rows.withColumn("n_hit", F.aggregate("windows", start, cover)["hit"]).drop("windows")
    spread = counted.select("*", F.explode_outer("ids").alias("id")).drop("ids")
    named = []
    for n, block in enumerate(tests.item_blocks):
        named.append(spread.join(F.broadcast(block), "id", "left" if n == 0 else "inner").drop("id"))
    items = reduce(DataFrame.unionByName, named).groupBy(*whole).agg(
        *[F.first(c).alias(c) for c in ("n_words", "rows", "n_hit")], F.sort_array(F.collect_set("item")).alias("items")
    )
    each = items.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("copy"))
    return each.select(*[F.col(n).alias(k) for n, k in zip(names, key)], "n_words", "n_hit", "items")


def decontaminate(docs: DataFrame, tests: TestSet, remove: str = "spans", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without what the benchmark holds, with the columns and rows it came with.

    ``remove="documents"`` leaves out every document with a hit word. ``remove="spans"``
    takes out the hit words, each with what stands between it and the word before; what
    follows the last word stays. Copies of a document are treated alike.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    place, clean = fresh_names(docs, "place", "clean")
    hits = window_hits(docs, tests, [key], text).where(F.col("id").isNotNull())
    spots = hits.select(F.struct(F.col("k0").alias("key"), "h").alias("doc"), F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("at"))
    spots = written(spots.distinct(), "bench-hits")
    mine = docs.withColumn(place, F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("h")))
    dirty = spots.select(F.col("doc").alias(place)).distinct()
    if remove == "documents":
        return mine.join(dirty, place, "left_anti").drop(place)
    texts = mine.join(dirty, place, "left_semi").select(F.col(place).alias("doc"), F.col(text).alias("text")).dropDuplicates(["doc"])
    tail = F.regexp_extract("text", f"({GAP}*)$", 1)
    pieces = F.regexp_extract_all("text", F.lit(f"{GAP}*{WORD}"), F.lit(0))
    cut = texts.select("doc", tail.alias("tail"), F.posexplode(pieces).alias("at", "piece")).join(spots, ["doc", "at"], "left_anti")
    left = cut.groupBy("doc").agg(F.first("tail").alias("tail"), F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("pieces"))
    rebuilt = left.select("doc", F.concat(F.array_join("pieces.piece", ""), "tail").alias("text"))
    # A document without any other word keeps what follows its last one.
    bare = texts.join(left.select("doc"), "doc", "left_anti").select("doc", tail.alias("text"))
    renewed = rebuilt.unionByName(bare).select(F.col("doc").alias(place), F.col("text").alias(clean))
    out = mine.join(renewed, place, "left")
    return out.select(*[F.coalesce(clean, c).alias(c) if c == text else F.col(c) for c in docs.columns])
