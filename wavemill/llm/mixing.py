"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: every source asks for a share of the budget by weight; none gets more than
``most`` times its size, and what is over goes to the others by weight. The words of a
source are then drawn in blocks: documents fall into BLOCKS blocks by a hash, each
epoch permutes the blocks by a keyed hash, and blocks are taken in that order until the
target is met. The last block is taken in the order of a finer hash, its last document
in part, so a source's words meet the rounded target exactly.

How many blocks of each source go to each output shard is drawn by a binary tree over
the shards: a node's quotas are split between its halves by a multivariate
hypergeometric draw, source by source. A shard takes disjoint stretches of the permuted
blocks and orders its documents by a hash of its own. All of it is DataFrame functions;
tables of blocks and quotas have rows per source, never per document.

Defined results: a null or empty text has size 0 and is never taken; a null source is a
source, the last. A very long text is a document like any other and may be the one that is
cut. Columns beside ``doc_id``, ``source`` and the text are not read and pass through under any name. Rows with equal ids and texts share a hash, so copies are taken
alike but for the one document that the target cuts. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.llm.common import WORD, fresh_names, written
from wavemill.operators.ranking import join_null_safe

BLOCKS = 256
SHARDS = 16
WEIGHTS = (3, 1, 2)
BUDGET, MOST = 1.5, 2
#: Digits (base 256) of a document's hash: block, then two levels inside the block that the target cuts.
DIGITS = 3


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def hashed(seed: str, *parts: Column) -> Column:
    """63 bits of a keyed hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 1)


def uniform(seed: str, *parts: Column) -> Column:
    """Uniform between 0 and 1, both left out."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 12).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """``source, source_size`` with ``place``, ``weight`` and ``target`` added.

    The least level at which all targets ``min(most * size, weight * level)`` use up the
    budget. Sources are ordered by the level at which they fill up, ``most * size /
    weight``; the first that does not fill up shares what is left with those behind it.
    """
    everything = Window.partitionBy()
    named = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = named.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), F.col("place") % len(weights)))
    capped = weighed.withColumn("cap", F.col("source_size") * most)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.lit(budget) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    open_level = capped.withColumn("level", level).withColumn("open", F.col("weight") * F.col("level") <= F.col("cap"))
    first_open = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(everything)
    return open_level.withColumn("level", first_open["level"]).select(
        "source",
        "source_size",
        "place",
        "weight",
        F.coalesce(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")), F.col("cap").cast("double")).alias("target"),
    )


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are among the ``marked``, from a uniform ``u``.

    Values are taken from the mode downwards, then from above it upwards. Probabilities
    relative to the mode (exact ratios, no factorials) are summed once, then added up in
    that order until they reach ``u`` of the sum: three running numbers, no array of them.
    """

    def named(values: dict[str, Column], use) -> Column:
        """``use`` of a struct that is worked out once and not once for each of its uses."""
        return F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), use)[0]

    def bounds(v: Column) -> Column:
        low = F.greatest(F.lit(0).cast("bigint"), v["drawn"] - (v["total"] - v["marked"]))
        high = F.least(v["drawn"], v["marked"])
        mode = F.floor((v["drawn"] + 1) * (v["marked"] + 1) / (v["total"] + 2)).cast("bigint")
        kept = {n: v[n] for n in ("total", "marked", "drawn", "u")}
        return named(kept | {"low": low, "high": high, "mode": F.greatest(low, F.least(high, mode))}, picked)

    def steps(count: Column) -> Column:
        return F.when(count > 0, F.sequence(F.lit(1).cast("bigint"), count)).otherwise(F.array().cast("array<bigint>"))

    def picked(v: Column) -> Column:
        def ratio(k: Column) -> Column:
            """P(k) / P(k - 1)."""
            return ((v["marked"] - k + 1) * (v["drawn"] - k + 1)).cast("double") / (k * (v["total"] - v["marked"] - v["drawn"] + k)).cast("double")

        sides = ((steps(v["mode"] - v["low"]), lambda i: F.lit(1.0) / ratio(v["mode"] - i + 1)), (steps(v["high"] - v["mode"]), lambda i: ratio(v["mode"] + i)))

        def mass(side) -> Column:
            start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
            return F.aggregate(side[0], start, lambda a, i: F.struct((a["p"] * side[1](i)).alias("p"), (a["sum"] + a["p"] * side[1](i)).alias("sum")))["sum"]

        def search(w: Column) -> Column:
            """Steps down from the mode, or up from it where all below is not enough: the first whose sum reaches the goal."""

            def walk(side, before: Column) -> Column:
                start = F.struct(F.lit(1.0).alias("p"), before.alias("sum"), F.lit(1).cast("bigint").alias("steps"))
                grown = lambda a, i: F.struct(
                    (a["p"] * side[1](i)).alias("p"),
                    (a["sum"] + a["p"] * side[1](i)).alias("sum"),
                    (a["steps"] + F.when(a["sum"] + a["p"] * side[1](i) < w["goal"], 1).otherwise(0)).alias("steps"),
                )
                return F.aggregate(side[0], start, grown)["steps"]

            down = F.greatest(v["low"], v["mode"] - walk(sides[0], F.lit(1.0)))
            up = F.least(v["high"], v["mode"] + walk(sides[1], F.lit(1.0) + w["below"]))
            return F.when(w["goal"] <= 1.0, v["mode"]).when(w["goal"] <= 1.0 + w["below"], down).otherwise(up)

        return named({"below": mass(sides[0]), "above": mass(sides[1])}, lambda m: named({"below": m["below"], "goal": v["u"] * (1.0 + m["below"] + m["above"])}, search))

    return named({"total": total.cast("bigint"), "marked": marked.cast("bigint"), "drawn": drawn.cast("bigint"), "u": u}, bounds)


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: str = "mix") -> DataFrame:
    """``place, quota`` (blocks per source) to ``place, shard, n, before``: blocks of each source in each shard.

    ``before``: blocks of the source in earlier shards. One row holds the quotas of all
    sources at a node; both halves of a node get slots in proportion to their shards.
    """
    if shards & (shards - 1):
        raise ValueError("the tree is binary: shards must be a power of two")
    zero = F.lit(0).cast("bigint")
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("place", "quota"))).alias("all")).select(
        F.lit(0).alias("node"), F.transform("all", lambda s: s["place"]).alias("places"), F.transform("all", lambda s: s["quota"]).alias("q")
    )
    width = shards
    while width > 1:
        total = F.aggregate("q", zero, lambda a, x: a + x)
        # Half of the slots; an odd one goes by a draw.
        half = F.floor((F.col("__total") + F.when(uniform(f"{seed}:odd", F.lit(width), F.col("node")) < 0.5, 1).otherwise(0)) / 2)
        sized = nodes.withColumn("__total", total).withColumn("__half", half.cast("bigint"))
        start = F.struct(F.col("__total").alias("rest"), F.col("__half").alias("slots"), F.array().cast("array<bigint>").alias("left"))

        def draw(a: Column, s: Column) -> Column:
            u = uniform(f"{seed}:split:{width}", F.col("node"), s["places"])
            k = hypergeometric(a["rest"], s["q"], a["slots"], u)
            # An array of one, so that the draw is worked out once and not once for each use.
            return F.transform(F.array(k), lambda v: F.struct((a["rest"] - s["q"]).alias("rest"), (a["slots"] - v).alias("slots"), F.concat(a["left"], F.array(v)).alias("left")))[0]

        left = sized.withColumn("__left", F.aggregate(F.arrays_zip("places", "q"), start, draw)["left"])
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("__left").alias("q")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", "__left", lambda a, b: a - b).alias("q")),
        )
        nodes = left.select("places", F.explode(halves).alias("h")).select("h.node", "places", "h.q")
        width //= 2
    leaves = nodes.select(F.col("node").alias("shard"), F.explode(F.arrays_zip("places", "q")).alias("s")).select(
        F.col("s.places").alias("place"), "shard", F.col("s.q").alias("n")
    )
    earlier = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("before", F.coalesce(F.sum("n").over(earlier), zero))


def draw_blocks(blocks: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """The blocks each source draws, in order: ``source, place, block, epoch, drawn`` (number of the draw from 0),
    ``words`` of the block and ``room`` (words left for it; less than ``words``: the target cuts this block)."""
    epochs = blocks.where("words > 0").join(targets.select("place", F.round("target").cast("bigint").alias("goal")), "place")
    epochs = epochs.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(MOST)])))
    order = Window.partitionBy("place").orderBy("epoch", hashed(f"{seed}:permute", F.col("place"), F.col("epoch"), F.col("block")), "block")
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        epochs.withColumn("drawn", F.row_number().over(order) - 1)
        .withColumn("room", F.col("goal") - before)
        .where("room > 0")
        .select("source", "place", "block", "epoch", "drawn", "words", "room")
    )


def parts_taken(sized: DataFrame, cut: DataFrame) -> DataFrame:
    """Add ``part``: words taken of a document where its block is the one that the target cuts, else 0.

    ``room`` words are taken in the order of the finer digits. Digit by digit the sums of
    the sub-blocks show in which one the room ends, so that only the documents of a last,
    small one are put in a row.
    """
    tagged = join_null_safe(sized, cut.select("source", "block", F.col("room").alias("__left")), ["source", "block"], "left")
    settled = [tagged.where(F.col("__left").isNull()).drop("__left").withColumn("part", F.lit(0).cast("bigint"))]
    inside = tagged.where(F.col("__left").isNotNull())
    for digit in range(1, DIGITS):
        name = f"digit{digit}"
        sums = inside.groupBy("source", name).agg(F.sum("size").alias("__words"), F.first("__left").alias("__left"))
        earlier = Window.partitionBy("source").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        left = F.col("__left") - F.coalesce(F.sum("__words").over(earlier), F.lit(0))
        sums = sums.select("source", name, "__words", left.alias("__left"))
        tagged = join_null_safe(inside.drop("__left"), sums, ["source", name])
        open_here = (F.col("__left") > 0) & (F.col("__left") < F.col("__words"))
        part = F.when(F.col("__left") > 0, F.col("size")).otherwise(F.lit(0).cast("bigint"))
        settled.append(tagged.where(~open_here).withColumn("part", part).drop("__words", "__left"))
        inside = tagged.where(open_here).drop("__words")
    earlier = Window.partitionBy("source").orderBy("__h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__left") - F.coalesce(F.sum("size").over(earlier), F.lit(0))
    out = inside.withColumn("part", F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), left))).drop("__left")
    for done in settled:
        out = out.unionByName(done.select(*out.columns))
    return out


def document_hash(seed: str, text: str = "text") -> Column:
    return F.xxhash64(F.lit(f"{seed}:document"), F.col("doc_id"), F.xxhash64(text))


class Plan:
    """What a mix decides, as written tables: ``sized`` (a row per document), ``targets`` and ``copies`` (rows per source)."""

    def __init__(self, docs: DataFrame, shards: int, seed: str, weights: Sequence[int], budget: float, text: str):
        digits = {f"digit{d}": F.pmod(F.shiftrightunsigned("__h", 8 * d), F.lit(256)).cast("int") for d in range(1, DIGITS)}
        sized = docs.select("doc_id", "source", word_count(text).alias("size"), document_hash(seed, text).alias("__h"))
        sized = written(sized.withColumn("block", block_of(F.col("__h"))).withColumns(digits), "mix-sizes")
        per_block = written(sized.groupBy("source", "block").agg(F.sum("size").alias("words")), "mix-blocks")
        targets = source_targets(per_block.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget)
        self.sized, self.targets = sized, written(targets, "mix-targets")
        placed = join_null_safe(per_block, self.targets.select("source", "place"), ["source"])
        draws = written(draw_blocks(placed, self.targets, seed), "mix-draws")
        quotas = written(split_quotas(draws.groupBy("place").agg(F.count(F.lit(1)).alias("quota")), shards, seed), "mix-quotas")
        in_shard = (draws["drawn"] >= quotas["before"]) & (draws["drawn"] < quotas["before"] + quotas["n"])
        dealt = draws.join(quotas, (draws["place"] == quotas["place"]) & in_shard).drop(quotas["place"])
        is_cut = F.col("room") < F.col("words")
        draw = F.struct("epoch", "shard", is_cut.alias("is_cut"))
        copies = dealt.groupBy("source", "block").agg(F.sort_array(F.collect_list(draw)).alias("draws"), F.max(is_cut).alias("cut_here"))
        self.copies = written(copies, "mix-copies")
        self.parts = parts_taken(sized, draws.where(is_cut)).drop(*digits)


def block_of(h: Column) -> Column:
    return F.pmod(h, F.lit(BLOCKS)).cast("int")


def slot_key(seed: str, h: Column, epoch: Column) -> Column:
    return F.xxhash64(F.lit(f"{seed}:slot"), h, epoch)


def mix(
    docs: DataFrame, shards: int = SHARDS, seed: str = "mix", weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, text: str = "text"
) -> DataFrame:
    """A row per document: ``doc_id, source, size, source_size, target, taken``, its hash ``__h`` and ``copies``,
    an array of ``epoch, shard, words, slot_key``. In a shard, copies are ordered by ``slot_key``."""
    plan = Plan(docs, shards, seed, weights, budget, text)
    planned = join_null_safe(plan.parts, plan.copies.drop("cut_here"), ["source", "block"], "left")
    planned = join_null_safe(planned, plan.targets.select("source", "source_size", "target"), ["source"], "left")

    def copy(d: Column) -> Column:
        words = F.when(d["is_cut"], F.col("part")).otherwise(F.col("size"))
        return F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), words.alias("words"), slot_key(seed, F.col("__h"), d["epoch"]).alias("slot_key"))

    nothing = F.array().cast("array<struct<epoch:int,shard:int,is_cut:boolean>>")
    made = F.filter(F.transform(F.coalesce("draws", nothing), copy), lambda c: c["words"] > 0)
    return planned.select(
        "doc_id", "source", "size", "source_size", "target", "__h", made.alias("copies")
    ).withColumn("taken", F.aggregate("copies", F.lit(0).cast("bigint"), lambda a, c: a + c["words"]))


def mixed_documents(
    docs: DataFrame, shards: int = SHARDS, seed: str = "mix", weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, text: str = "text"
) -> DataFrame:
    """The documents as the mix holds them, with the columns of ``docs``: a row per copy. The copy that the target
    cuts ends behind its last word taken, all before it as it was. Rows lie in the order of the shards, in a
    shard by ``slot_key``.

    What is drawn is known per block of a source, so documents meet it where they lie; only those in a
    block that the target cuts (one in BLOCKS of a source) are matched one by one. Texts move once, by shard.
    """
    plan = Plan(docs, shards, seed, weights, budget, text)
    h, block, draws, cut, row, shard, key, words = fresh_names(docs, "h", "block", "draws", "cut", "row", "shard", "slot_key", "words")
    ours = docs.withColumn(h, document_hash(seed, text)).withColumn(block, block_of(F.col(h)))
    drawn = plan.copies.select(F.col("source").alias("drawn_source"), F.col("block").alias("drawn_block"), F.col("draws").alias(draws), F.col("cut_here").alias(cut))
    met = ours.join(drawn.alias("drawn"), F.col("drawn.drawn_source").eqNullSafe(F.col("source")) & (F.col("drawn.drawn_block") == F.col(block)))
    met = met.where(F.col(text).rlike(WORD)).select(*docs.columns, h, draws, cut)
    whole = met.where(~F.col(cut)).withColumn(words, F.array().cast("array<bigint>"))

    # Equal rows are numbered: those before the last word taken are whole, one is in part, the others are left out.
    close = written(met.where(cut).withColumn(row, F.monotonically_increasing_id()), "mix-cut")
    part, mine = F.shiftrightunsigned("row", 33).alias("part"), ["doc_id", "source", "h"]
    keys = close.select("doc_id", "source", F.col(h).alias("h"), F.col(row).alias("row")).select("*", part)
    groups = keys.groupBy(*mine, "part").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy(*mine).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = groups.select(*mine, "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*mine, "part").orderBy("row")) - 1
    placed = join_null_safe(keys.withColumn("inside", inside), before, [*mine, "part"])
    taken = plan.parts.groupBy("doc_id", "source", F.col("__h").alias("h")).agg(F.sum("part").alias("taken"), F.first("size").alias("size"))
    left = F.col("taken") - (F.col("before") + F.col("inside")) * F.col("size")
    share = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), left))
    shares = join_null_safe(placed, taken, mine).select(F.col("row").alias(row), F.when(share < F.col("size"), F.array(share)).otherwise(F.array().cast("array<bigint>")).alias(words))
    rows = whole.unionByName(close.join(shares, row).drop(row))

    copies = rows.select(*docs.columns, h, F.explode(draws).alias(draws), words)
    copies = copies.withColumn(words, F.when(F.col(f"{draws}.is_cut"), F.get(words, F.lit(0)))).where(F.col(words).isNull() | (F.col(words) > 0))
    copies = copies.select(*docs.columns, words, F.col(f"{draws}.shard").alias(shard), slot_key(seed, F.col(h), F.col(f"{draws}.epoch")).alias(key))
    # The key is a hash, so even stretches of its range hold like numbers of copies.
    stretches = max(1, -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))
    place = F.floor((F.shiftright(key, 32) + F.lit(1 << 31)) * F.lit(stretches) / F.lit(1 << 32)).cast("int")
    laid = copies.repartitionById(shards * stretches, F.col(shard) * stretches + place).sortWithinPartitions(shard, key)
    pieces = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    start = F.array_join(F.slice(pieces, 1, F.col(words).cast("int")), "")
    return laid.select(*[F.when(F.col(words).isNull(), F.col(c)).otherwise(start).alias(c) if c == text else F.col(c) for c in docs.columns])
