"""Near-duplicates by SuperMinHash signatures, banding, verification and union-find grouping.

Signatures. Every element of a set draws a permutation of the signature's places step by
step; at step j it offers ``j + r`` (r uniform) to its j-th place, and a place keeps the
smallest offer. Steps of all elements run together, and a set stops as soon as each of
its places has an offer of an earlier step, so large sets need one or two steps.

Links. Equal sets form one class, whose smallest id stands for it. Representatives that
share a band are candidates. First each is compared with the smallest one it shares most
bands with, which joins tight groups by one comparison a member. Buckets whose members
then lie in one component are done. In the others, centres of different components are
compared, and members only where the triangle inequality of the Jaccard distance leaves
room for a link; they meet in chunks, and no list of their pairs is made. Nodes that stand
alone meet in blocks of their bucket, where a positional prefix bound over the elements
rarest in the block rules pairs out exactly; a block returns links that join what is linked. So every candidate pair is verified on full sets, implied or ruled out.
Not found are pairs that share no band: with 40 bands of 5 rows, 1.3e-7 of those at 0.8.

Defined results: a null or empty text has an empty set, is linked with nothing and is its
own component. A text with fewer words than a shingle has its whole sequence as the only
element. A row without id takes part in no group (component null, not kept). Rows with the same id are one node. Ties go to the
smaller id; repeated rows share a component and only equal ids to the smallest are kept.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import Numbered, map_arrow, maybe_among, process_cache, text_column, written

BANDS, ROWS = 40, 5
PLACES = BANDS * ROWS
#: Fixed values of the 64-bit finaliser and its increment.
STEP, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: An estimate may fall short of the similarity by this much: about five standard deviations at PLACES.
SLACK = 0.14
#: Rounding of sums of a few distances; a bound may be met by this much too late, never too early.
ROUNDING = 1e-9
CACHED_WORDS = 250_000
#: Members of a group that meet others in one task.
CHUNK = 2000
#: Elements whose permutations are drawn together.
STEP_ELEMENTS = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of the words seen so far, emptied when it holds more than CACHED_WORDS."""

    def __init__(self):
        self.reset()

    def reset(self):
        self.slot = Numbered()
        self.hashes = np.zeros(0, np.uint64)

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """Hashes of the words of each text, in order, A-Z lower-cased."""
        if len(self.slot) > CACHED_WORDS:
            self.reset()
        words = [t.lower().split() for t in texts]
        slots = [np.fromiter(map(self.slot.__getitem__, w), np.int64, len(w)) for w in words]
        fresh = self.slot.newest(len(self.hashes))
        self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), np.uint64, len(fresh))])
        return [self.hashes[s] for s in slots]


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes."""
    out = []
    for words in process_cache("words", WordHashes).of(texts):
        n = len(words)
        size = min(width, n)
        hashes = np.full(max(0, n - size + 1) if n else 0, size, np.uint64)
        for k in range(size):
            hashes = mixed((hashes ^ words[k : n - size + 1 + k]) * MIX_A + STEP)
        out.append(np.unique(hashes))
    return out


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """SuperMinHash of each set: (len(sets), places), the smallest ``step << 32 | r`` offered to each place."""
    out = np.full((len(sets), places), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets])
    start = 0
    while start < len(sets):  # a run of sets with at most STEP_ELEMENTS elements, or one set
        end = max(start + 1, int(np.searchsorted(np.cumsum(sizes[start:]), STEP_ELEMENTS, side="right")) + start)
        _offer(sets[start:end], out[start:end])
        start = end
    return out


def _offer(sets: list[np.ndarray], out: np.ndarray) -> None:
    places = out.shape[1]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    state = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    swaps: list[np.ndarray] = []  # the place each element swapped with, by step
    flat = out.reshape(-1)
    for step in range(places):
        if not len(state):
            return
        state = state + STEP
        bits = mixed(state)
        other = step + ((bits >> np.uint64(32)) * np.uint64(places - step) >> np.uint64(32)).astype(np.int64)
        # What stands at ``other`` after the earlier swaps: follow them backwards.
        place = other.copy()
        for earlier in range(step - 1, -1, -1):
            place[swaps[earlier] == place] = earlier
        offer = np.uint64(step) << np.uint64(32) | (bits & np.uint64(0xFFFFFFFF))
        np.minimum.at(flat, owner * places + place, offer)
        swaps.append(other)
        # Later offers are larger than any of this step: a set whose places all have one is done.
        going = out.max(axis=1) == np.iinfo(np.uint64).max
        stay = going[owner]
        if not stay.all():
            owner, state = owner[stay], state[stay]
            swaps = [s[stay] for s in swaps]


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    rows = signature.shape[1] // bands
    parts = signature.reshape(len(signature), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * STEP, (len(signature), bands))
    for r in range(rows):
        keys = mixed((keys ^ parts[:, :, r]) * MIX_A + STEP)
    return keys


def sign(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``node, n_shingles, fingerprint`` (of the set; null if empty), ``bands`` and ``sketch`` (a byte a place)."""
    kept = docs.select(F.col(key).cast("bigint").alias("node"), text_column(text).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1).to_pylist(), width)
        signed = signatures(sets)
        bands, low = band_keys(signed).view(np.int64), signed.astype(np.uint8)
        full = [len(s) > 0 for s in sets]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if f else None for s, f in zip(sets, full)], pa.binary()),
                pa.array([b if f else None for b, f in zip(bands, full)], pa.list_(pa.int64())),
                pa.array([x.tobytes() if f else None for x, f in zip(low, full)], pa.binary()),
            ],
            ["node", "n_shingles", "fingerprint", "bands", "sketch"],
        )

    return map_arrow(kept, run, "node bigint, n_shingles bigint, fingerprint binary, bands array<bigint>, sketch binary")


def estimated(pairs: DataFrame, nodes: DataFrame, least: Column) -> DataFrame:
    """Pairs (``a, b`` and more) whose estimated similarity is not below ``least``."""
    names = pairs.columns
    sketches = nodes.select("node", "sketch")
    joined = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("__a")), "a")
    joined = joined.join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("__b")), "b")
    joined = joined.select(*pairs.columns, least.alias("__least"), "__a", "__b")
    schema = ", ".join(f"`{n}` {t}" for n, t in joined.dtypes[:-3])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PLACES) for c in ("__a", "__b"))
        likely = (a == b).mean(axis=1) >= batch.column("__least").to_numpy()
        return batch.select(names).filter(pa.array(likely))

    return map_arrow(joined, run, schema)


def element_sets(nodes: DataFrame, docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``node, elements`` (the full set as sorted 64-bit hashes) of the given nodes."""
    texts = docs.select(F.col(key).cast("bigint").alias("node"), F.col(text).alias("text"))
    # An inner join: Spark would push a semi join below the filter, and move all texts for it.
    wanted = nodes.select("node").distinct()
    texts = maybe_among(texts, wanted, "node").join(wanted, "node").select("node", text_column("text").alias("text"))

    def gather(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1).to_pylist(), width)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "elements"])

    return map_arrow(texts, gather, "node bigint, elements binary")


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Add ``shared`` and ``joint``, the sizes of intersection and union of the full sets of ``a`` and ``b``."""
    names = pairs.columns
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("__a")), "a")
    joined = joined.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("__b")), "b")
    joined = joined.select(*names, "__a", "__b")
    schema = ", ".join([*(f"`{n}` {t}" for n, t in joined.dtypes[:-2]), "shared bigint", "joint bigint"])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        shared, joint = [], []
        for x, y in zip(batch.column("__a").to_pylist(), batch.column("__b").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared.append(overlap(x, y))
            joint.append(len(x) + len(y) - shared[-1])
        columns = [*(batch.column(c) for c in names), pa.array(shared, pa.int64()), pa.array(joint, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [*names, "shared", "joint"])

    return map_arrow(joined, count, schema)


def member_links(wide: DataFrame, members: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between the groups of two centres ``a, b`` that are ``gap`` apart.

    A member of one group meets the members of the other in chunks, of which only those
    are compared that the triangle inequality and the estimate leave; the most similar
    first, and the first link ends the search, as the whole group is one component.
    """
    far = 1.0 - percent / 100.0
    sizes = members.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    full = sketches.join(sets, "node")
    hosts = members.join(wide.select(F.col("a").alias("centre")).distinct(), "centre").join(sizes, "centre")
    hosts = hosts.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).join(full, "node")
    hosts = hosts.select("centre", "chunk", "node", "apart", "sketch", "elements")
    near_enough = F.col("apart") >= F.col("gap") - far - F.col("p") - ROUNDING
    guests = wide.join(members.withColumnRenamed("centre", "b"), "b").where(near_enough)
    guests = guests.select(F.col("a").alias("centre"), "node", (F.col("gap") - F.col("apart")).alias("apart")).join(sizes, "centre")
    guests = guests.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).join(full, "node")
    guests = guests.select("centre", "chunk", "node", "apart", "sketch", "elements").toDF("g", "k", "node", "apart", "sketch", "elements")

    def unpacked(t: pa.Table):
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, PLACES)
        return t.column("node").to_numpy(), t.column("apart").to_numpy(), sketch, t.column("elements").to_pylist()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            nodes, apart, sketch, elements = unpacked(left)
            for node, rest, own, raw in zip(*unpacked(right)):
                near = np.flatnonzero(rest - apart <= far + ROUNDING)
                likely = (sketch[near] == own).mean(axis=1)
                near, likely = near[likely >= 1.0 - far - SLACK], likely[likely >= 1.0 - far - SLACK]
                x = np.frombuffer(raw, np.uint64)
                for at in near[np.argsort(-likely, kind="stable")].tolist():
                    y = np.frombuffer(elements[at], np.uint64)
                    shared = overlap(x, y)
                    if 100 * shared >= percent * (len(x) + len(y) - shared):
                        found.append((int(node), int(nodes[at])))
                        break
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return hosts.groupBy("centre", "chunk").cogroup(guests.groupBy("g", "k")).applyInArrow(meet, "a bigint, b bigint")


def likely_in_blocks(singles: DataFrame, percent: int) -> DataFrame:
    """``h, low, high, mine, node``: nodes of a bucket (``h, node, n_shingles, sketch``) with a likely partner in a block.

    A bucket is dealt to chunks of about CHUNK nodes; a block is a chunk, or two that meet. A node is a row of a
    block once, whatever the number of its partners there.
    """
    least = percent / 100.0 - SLACK
    sizes = singles.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    dealt = singles.join(sizes, "h").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = dealt.select("h", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "node", "n_shingles", "sketch")

    def meet(t: pa.Table) -> pa.Table:
        size, mine = (t.column(c).to_numpy() for c in ("n_shingles", "mine"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, PLACES)
        split = t.column("low")[0] != t.column("high")[0]
        met = np.zeros(t.num_rows, bool)
        for at in range(t.num_rows):
            rows = np.flatnonzero(100 * np.minimum(size[at + 1 :], size[at]) >= percent * np.maximum(size[at + 1 :], size[at])) + at + 1
            rows = rows[mine[rows] != mine[at]] if split else rows
            rows = rows[(sketch[rows] == sketch[at]).mean(axis=1) >= least] if len(rows) else rows
            met[rows] = True
            met[at] |= len(rows) > 0
        return t.select(["h", "low", "high", "mine", "node"]).filter(pa.array(met))

    return blocks.groupBy("h", "low", "high").applyInArrow(meet, "h bigint, low int, high int, mine int, node bigint")


def prefix_lists(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inverted lists over the elements of each set that a link must have one of: ``element, set, place``, sorted by
    element, and where each set's own entries stand.

    Elements are put in order of how many sets of the block hold them, rarest first. If the first common
    element stands at place i of a set of n, at most n - i are common; a link needs ``percent / (100 + percent)``
    of both sizes. So only places that leave that many to the smallest partner possible are listed.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, element, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((element, counts[element], owner))
    element = element[order]
    place = np.arange(len(element)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    partner = np.maximum(sizes.min(), -(-percent * sizes // 100))
    needed = -(-percent * (sizes + partner) // (100 + percent))
    listed = np.flatnonzero((place <= (sizes - needed)[owner]) & (counts[element] > 1))
    listed = listed[np.argsort(element[listed], kind="stable")]
    return element[listed], owner[listed], place[listed], sizes


def block_links(nodes: np.ndarray, sets: list[np.ndarray], mine: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links that join all linked sets of a block: every pair is ruled out by the bounds, compared in full or joined already.

    With ``mine`` only sets of different chunks are compared. At most one link fewer than sets is returned.
    """
    element, owner, place, sizes = prefix_lists(sets, percent)
    group = np.concatenate([[0], np.flatnonzero(np.diff(element)) + 1, [len(element)]])
    starts = np.repeat(group[:-1], np.diff(group))
    by_owner = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[by_owner], np.arange(len(sets) + 1))
    label, found = np.arange(len(sets)), []
    for x in range(len(sets)):
        entries = by_owner[first[x] : first[x + 1]]
        span = entries - starts[entries]  # the sets before x in each list
        if not span.sum():
            continue
        at = np.repeat(starts[entries] - (np.cumsum(span) - span), span) + np.arange(span.sum())
        other, size = owner[at], sizes[owner[at]]
        common = np.minimum(len(sets[x]) - np.repeat(place[entries], span), size - place[at])
        keep = (100 + percent) * common >= percent * (len(sets[x]) + size)
        if mine is not None:
            keep &= mine[other] != mine[x]
        other = np.unique(other[keep])
        other = other[label[other] != label[x]]
        if not len(other):
            continue
        together = np.concatenate([sets[y] for y in other])
        spot = np.minimum(np.searchsorted(sets[x], together), len(sets[x]) - 1)
        sums = np.concatenate([[0], np.cumsum(sets[x][spot] == together)])
        ends = np.cumsum(sizes[other])
        shared = sums[ends] - sums[ends - sizes[other]]
        for y in other[100 * shared >= percent * (sizes[other] + len(sets[x]) - shared)]:
            if label[y] != label[x]:
                found.append((int(nodes[x]), int(nodes[y])))
                label[label == label[y]] = label[x]
    return found


def single_links(singles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` that join the linked nodes of each bucket; full sets go only where a sketch makes a link likely."""
    likely = likely_in_blocks(singles, percent).join(sets, "node")

    def compare(t: pa.Table) -> pa.Table:
        elements = [np.frombuffer(x, np.uint64) for x in t.column("elements").to_pylist()]
        mine = t.column("mine").to_numpy() if t.column("low")[0] != t.column("high")[0] else None
        found = block_links(t.column("node").to_numpy(), elements, mine, percent)
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return likely.groupBy("h", "low", "high").applyInArrow(compare, "a bigint, b bigint")


def settled(edges: DataFrame) -> bool:
    """True if every node hangs below one other that hangs below none: the edges name the roots."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    )
    counted = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return not counted.where("hangs > 1 OR hangs = 1 AND holds = 1").take(1)


def components(links: DataFrame, label: str) -> DataFrame:
    """``node, root`` (the smallest node reachable) of every node in a link ``a, b``.

    Union-find over tables: edges point from the larger node to the smaller. A round hangs
    all neighbours of a node below the smallest of them, first the larger ones, then the
    smaller ones, until nothing moves. Only minima are gathered at a node, never its list.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, label)
    while not settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = larger.where("u <> v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        hung = edges.join(least, "u")
        smaller = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v")))
        edges = written(smaller.where("u <> v").distinct(), label)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def rooted(nodes: DataFrame, roots: DataFrame, column: str = "node", out: str = "root") -> DataFrame:
    """Add the root of ``column``; itself where it has none."""
    named = roots.select(F.col("node").alias(column), F.col("root").alias("__root"))
    return nodes.join(named, column, "left").withColumn(out, F.coalesce("__root", column)).drop("__root")


def near_links(nodes: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Links ``a, b`` that join every two representatives with similarity of ``percent`` or more that share a band."""
    far = 1.0 - percent / 100.0  # the largest distance of a link
    is_link = F.lit(100) * F.col("shared") >= F.lit(percent) * F.col("joint")
    distance = F.lit(1.0) - F.col("shared") / F.col("joint")
    banded = nodes.select("node", "n_shingles", F.explode("bands").alias("h"))
    buckets = banded.groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    placed = written(banded.join(buckets.select("h", "low"), "h"), "dedup-bands")
    # From here on only nodes that share a band matter.
    sketches = written(nodes.join(placed.select("node").distinct(), "node", "left_semi").select("node", "sketch"), "dedup-sketches")
    sets = written(element_sets(sketches, docs, key, text, width), "dedup-sets")

    # One comparison a node: with the smallest member of the buckets that it meets most often.
    met = placed.where("node <> low").groupBy("node", "low").agg(F.count(F.lit(1)).alias("times"))
    best = met.groupBy("node").agg(F.max(F.struct("times", (-F.col("low")).alias("low"))).alias("m"))
    first = best.select(F.col("node").alias("a"), (-F.col("m.low")).alias("b"))
    likely = estimated(first, sketches, F.lit(1.0 - far - SLACK))
    stars = written(compared(likely, sets).where(is_link).select("a", "b", distance.alias("apart")), "dedup-stars")
    roots = components(stars, "dedup-roots")

    # Buckets that hold more than one component.
    known = rooted(placed, roots).join(stars.select(F.col("a").alias("node"), F.col("b").alias("centre"), "apart"), "node", "left")
    known = known.withColumn("centre", F.coalesce("centre", "node")).withColumn("apart", F.coalesce("apart", F.lit(0.0)))
    open_buckets = known.groupBy("h").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("h")
    left = written(known.join(open_buckets, "h").select("h", "node", "n_shingles", "root", "centre", "apart"), "dedup-open")
    # A node stands alone if it is neither end of a star. Stars end at few centres, but each node is asked for itself.
    hubs = stars.select(F.col("b").alias("node")).distinct().withColumn("hub", F.lit(True))
    left = left.join(hubs, "node", "left").withColumn("alone", (F.col("node") == F.col("centre")) & F.col("hub").isNull()).drop("hub")
    groups = left.groupBy("h", "root", "centre", "alone").agg(
        F.max("apart").alias("radius"), F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most")
    )
    one, two = groups.alias("x"), groups.alias("y")
    in_reach = (F.lit(100) * F.col("x.most") >= F.lit(percent) * F.col("y.least")) & (F.lit(100) * F.col("y.most") >= F.lit(percent) * F.col("x.least"))
    grouped = ~(F.col("x.alone") & F.col("y.alone"))
    met = (
        one.join(two, (F.col("x.h") == F.col("y.h")) & (F.col("x.root") < F.col("y.root")) & in_reach & grouped)
        .select(F.col("x.centre").alias("a"), F.col("y.centre").alias("b"), F.col("x.radius").alias("p"), F.col("y.radius").alias("q"))
        .groupBy("a", "b")
        .agg(F.max("p").alias("p"), F.max("q").alias("q"))
    )
    singles = left.where("alone").select("h", "node", "n_shingles").join(sketches, "node")
    reach = F.lit(far) + F.col("p") + F.col("q")
    likely = estimated(met, sketches, F.lit(1.0 - SLACK) - reach)
    likely = written(likely, "dedup-centres")
    centres = written(compared(likely, sets).withColumn("apart", distance), "dedup-compared")
    linked = centres.where(is_link).select("a", "b")

    # Groups whose centres are too far apart for a link, yet near enough for one of their members.
    wide = centres.where(~is_link & (F.col("apart") <= reach + ROUNDING) & ((F.col("p") > 0) | (F.col("q") > 0)))
    # The centre with the wider group is the host.
    wide = wide.select(
        F.when(F.col("p") >= F.col("q"), F.col("a")).otherwise(F.col("b")).alias("a"),
        F.when(F.col("p") >= F.col("q"), F.col("b")).otherwise(F.col("a")).alias("b"),
        F.greatest("p", "q").alias("p"),
        F.col("apart").alias("gap"),
    )
    members = written(left.select("node", "centre", "apart").distinct(), "dedup-members")
    found = written(member_links(wide, members, sketches, sets, percent), "dedup-found")
    alone = written(single_links(singles, sets, percent), "dedup-singles")
    return reduce(DataFrame.unionByName, [stars.select("a", "b"), linked, found, alone])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``key, n_shingles, component_id, kept`` of every row of ``docs``."""
    signed = written(sign(docs, key, text, width), "dedup-signed")
    full = signed.where(F.col("node").isNotNull() & F.col("fingerprint").isNotNull())
    classes = written(full.groupBy("fingerprint").agg(F.min("node").alias("first")), "dedup-classes")
    chosen = full.join(classes, "fingerprint").where(F.col("node") == F.col("first"))
    # Rows equal in id and set are one node; so are rows that share an id only, each with its own bands.
    nodes = written(chosen.select("node", "n_shingles", "bands", "sketch", "fingerprint").dropDuplicates(["node", "fingerprint"]).drop("fingerprint"), "dedup-nodes")
    roots = components(near_links(nodes, docs, key, text, width, percent), "dedup-components")
    of_class = rooted(classes, roots, "first", "component")
    out = signed.select("node", "n_shingles", "fingerprint").join(of_class.select("fingerprint", "component"), "fingerprint", "left")
    component = F.coalesce("component", "node")
    return out.select(
        F.col("node").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("node") == component, F.lit(False)).alias("kept")
    )
