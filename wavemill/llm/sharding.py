"""Sharding by a hierarchical weighted hash tree.

A key descends from the root over regions and racks to a shard. At each node every
child draws ``-ln(u) / weight`` with u hashed from the key and the child's name, and
the smallest draw wins, so a child is taken in proportion to its weight. A draw
depends on nothing but key, child and weight: where a child's weight changes, keys
move to or from that child only, and other subtrees keep what they have. A new shard
joins as a region of its own: no other weight changes, so it only receives keys.

Defined results: a null key is placed like the key 0 under another seed; equal keys
meet in one shard; an empty table gives no rows. Other columns are carried along, the
added names replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators.ranking import rank_in_group
from wavemill.functions.numeric import integer_levels

#: Fixed values of the 64-bit finaliser and its increment.
STEP, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
NULL_KEY = 0x5851F42D4C957F2D


@dataclass(frozen=True)
class Node:
    """A subtree: a shard number at a leaf, children elsewhere."""

    name: int
    weight: float = 0.0
    shard: int = -1
    children: tuple[Node, ...] = field(default=())

    @property
    def total(self) -> float:
        return self.weight if self.shard >= 0 else sum(c.total for c in self.children)


def balanced_tree(shards: int, racks: int = 3, per_rack: int = 4) -> Node:
    """Equal weights: ``per_rack`` shards in a rack, ``racks`` racks in a region."""
    leaves = [Node(s, 1.0, s) for s in range(shards)]
    sides = [Node(n, children=tuple(leaves[at : at + per_rack])) for n, at in enumerate(range(0, shards, per_rack))]
    regions = [Node(n, children=tuple(sides[at : at + racks])) for n, at in enumerate(range(0, len(sides), racks))]
    return Node(0, children=tuple(regions))


def grown(root: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, alone in a rack and region of its own."""
    shard = 1 + max(leaf.shard for leaf in _leaves(root))
    name = 1 + max(c.name for c in root.children)
    region = Node(name, children=(Node(0, children=(Node(0, weight, shard),)),))
    return Node(root.name, children=(*root.children, region))


def _leaves(node: Node) -> Iterator[Node]:
    if node.shard >= 0:
        yield node
    for child in node.children:
        yield from _leaves(child)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def place(keys: np.ndarray, root: Node, seed: int = 0) -> np.ndarray:
    """Shard of each 64-bit key."""
    out = np.zeros(len(keys), np.int32)
    start = (seed * STEP + 1) % (1 << 64)
    stack = [(root, np.arange(len(keys)), start)]
    while stack:
        node, rows, path = stack.pop()
        if node.shard >= 0:
            out[rows] = node.shard
            continue
        best = np.full(len(rows), np.inf)
        chosen = np.zeros(len(rows), np.int64)
        paths = [(path * MIX_A + (child.name + 1) * STEP) % (1 << 64) for child in node.children]
        for at, child in enumerate(node.children):
            if child.total > 0:
                bits = mixed(mixed(keys[rows] + np.uint64(paths[at])) ^ np.uint64(paths[at]))
                u = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
                draw = -np.log(u) / child.total
                better = draw < best
                best[better], chosen[better] = draw[better], at
        stack += [(child, rows[chosen == at], paths[at]) for at, child in enumerate(node.children)]
    return out


def shard_rows(df: DataFrame, key: str, trees: dict[str, Node], seed: int = 0) -> DataFrame:
    """Add one shard column for each named tree."""
    kept = df.select(*[c for c in df.columns if c not in trees])
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.dtypes), *(f"{n} int" for n in trees)])
    at = kept.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at).cast(pa.int64())
            keys = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            keys[column.is_null().to_numpy(zero_copy_only=False)] = np.uint64(NULL_KEY)
            placed = [pa.array(place(keys, tree, seed), pa.int32()) for tree in trees.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *placed], [*batch.schema.names, *trees])

    return kept.mapInArrow(run, schema)


def number_slots(df: DataFrame, shard: str, order: Sequence[str], out: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, by an integer key first (``order[0]``).

    Ranked inside buckets of 2**14 key values whose counts are summed level by level,
    so no shard is held by one task. Rows equal in all of ``order`` are interchangeable.
    """
    levels = integer_levels(F.col(order[0]), (40, 27, 14))
    return rank_in_group(df, [shard], levels, list(order), out)
