"""Quality rules: gradient-boosted trees over document statistics.

The statistics of whole texts are counted in Arrow functions. A boosted model is
trained here on a bounded sample of labelled rows, with monotonic constraints on
chosen features, and flattened into node arrays that score whole columns at once.

Defined results: a null or empty text has no words and all counts 0, so it fails the
base rule. Labels that are null are not used, of several labels of one document the
largest. Without both classes among the labels no model is trained and the base rule
decides alone. Rows are independent; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wavemill.llm.common import Numbered, map_arrow, process_cache, with_texts, written

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_COUNTS = ("n_lines", "n_upper", "n_distinct_words", "n_marks")
#: Features and the direction in which the score may move with them (0: either).
FEATURES = {
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "mark_share": -1,
    "distinct_share": 0,
    "mean_word": 0,
    "log_words": 0,
}
#: At most so many labelled documents train the model: the first in the order of a hash of the id.
SAMPLE = 8000
CACHED_WORDS = 250_000


class WordNumbers:
    """Numbers of the words seen so far, begun anew when there are more than CACHED_WORDS."""

    def __init__(self):
        self.numbers = Numbered()

    def current(self) -> Numbered:
        if len(self.numbers) > CACHED_WORDS:
            self.numbers = Numbered()
        return self.numbers


def text_counts(text: bytes) -> tuple[int, ...]:
    """COUNTS and MORE_COUNTS of one text. Words are runs of anything but the six ASCII white spaces."""
    words = text.split()
    if not words:
        return (0,) * (len(COUNTS) + len(MORE_COUNTS))
    raw = np.frombuffer(text, np.uint8)
    seen = np.bincount(raw, minlength=256)
    points = len(text) - int(seen[0x80:0xC0].sum())
    spaces = int(seen[0x20] + seen[0x09:0x0E].sum())
    symbols = int(seen[np.frombuffer(SYMBOLS, np.uint8)].sum())
    lines = [x for x in text.split(b"\n") if x.split()] if b"\n" in text else [text]
    numbers = process_cache("word-numbers", WordNumbers).current()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    return (
        len(words),
        points - spaces,
        symbols,
        len(lines) - len(set(lines)),
        repeated_words(ids, len(numbers)),
        len(lines),
        int(seen[0x41:0x5B].sum()),
        1 + int(np.count_nonzero(np.diff(np.sort(ids)))),
        int(seen[0x21:0x30].sum() + seen[0x3A:0x41].sum()),
    )


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(ids) < 3:
        return 0
    first, rest = ids[:-2], ids[1:-1] * distinct + ids[2:]
    if distinct >= 1 << 21:  # number the pairs anew, so that the product below stays within 64 bits
        rest = np.unique(rest, return_inverse=True)[1]
        distinct = len(ids)
    else:
        distinct *= distinct
    windows = first * distinct + rest
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = np.isin(windows, twice)
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : len(ids) - 2 + shift] |= again
    return int(covered.sum())


def features(counts: np.ndarray) -> np.ndarray:
    """Model features of rows of COUNTS and MORE_COUNTS."""
    c = dict(zip((*COUNTS, *MORE_COUNTS), np.asarray(counts, np.float64).T))
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.stack(
        [
            c["n_symbols"] / chars,
            c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
            c["n_repeat_words"] / words,
            c["n_upper"] / chars,
            c["n_marks"] / chars,
            c["n_distinct_words"] / words,
            chars / words,
            np.log1p(c["n_words"]),
        ],
        axis=1,
    )


@dataclass
class Trees:
    """Boosted trees as flat node arrays; a leaf has feature -1. ``roots``: first node of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row: all rows walk down a tree together."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            inner = self.feature[node] >= 0
            while inner.any():
                at = node[inner]
                goes_left = x[rows[inner], self.feature[at]] <= self.threshold[at]
                node[inner] = np.where(goes_left, self.left[at], self.right[at])
                inner = self.feature[node] >= 0
            total += self.value[node]
        return total


def train(
    x: np.ndarray, y: np.ndarray, direction: Sequence[int], rounds=60, depth=3, rate=0.2, bins=48, ridge=1.0,
    least=10,
) -> Trees:
    """Boost trees on logistic loss. A split that would move the score against a feature's direction is
    not taken, and children stay within bounds that their parents' splits set, so the sum is monotonic."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    nodes: list[list] = []
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    score = np.full(len(y), base)

    def weight(g, h, low, high):
        return np.clip(-g / (h + ridge), low, high)

    def gain(g, h, w):
        return -(g * w + 0.5 * (h + ridge) * w * w)

    def grow(rows, g, h, level, low, high) -> int:
        at = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        own = weight(total_g, total_h, low, high)
        nodes.append([-1, 0.0, -1, -1, rate * own])
        best = (1e-9, None)
        for f in range(x.shape[1]) if level else ():
            size = len(cuts[f]) + 1
            b = binned[rows, f]
            gl = np.cumsum(np.bincount(b, g[rows], size))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], size))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
            wl, wr = weight(gl, hl, low, high), weight(total_g - gl, total_h - hl, low, high)
            gained = gain(gl, hl, wl) + gain(total_g - gl, total_h - hl, wr) - gain(total_g, total_h, own)
            allowed = (nl >= least) & (len(rows) - nl >= least) & (direction[f] * (wr - wl) >= 0)
            gained = np.where(allowed, gained, -np.inf)
            if len(gained) and gained.max() > best[0]:
                c = int(gained.argmax())
                best = (gained[c], (f, c, wl[c], wr[c]))
        if best[1]:
            f, c, wl, wr = best[1]
            goes_left = binned[rows, f] <= c
            middle = (wl + wr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
            (l_low, l_high), (r_low, r_high) = bounds[direction[f]]
            left = grow(rows[goes_left], g, h, level - 1, l_low, l_high)
            right = grow(rows[~goes_left], g, h, level - 1, r_low, r_high)
            nodes[at] = [f, cuts[f][c], left, right, 0.0]
        return at

    roots = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        start = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth, -np.inf, np.inf))
        score += _flat(nodes, [start], 0.0).score(x)
    return _flat(nodes, roots, base)


def _flat(nodes: list[list], roots: list[int], base: float) -> Trees:
    """Node arrays of the trees from the first root on."""
    f, t, left, right, v = zip(*nodes[roots[0] :])
    shift = roots[0]
    return Trees(
        np.array(f), np.array(t, np.float64), np.array(left) - shift, np.array(right) - shift,
        np.array(v, np.float64), np.array(roots) - shift, base,
    )


def document_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, which may be a whole row with the text in it, and all counts of each text."""
    names = [*COUNTS, *MORE_COUNTS]
    kept, texts_of = with_texts(docs, [key], text)
    schema = StructType([kept.schema.fields[0], *(StructField(n, LongType()) for n in names)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([text_counts(t) for t in texts_of(batch)], np.int64).reshape(-1, len(names))
        columns = [pa.array(rows[:, n]) for n in range(len(names))]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, *names])

    return map_arrow(kept, run, schema)


def fit(counted: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Trees | None:
    """Trees from at most ``sample`` labelled documents; None if they are not of both classes."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max(label).cast("int").alias("__y"))
        .orderBy(F.xxhash64(F.col(key).cast("bigint")), key)
        .limit(sample)
    )
    names = [*COUNTS, *MORE_COUNTS]
    rows = np.array(
        [tuple(r) for r in counted.join(chosen, key).orderBy(key, *names).select("__y", *names).limit(sample).collect()],
        np.float64,
    )
    if not len(rows) or len(np.unique(rows[:, 0] > 0)) < 2:
        return None
    return train(features(rows[:, 1:]), (rows[:, 0] > 0).astype(np.float64), list(FEATURES.values()))


def judge(counted: DataFrame, trees: Trees | None, key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """Add ``base_failed``, ``score`` (probability; null without a model) and ``kept``."""
    names = [*COUNTS, *MORE_COUNTS]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = counted.select(key, *names, failed.alias("base_failed"))
    if trees is None:
        return base.withColumns({"score": F.lit(None).cast("double"), "kept": ~F.col("base_failed")})

    @F.arrow_udf("double")
    def probability(*columns: pa.Array) -> pa.Array:
        counts = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)
        return pa.array(1 / (1 + np.exp(-trees.score(features(counts)))))

    return base.withColumn("score", probability(*names)).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Counts, ``base_failed``, ``score`` and ``kept`` of every row of ``docs``."""
    counted = written(document_counts(docs, key, text), "text-counts")
    return judge(counted, fit(counted, labels, key, label), key)
