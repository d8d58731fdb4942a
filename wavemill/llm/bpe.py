"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A text is cut into pieces by character classes; each distinct piece is merged on its
own, and parts of texts seen before are taken from a bounded cache. Arrow cuts the texts
and numbers the distinct parts of a batch, so only those become Python objects. The leaves of a piece's tree hold ``rank * width + position`` of the pair that
starts at a symbol, inner nodes the smaller child, so the root is the leftmost pair of
lowest rank. A merge changes at most three leaves and the paths above them. Pieces of
similar length share one array of trees, a node's values of all pieces side by side, so a
step merges all of them at once; a piece leaves when its root names no pair.

Defined results: a null or empty text has no ids and decodes to the empty text. The
special strings of the tokenizer file are matched first and give their own id. Rows
are independent, so ties, repeated rows and empty tables need no rule; other columns
of the input are ignored unless carried.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import Numbered, map_arrow, process_cache, text_column

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The suffixes the piece rule cuts off after an apostrophe, in its order.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
#: White space beyond ASCII, or what begins like it; a blank beside any or at an end needs care.
ODD_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
ODD_BLANK = (b"  ", *(p for w in b"\t\n\v\f\r" for p in (bytes([w, 0x20]), bytes([0x20, w]))))
SAFE_BLANK = re.compile(rb"(?<=[!-~])\x20(?=[!-~])")
NO_PAIR = (1 << 31) - 1
CACHED_PARTS = 200_000
TREE_CELLS = 1 << 17
#: Texts are encoded in batches of so many bytes: what a batch needs for a while lies beside the cache in each worker.
BATCH_BYTES = 2 << 20


def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    kinds = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        first = unicodedata.category(chr(point))[0]
        if first in "LN":
            kinds[point] = LETTER if first == "L" else NUMBER
        elif first == "Z":
            kinds[point] = SPACE
    kinds[[*range(0x09, 0x0E), 0x85]] = SPACE
    return kinds


def byte_letters() -> dict[str, int]:
    """The printable character that vocabulary files write for each byte, with the byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def piece_ends(points: np.ndarray, kinds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ends of the pieces of texts given as code points in a row; a text begins at each of ``starts``.

    Runs of one class form a piece, a single blank joins the run after it. Of a white
    space run before other text the last character stands alone (or joins, if a blank).
    An apostrophe that opens a piece takes a suffix of SUFFIXES with it.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds[points]
    fresh = np.zeros(n + 1, bool)  # where a text begins
    fresh[starts] = fresh[n] = True
    begins = fresh.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~fresh[1:n])  # the last white space before text
    begins[last] = True
    blank = last[points[last] == 0x20]
    begins[blank + 1] = False
    for at in np.flatnonzero((points == 0x27) & begins[:n]).tolist():
        tail = ""
        for place in range(at + 1, at + 3):
            if fresh[place]:
                break
            tail += chr(points[place])
        for suffix in SUFFIXES:
            if tail.startswith(suffix):
                end = at + 1 + len(suffix)
                begins[at + 1 : end] = False
                begins[end] = True
                break
    return np.flatnonzero(begins[1:]) + 1


def odd_marks(texts: Sequence[bytes]) -> list[list[bytes]]:
    """Those of ODD_BLANK and of ODD_SPACE that the texts hold."""
    together = b"|".join(texts)
    seen = {b: b in together for b in {p[k : k + 1] for p in (*ODD_BLANK, *ODD_SPACE) for k in (0, len(p) - 1)}}
    return [[p for p in some if seen[p[:1]] and seen[p[-1:]] and p in together] for some in (ODD_BLANK, ODD_SPACE)]


def has_odd_blank(text: bytes, odd_blank: Sequence[bytes], odd_space: Sequence[bytes]) -> bool:
    """Whether a blank of the text may stand beside other white space or at an end."""
    odd = text.startswith(b" ") or text.endswith(b" ") or any(map(text.__contains__, odd_blank))
    return odd or not text.isascii() and any(map(text.__contains__, odd_space))


def parts_of(text: bytes, odd_blank: Sequence[bytes], odd_space: Sequence[bytes]) -> list[bytes]:
    """A text cut before single blanks between two characters that are no white space.

    Such a blank always opens a piece, so parts can be encoded on their own. The first
    part is marked by a blank before it, all others have lost the blank they begin with.
    ``odd_blank`` and ``odd_space``: those of ODD_BLANK and ODD_SPACE to look for.
    """
    parts = SAFE_BLANK.split(text) if has_odd_blank(text, odd_blank, odd_space) else text.split(b" ")
    parts[0] = b" " + parts[0]
    return parts


class Vocabulary:
    """Ids, merge ranks and the special strings of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.kinds = character_classes()
        self.first = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.first[byte] = ids[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.pairs = PairTable(left << 32 | right)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        by_length = sorted(self.special, key=len, reverse=True)
        self.special_rule = re.compile(b"(" + b"|".join(map(re.escape, by_length)) + b")") if by_length else None
        size = 1 + max([*ids.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token
        self.byte_size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.byte_start = np.cumsum(self.byte_size) - self.byte_size
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.parts = PartCache()

    @staticmethod
    def of(path: str) -> Vocabulary:
        return process_cache(f"vocabulary:{path}", lambda: Vocabulary(path))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, NO_PAIR where there is none."""
        return self.pairs.of(left << 32 | right)

    def merge(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in one array, and where each piece's ids start and how many there are."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return self._merge_cut(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes)

    def _merge_cut(self, raw: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``merge`` of the pieces of so many bytes that begin there in ``raw``."""
        start = np.zeros(len(sizes), np.int64)
        size = np.zeros(len(sizes), np.int64)
        flat, held = [], 0
        widths = 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64)
        for width in np.unique(widths).tolist():
            members = np.flatnonzero(widths == width)
            step = max(1, TREE_CELLS // width)
            for at in range(0, len(members), step):
                some = members[at : at + step]
                ids, count = self._merge_alike(gathered(raw, begin[some], sizes[some])[0], sizes[some], width)
                start[some] = held + np.cumsum(count) - count
                size[some] = count
                flat.append(ids)
                held += len(ids)
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), start, size

    def _merge_alike(self, raw: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge pieces (one after the other in ``raw``) of at most ``width`` bytes, a power of two, in step; their ids
        in a row and counts."""
        count, levels = len(sizes), width.bit_length() - 1
        # Leaves of wide trees hold more than 31 bits.
        kind, none = (np.int32, NO_PAIR) if width <= 1 << 14 else (np.int64, 1 << 62)
        # The place of position p of piece i is p * count + i, in these and in the trees' rows of nodes.
        piece = np.repeat(np.arange(count), sizes)
        position = np.arange(len(piece)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first = self.first[raw]
        symbol = np.full(width * count, -1, np.int64)
        symbol[position * count + piece] = first
        after = np.repeat(np.arange(1, width + 1, dtype=np.int32), count)  # next living symbol
        before = np.repeat(np.arange(-1, width - 1, dtype=np.int32), count)
        tree = np.full((2 * width, count), none, kind)
        nodes = tree.reshape(-1)

        def leaves(pairs: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(pairs == NO_PAIR, none, pairs * width + at)

        def fill_up() -> None:
            for level in range(levels - 1, -1, -1):
                children = tree[2 << level : 4 << level].reshape(1 << level, 2, count)
                np.minimum(children[:, 0], children[:, 1], out=tree[1 << level : 2 << level])

        opens = np.flatnonzero(position[1:])  # symbols with a follower
        at = position[opens]
        nodes[(width + at) * count + piece[opens]] = leaves(self.ranks(first[opens], first[opens + 1]), at)
        fill_up()
        alive = np.flatnonzero(tree[1] != none)
        while len(alive):
            root = tree[1, alive].astype(np.int64)
            at, rank = root % width, root // width
            here = at * count + alive
            gone = after[here]
            hole = gone.astype(np.int64) * count + alive
            follower = after[hole]
            made = self.merged[rank]
            symbol[here] = made
            symbol[hole] = -1
            after[here] = follower
            has_next = np.flatnonzero(follower < sizes[alive])
            beyond = follower[has_next].astype(np.int64) * count + alive[has_next]
            before[beyond] = at[has_next]
            changed = np.full((3, len(alive)), none, kind)  # the leaves of the one gone, the merged and the one before
            changed[1, has_next] = leaves(self.ranks(made[has_next], symbol[beyond]), at[has_next])
            previous = before[here].astype(np.int64)
            some = np.flatnonzero(previous >= 0)
            behind = previous[some] * count + alive[some]
            changed[2, some] = leaves(self.ranks(symbol[behind], made[some]), previous[some])
            nodes[width * count + hole] = changed[0]
            nodes[width * count + here] = changed[1]
            nodes[width * count + behind] = changed[2, some]
            if 16 * levels * len(alive) >= width * count:  # many paths: all inner nodes at once
                fill_up()
            else:
                node = np.concatenate([gone, at, previous[some]]) + width
                who = np.concatenate([alive, alive, alive[some]])
                for _ in range(levels):
                    node >>= 1
                    left = 2 * node * count + who
                    nodes[node * count + who] = np.minimum(nodes[left], nodes[left + count])
            alive = alive[tree[1, alive] != none]
        # Back to one piece after the other.
        held = symbol.reshape(width, count).T
        living = held >= 0
        return held[living].astype(np.uint32), living.sum(axis=1)

    def encode_batch(self, texts: Sequence[bytes]) -> list[np.ndarray]:
        """Ids (unsigned 32-bit) of each text."""
        plain: list[bytes] = []  # stretches without special strings
        layout: list[list[int]] = []  # per text: index into plain, or -1 - id
        for text in texts:
            if self.special_rule is not None and any(s in text for s in self.special):
                parts = self.special_rule.split(text)
                row = []
                for part in parts:
                    if part in self.special:
                        row.append(-1 - self.special[part])
                    elif part:
                        row.append(len(plain))
                        plain.append(part)
                layout.append(row)
            else:
                layout.append([len(plain)] if text else [])
                plain.extend([text] if text else [])
        done = self._encode_plain(plain)
        empty = np.zeros(0, np.uint32)
        out = []
        for row in layout:
            parts = [done[i] if i >= 0 else np.array([-1 - i], np.uint32) for i in row]
            out.append(parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else empty)
        return out

    def _encode_plain(self, texts: list[bytes]) -> list[np.ndarray]:
        if not texts:
            return []
        cache = self.parts
        cache.trim()
        odd = odd_marks(texts)
        # Of most texts only the first part is cut here, and what follows by Arrow; others are cut whole.
        rests, holders, heads, head_counts = [], [], [], []
        for at, text in enumerate(texts):
            if has_odd_blank(text, *odd):
                parts = parts_of(text, *odd)
            else:
                head, blank, rest = text.partition(b" ")
                parts = [b" " + head]
                if blank:
                    rests.append(rest)
                    holders.append(at)
            heads += parts
            head_counts.append(len(parts))
        distinct, numbers, sizes = cut_at_blanks(rests)
        slots = cache.numbered(distinct)[numbers]
        head_slots = cache.numbered(heads)
        cache.fill(self)
        # The parts of a text: those cut here, then the rest's.
        counts = np.zeros((len(texts), 2), np.int64)
        counts[:, 0] = head_counts
        counts[holders, 1] = sizes
        from_rest = np.repeat(np.tile([False, True], len(texts)), counts.reshape(-1))
        slot = np.empty(len(from_rest), np.int64)
        slot[from_rest] = slots
        slot[~from_rest] = head_slots
        cache.meet(slot)
        flat, ends = gathered(cache.ids, cache.start[slot], cache.size[slot])
        return np.split(flat, ends[np.cumsum(counts.sum(axis=1))[:-1] - 1])

    def encode_parts(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special strings in a row, and how many each has; a distinct piece is merged once."""
        return self._encode_cut([t.encode() for t in texts])

    def _encode_cut(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``encode_parts`` of texts in UTF-8; what is not becomes replacement characters."""
        whole = b"".join(texts)
        upto = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        begin = np.concatenate([np.zeros(1, np.int64), upto[:-1]])
        raw = np.frombuffer(whole, np.uint8)
        begin = begin[begin < len(raw)]
        opens = np.flatnonzero(raw & 0xC0 != 0x80)  # where a character begins
        try:
            if (raw[begin] & 0xC0 == 0x80).any():
                raise ValueError("a text begins inside a character")
            points = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
        except ValueError:  # UnicodeDecodeError is one
            return self._encode_cut([t.decode("utf-8", "replace").encode() for t in texts])
        ends = piece_ends(points, self.kinds, np.searchsorted(opens, begin))
        cuts = np.concatenate([np.zeros(1, np.int64), np.append(opens, len(raw))[ends]])
        pieces = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(cuts), pa.py_buffer(whole)])
        coded = pieces.dictionary_encode()
        piece = coded.indices.to_numpy()
        bounds = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1]
        held = np.frombuffer(coded.dictionary.buffers()[2] or b"", np.uint8)
        ids, start, size = self._merge_cut(held, bounds[:-1], np.diff(bounds))
        flat, done = gathered(ids, start[piece], size[piece])
        tokens = np.concatenate([[0], done])[np.searchsorted(cuts[1:], upto, side="right")]  # up to the end of each part
        return flat, np.diff(tokens, prepend=0)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, as UTF-8 text; what is not UTF-8 becomes replacement characters."""
        raw = gathered(self.all_bytes, self.byte_start[ids], self.byte_size[ids])[0].tobytes()
        return raw.decode("utf-8", "replace").encode()


def gathered(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``ids`` at ``start`` one after the other, and where each ends."""
    ends = np.cumsum(size)
    shift = np.repeat(start - (ends - size), size)
    return ids[np.arange(len(shift)) + shift], ends


def cut_at_blanks(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct parts of texts cut at every blank, the number of each part in a row, and how many each text has."""
    cut = pc.split_pattern(pa.array(texts, pa.binary()), pattern=b" ")
    coded = cut.flatten().dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    return distinct, coded.indices.to_numpy(), np.diff(cut.offsets.to_numpy())


class PairTable:
    """Numbers of distinct keys by open addressing: a key lies at its hash or, without a gap, behind it."""

    EMPTY, STEP = -1, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, self.EMPTY, np.int64)
        self.numbers = np.full(1 << bits, NO_PAIR, np.int64)
        rest = np.arange(len(keys))
        place = self._home(keys)
        while len(rest):
            free = self.keys[place] == self.EMPTY
            self.keys[place[free]] = keys[rest[free]]
            mine = self.keys[place] == keys[rest]
            self.numbers[place[mine]] = rest[mine]
            rest, place = rest[~mine], (place[~mine] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.STEP) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, NO_PAIR where there is none."""
        out = np.full(len(keys), NO_PAIR)
        rest, place = np.arange(len(keys)), self._home(keys)
        while len(rest):
            held = self.keys[place]
            mine = held == keys[rest]
            out[rest[mine]] = self.numbers[place[mine]]
            on = ~mine & (held != self.EMPTY)
            rest, place = rest[on], (place[on] + 1) & self.mask
        return out


class PartCache:
    """Ids of the parts seen so far. When it holds more than CACHED_PARTS, those met once are forgotten, and if
    that leaves more than half, all."""

    def __init__(self):
        self.reset()

    def reset(self):
        self.slot = Numbered()
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.met = np.zeros(0, np.int64)

    def trim(self):
        if len(self.slot) <= CACHED_PARTS:
            return
        again = np.flatnonzero(self.met > 1)
        if 2 * len(again) > CACHED_PARTS:
            return self.reset()
        parts = list(self.slot)
        ids, ends = gathered(self.ids, self.start[again], self.size[again])
        size = self.size[again]
        self.reset()
        self.numbered([parts[i] for i in again.tolist()])
        self.start, self.size, self.ids = ends - size, size, ids
        self.met = np.zeros(len(again), np.int64)

    def numbered(self, parts: list[bytes]) -> np.ndarray:
        """The slot of each part."""
        return np.fromiter(map(self.slot.__getitem__, parts), np.int64, len(parts))

    def meet(self, slots: np.ndarray):
        """Count how often parts are met."""
        self.met = np.bincount(slots, minlength=len(self.slot)) + np.pad(self.met, (0, len(self.slot) - len(self.met)))

    def fill(self, vocabulary: Vocabulary):
        """Encode the parts that were numbered since the last call."""
        fresh = [p[1:] if p.startswith(b" ") else b" " + p for p in self.slot.newest(len(self.size))]
        if not fresh:
            return
        flat, size = vocabulary._encode_cut(fresh)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, flat])


def encode(docs: DataFrame, path: str, text: str = "text", carry: Sequence[str] = (), width: str = "<u4") -> DataFrame:
    """Carried columns, ``n_tokens`` and ``ids`` (BINARY, integers of numpy type ``width``) of each text."""
    kept = docs.select(*carry, text_column(text).alias("__text"))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.dtypes[:-1]), "n_tokens bigint", "ids binary"])
    names = [*carry, "n_tokens", "ids"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = Vocabulary.of(path).encode_batch(batch.column(len(carry)).to_pylist())
        n = pa.array([len(i) for i in ids], pa.int64())
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], n, pa.array([i.astype(width).tobytes() for i in ids], pa.binary())], names
        )

    return map_arrow(kept, run, schema, BATCH_BYTES)


def decode(encoded: DataFrame, path: str, ids: str = "ids", carry: Sequence[str] = ()) -> DataFrame:
    """Carried columns and the ``text`` of each row's ids; null ids give the empty text."""
    kept = encoded.select(*carry, F.coalesce(F.col(ids), F.lit(b"")).alias("__ids"))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.dtypes[:-1]), "text string"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary = Vocabulary.of(path)
        texts = [vocabulary.decode(np.frombuffer(x, "<u4")).decode() for x in batch.column(len(carry)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*carry, "text"])

    return map_arrow(kept, run, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text", carry: Sequence[str] = ("doc_id",), ids: bool = False) -> DataFrame:
    """Encode, decode and digest in one pass: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, ``same_text``;
    with ``ids`` also the ids (BINARY, ``<u4``)."""
    kept = docs.select(*carry, text_column(text).alias("__text"))
    added = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "same_text": "boolean"}
    if ids:
        added["ids"] = "binary"
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.dtypes[:-1]), *(f"{n} {t}" for n, t in added.items())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary = Vocabulary.of(path)
        texts = batch.column(len(carry)).to_pylist()
        encoded = vocabulary.encode_batch(texts)
        decoded = [vocabulary.decode(i) for i in encoded]
        raw = [i.astype("<u4").tobytes() for i in encoded]
        columns = [
            pa.array([len(i) for i in encoded], pa.int64()),
            pa.array([hashlib.sha256(i).hexdigest() for i in raw], pa.string()),
            pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
            pa.array([a == b for a, b in zip(texts, decoded)], pa.bool_()),
        ]
        if ids:
            columns.append(pa.array(raw, pa.binary()))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*carry, *added])

    return map_arrow(kept, run, schema, BATCH_BYTES)
