"""Token counts of whole texts: the tokenizers library in Arrow functions that return lengths only.

The tokenizer drops white space and encodes what stands between on its own, so every
run of ASCII white space is a safe boundary: counts of the parts add up. Texts, long
ones above all, are cut there, and a part seen before is not encoded again. New parts
go to the library in batches of BATCH_BYTES, whatever their number.

Defined results: a null or empty text has no tokens. Special strings inside a text
count as the library counts them (they hold no white space, so no cut meets them).
Rows are independent; other columns are ignored unless carried.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import Numbered, map_arrow, process_cache, text_column

BATCH_BYTES = 256 << 10
CACHED_PARTS = 800_000


class PartCounter:
    """Counts of the parts seen so far, emptied when it holds more than CACHED_PARTS."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # Added tokens are matched before the library lower-cases: another spelling must not become one.
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lowers = '"Lowercase"' in self.tokenizer.to_str()[:20_000]
        self.reset()

    def reset(self):
        self.slot = Numbered()
        self.counts = np.zeros(0, np.int64)

    def totals(self, texts: Sequence[bytes]) -> np.ndarray:
        if len(self.slot) > CACHED_PARTS:
            self.reset()
        slots, lengths = [], np.zeros(len(texts), np.int64)
        for at, text in enumerate(texts):
            # ASCII texts can be lower-cased before the library does it; composed characters and what may be an added token can not.
            lowered = text.lower() if self.lowers and text.isascii() else text
            parts = (text if any(s in lowered for s in self.special) else lowered).split()
            lengths[at] = len(parts)
            slots.append(np.fromiter(map(self.slot.__getitem__, parts), np.int64, len(parts)))
        self._count_new()
        if not slots:
            return lengths
        sums = np.concatenate([[0], np.cumsum(self.counts[np.concatenate(slots)])])
        ends = np.cumsum(lengths)
        return sums[ends] - sums[ends - lengths]

    def _count_new(self):
        fresh = self.slot.newest(len(self.counts))
        counts, batch, held = [], [], 0
        for part in fresh:
            batch.append(part.decode("utf-8", "replace"))
            held += len(part)
            if held >= BATCH_BYTES:
                counts += self._lengths(batch)
                batch, held = [], 0
        counts += self._lengths(batch)
        self.counts = np.concatenate([self.counts, np.array(counts, np.int64)])

    def _lengths(self, batch: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]


def token_counts(
    docs: DataFrame, path: str, text: str = "text", carry: Sequence[str] = ("doc_id",), limit: int = 2048
) -> DataFrame:
    """Carried columns, ``n_bytes``, ``n_tokens`` and ``over_limit`` of each row."""
    kept = docs.select(*carry, text_column(text).alias("__text"))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.dtypes[:-1]), "n_bytes bigint", "n_tokens bigint"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(len(carry)).to_pylist()
        counter = process_cache(f"parts:{path}", lambda: PartCounter(path))
        columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array(counter.totals(texts), pa.int64())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*carry, "n_bytes", "n_tokens"])

    return map_arrow(kept, run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
