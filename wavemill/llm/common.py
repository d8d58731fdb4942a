"""Shared pieces: word rule, Arrow passes over text, caches that outlive a task, scratch tables."""

from __future__ import annotations

import sys
import types
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wavemill.session import scratch_path

#: Words are runs of anything but these; ``bytes.split()`` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 4 << 20


def text_column(name: str = "text") -> Column:
    """The text as bytes, null as empty: Arrow hands it over without decoding."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def map_arrow(df: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, limit: int = CHUNK_BYTES) -> DataFrame:
    """``run`` on pieces of the batches of at most ``limit`` bytes (or one row)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in by_bytes(batch, limit):
                yield run(piece)

    return df.mapInArrow(each, schema)


def with_texts(docs: DataFrame, carry: Sequence[str], text: str) -> tuple[DataFrame, Callable[[pa.RecordBatch], list[bytes]]]:
    """The carried columns, and how a batch of them gives its texts. A text ``row.name`` in a carried struct ``row``
    is taken from there and not sent beside it."""
    outer, _, inner = text.partition(".")
    if inner and outer in carry:
        at = list(carry).index(outer)
        return docs.select(*carry), lambda batch: [x or b"" for x in batch.column(at).field(inner).cast(pa.binary()).to_pylist()]
    return docs.select(*carry, text_column(text).alias("__text")), lambda batch: batch.column(len(carry)).to_pylist()


def leaves(column: pa.Array) -> list[pa.Array]:
    """The column, or those inside it."""
    if not pa.types.is_struct(column.type):
        return [column]
    return [leaf for k in range(column.type.num_fields) for leaf in leaves(column.field(k))]


def by_bytes(batch: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows that hold ``limit`` bytes at most, or a single row."""
    rows = batch.num_rows
    weight = np.zeros(rows, np.int64)
    for column in (leaf for c in batch.columns for leaf in leaves(c)):
        if pa.types.is_binary(column.type) or pa.types.is_string(column.type):
            weight += np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + rows + 1])
    start, held = 0, 0
    for at, size in enumerate(weight.tolist()):
        if held and held + size > limit:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < rows:
        yield batch.slice(start)


class Numbered(defaultdict):
    """Numbers keys from 0 in the order of first sight."""

    def __init__(self):
        super().__init__(count().__next__)

    def newest(self, known: int) -> list:
        """The keys numbered ``known`` and above, in order."""
        return list(islice(reversed(self), len(self) - known))[::-1]


def process_cache(name: str, make: Callable[[], object]) -> object:
    """An object made once per worker process, until another is asked for: workers outlive stages, and what one stage
    keeps must not lie beside what the next needs. Task code travels by value, so its globals end with the task."""
    home = sys.modules.setdefault("wavemill_worker_cache", types.ModuleType("wavemill_worker_cache"))
    if getattr(home, "name", None) != name:
        home.name = home.value = None
        value = make()  # may ask for another on its way
        home.name, home.value = name, value
    return home.value


_recording: list[str] | None = None


@contextmanager
def recording(paths: list[str]) -> Iterator[None]:
    """Note the folders of all tables written inside the block in ``paths``."""
    global _recording
    before, _recording = _recording, paths
    try:
        yield
    finally:
        _recording = before


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more, and empty the list."""
    jvm = spark.sparkContext._jvm
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Spark deletes the shuffle files of a query when it has ended, and not when the driver's heap is next cleaned.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Queries that begin inside the block delete their shuffle files at their end."""
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_END) if before is None else spark.conf.set(SHUFFLES_END, before)


#: Rows that Spark sends to a Python worker at once. Ten thousand texts take tens of MB, in the executor and the worker.
BATCH_ROWS, MOST_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def small_batches(spark: SparkSession) -> str | None:
    """Let queries planned from now on send at most MOST_ROWS rows at once; what was set before, None if nothing was."""
    before = spark.conf.get(BATCH_ROWS, None)
    if before is None or not 0 < int(before) <= MOST_ROWS:
        spark.conf.set(BATCH_ROWS, str(MOST_ROWS))
    return before


@contextmanager
def batches_small(spark: SparkSession) -> Iterator[None]:
    """``small_batches`` inside the block only."""
    before = small_batches(spark)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_ROWS) if before is None else spark.conf.set(BATCH_ROWS, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut, whole after lost executors. What was
    shuffled to make it is deleted."""
    path = scratch_path(df.sparkSession, label)
    if _recording is not None:
        _recording.append(path)
    with shuffles_end(df.sparkSession), batches_small(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key filter has this many bits a key at least, up to MOST_BITS in all: 2^20 rows of 64 bits.
KEY_BITS, MOST_BITS = 16, 1 << 26


def maybe_among(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not in ``keys``; none that is in them is left out.

    The keys are broadcast as bits of their hashes, a table of bounded size, so that rows which match nothing are
    not moved for the join that follows.
    """
    bits = 1 << 16
    while bits < min(MOST_BITS, KEY_BITS * keys.count()):
        bits *= 2
    place, word, held = fresh_names(rows, "place", "word", "held")
    placed = F.pmod(F.xxhash64(column), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col(place) % 64).cast("int"))
    words = keys.select(placed.alias(place)).groupBy(F.shiftright(place, 6).alias(word)).agg(F.bit_or(one).alias(held))
    met = rows.withColumn(place, placed).withColumn(word, F.shiftright(place, 6)).join(F.broadcast(words), word)
    return met.where(F.getbit(held, (F.col(place) % 64).cast("int")) == 1).select(*rows.columns)
