"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet per language: the text (byte trigrams, naive Bayes), the
language the markup declares, the suffix of the address, and a prior of the host. The
prior is smoothed from level to level (all pages, domain, host), and every table but
the trigrams is a grouped aggregation over all rows, weighted by what the text says.

Defined results: a null or empty text, or one without letters, has no language and is
not kept. Evidence that is missing (null or empty) counts nothing; evidence seen with no
text is neutral. Equal posteriors: the language first in code point order. Without a
labelled row there are no languages and nothing is kept. Rows are independent but for
the shared tables; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from wavemill.llm.common import map_arrow, text_column, with_texts, written
from wavemill.operators.ranking import join_null_safe

TRIGRAM_BITS = 16
#: At most so many labelled texts of a language train the trigrams: its first distinct ones in the order of a hash.
SAMPLE = 4000
#: Trigrams after which a text's evidence no longer grows: neighbouring trigrams are not independent.
TEMPER = 200.0
#: Rows that a level's prior weighs as much as the level above.
STRENGTH = 10.0


def trigrams(text: bytes) -> np.ndarray:
    """Numbers below 2**TRIGRAM_BITS of the text's byte trigrams, A-Z lower-cased, other ASCII as blanks."""
    raw = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    raw = np.where(((raw >= 0x61) & (raw <= 0x7A)) | (raw >= 0x80), raw, np.uint32(0x20))
    mixed = ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)) >> np.uint32(32 - TRIGRAM_BITS)
    return mixed[raw[1:-1] != 0x20]


def smallest_hashes(hashed: DataFrame, sample: int) -> dict[str, int]:
    """The ``sample``-th smallest distinct ``h`` (uniform, 64 bits) of each ``lang``, the largest where there are fewer.

    A bound that leaves a little more than ``sample`` follows from the number of hashes, so
    that no language's hashes meet in one task but those.
    """
    distinct = written(hashed.distinct(), "language-hashes")
    sizes = {r["lang"]: r["n"] for r in distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number a language
    if not sizes:
        return {}
    room = sample + 8 * sample**0.5 + 32
    loose = {lang: (1 << 63) - 1 if n <= room else int((1 << 64) * room / n) - (1 << 63) for lang, n in sizes.items()}
    near = distinct.where(F.col("h") <= of_language(loose)).groupBy("lang").agg(F.sort_array(F.collect_list("h")).alias("h"))
    last = near.select("lang", F.get("h", F.least(F.size("h"), F.lit(sample)) - 1).alias("h"))
    return {r["lang"]: r["h"] for r in last.collect()}


def of_language(values: dict[str, int]) -> Column:
    """The value of the row's ``lang``."""
    return F.element_at(F.map_from_arrays(F.lit(list(values)), F.lit(list(values.values()))), F.col("lang"))


def train_trigrams(labelled: DataFrame, text: str, label: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """All languages that label a text with letters, and the log-probability of each trigram in each, from ``sample``
    texts of each language at most. Copies of a text count once."""
    known = labelled.where(F.col(label).isNotNull() & (F.col(label) != "") & F.col(text).rlike(r"[A-Za-z\x{80}-\x{10FFFF}]"))
    known = known.select(F.lower(F.col(label)).alias("lang"), text_column(text).alias("text")).withColumn("h", F.xxhash64("text"))
    last = smallest_hashes(known.select("lang", "h"), sample)
    chosen = known.where(F.col("h") <= of_language(last)) if last else known.where("false")
    chosen = chosen.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(trigrams(t), return_counts=True) for t in batch.column(1).to_pylist()]
        langs = [lang for lang, (number, _) in zip(batch.column(0).to_pylist(), found) for _ in number]
        number, times = (np.concatenate(c) if c else np.zeros(0) for c in zip(*found))
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(number.astype(np.int32)), pa.array(times.astype(np.int64))], ["lang", "gram", "n"]
        )

    counted = map_arrow(chosen, count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = counted.toArrow().to_pydict()  # at most 2**TRIGRAM_BITS rows a language
    langs = sorted(set(rows["lang"]))
    table = np.full((1 << TRIGRAM_BITS, len(langs)), 0.05, np.float64)
    place = {x: n for n, x in enumerate(langs)}
    np.add.at(table, (rows["gram"], [place[x] for x in rows["lang"]]), rows["n"])
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32) if langs else table.astype(np.float32)


def text_evidence(docs: DataFrame, model: tuple[list[str], np.ndarray], carry: Sequence[str], text: str) -> DataFrame:
    """Carried columns and ``evidence``: tempered log-likelihood by language, null for a text without letters."""
    langs, table = model
    kept, texts_of = with_texts(docs, carry, text)
    schema = StructType([*kept.schema.fields[: len(carry)], StructField("evidence", ArrayType(DoubleType()))])
    shared = docs.sparkSession.sparkContext.broadcast(table)  # of fixed height, a column a language

    def score(text: bytes) -> list[float] | None:
        grams = trigrams(text)
        if not len(grams) or not langs:
            return None
        total = shared.value[grams].sum(axis=0, dtype=np.float64) * min(1.0, TEMPER / len(grams))
        return (total - total.max()).tolist()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [score(t) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(scores, pa.list_(pa.float64()))], [*carry, "evidence"])

    return map_arrow(kept, run, schema)


def _total(weights: Column, n: int) -> list[Column]:
    return [F.sum(weights[i]).alias(f"w{i}") for i in range(n)]


def _smoothed(counts: Column, prior: Column) -> Column:
    """Shares of ``counts``, STRENGTH rows of ``prior`` mixed in."""
    whole = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + F.lit(STRENGTH)
    return F.zip_with(counts, prior, lambda c, p: (c + F.lit(STRENGTH) * p) / whole)


def fuse(scored: DataFrame, langs: Sequence[str], threshold: float) -> DataFrame:
    """Posterior of rows with ``evidence``, ``declared``, ``suffix``, ``domain`` and ``host`` (any may be null)."""
    n = len(langs)
    at = [F.col(f"w{i}") for i in range(n)]
    odds = F.transform("evidence", F.exp)
    scale = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    weights = F.transform(odds, lambda x: x / scale)
    # One pass over all rows: partial sums per combination, far fewer than rows.
    sums = (
        scored.where(F.col("evidence").isNotNull())
        .select("declared", "suffix", "domain", "host", weights.alias("w"))
        .groupBy("declared", "suffix", "domain", "host")
        .agg(*_total(F.col("w"), n))
    )
    sums = written(sums, "language-sums")

    def by(*keys: str) -> DataFrame:
        present = sums.where(F.lit(True) if not keys else F.col(keys[0]).isNotNull())
        return present.groupBy(*keys).agg(*[F.sum(c).alias(f"w{i}") for i, c in enumerate(at)]).select(*keys, F.array(*at).alias("n"))

    uniform = F.array_repeat(F.lit(1.0 / n), n)
    whole = by().select(_smoothed(F.coalesce("n", F.array_repeat(F.lit(0.0), n)), uniform).alias("all"))
    overall = whole.collect()[0]["all"]  # a number a language
    ground = F.array(*[F.lit(x) for x in overall])
    domains = by("domain").select("domain", _smoothed(F.col("n"), ground).alias("of_domain"))
    hosts = (
        by("host", "domain")
        .join(domains, "domain", "left")
        .select("host", _smoothed(F.col("n"), F.coalesce("of_domain", ground)).alias("prior"), F.aggregate("n", F.lit(0.0), lambda a, x: a + x).alias("size"))
        .groupBy("host")  # a host has one domain where the domain is a part of it
        .agg(F.max_by("prior", F.struct("size", "prior")).alias("prior"))
    )

    def likelihood(key: str) -> DataFrame:
        """log P(language | key) - log P(language): what the key says beyond the overall shares."""
        lift = F.zip_with(_smoothed(F.col("n"), ground), ground, lambda p, g: F.ln(p / g))
        return by(key).select(key, lift.alias(f"of_{key}"))

    nothing = F.array_repeat(F.lit(0.0), n)
    keys = ["declared", "suffix", "domain", "host"]
    known = sums.select(*keys).join(hosts, "host", "left").join(likelihood("declared"), "declared", "left").join(likelihood("suffix"), "suffix", "left")
    known = known.select(
        *keys,
        F.transform(F.coalesce("prior", ground), F.ln).alias("prior"),
        F.zip_with(F.coalesce("of_declared", nothing), F.coalesce("of_suffix", nothing), lambda a, b: a + b).alias("said"),
    )
    # All that is known of a combination is one row of a small table, so rows move once at most. A row without
    # evidence may find none; it has no posterior anyway.
    joined = join_null_safe(scored, written(known, "language-known"), keys, "left")
    added = F.zip_with(F.zip_with("evidence", "prior", lambda a, b: a + b), "said", lambda a, b: a + b)
    out = joined.withColumn("__sum", added).withColumn("__top", F.array_max("__sum"))
    mass = F.aggregate(F.transform("__sum", lambda x: F.exp(x - F.col("__top"))), F.lit(0.0), lambda a, x: a + x)
    names = F.array(*[F.lit(x) for x in langs])
    return (
        out.withColumn("language", F.get(names, F.array_position("__sum", F.col("__top")).cast("int") - 1))
        .withColumn("confidence", F.lit(1.0) / mass)
        .withColumn("kept", F.coalesce(F.col("confidence") >= threshold, F.lit(False)))
        .drop("evidence", "prior", "said", "__sum", "__top", "host", "declared", "suffix", "domain")
    )


def identify(
    docs: DataFrame, model: tuple[list[str], np.ndarray], carry: Sequence[str], text: str = "text",
    declared: Column | None = None, host: Column | None = None, threshold: float = 0.6,
) -> DataFrame:
    """Carried columns, ``language``, ``confidence`` and ``kept`` of each row of ``docs``."""
    langs = model[0]
    none = F.lit(None).cast("string")

    def clean(column: Column | None) -> Column:
        lowered = none if column is None else F.lower(F.trim(column.cast("string")))
        return F.nullif(lowered, F.lit(""))

    inside = text.partition(".")[0] in carry and "." in text  # a field of a carried row is not sent twice
    place = clean(host)
    labels = F.split(place, r"\.")
    parts = docs.select(
        *[F.col(c).alias(f"__keep_{c}") for c in carry],
        *([] if inside else [F.col(text).alias("__of")]),
        F.regexp_extract(clean(declared), "^[a-z]+", 0).alias("declared"),
        place.alias("host"),
        F.when(place.contains("."), F.element_at(labels, -1)).alias("suffix"),
        F.when(place.contains("."), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")).alias("domain"),
    ).withColumn("declared", F.nullif("declared", F.lit("")))
    names = [f"__keep_{c}" for c in carry]
    scored = text_evidence(parts, model, [*names, "declared", "suffix", "domain", "host"], f"__keep_{text}" if inside else "__of")
    if not langs:
        empty = {"language": none, "confidence": F.lit(None).cast("double"), "kept": F.lit(False)}
        return scored.select(*[F.col(f"__keep_{c}").alias(c) for c in carry], *[v.alias(k) for k, v in empty.items()])
    fused = fuse(written(scored, "language-evidence"), langs, threshold)
    return fused.select(*[F.col(f"__keep_{c}").alias(c) for c in carry], "language", "confidence", "kept")


def page_text(html: str = "html") -> Column:
    """The text of a page: scripts, styles, comments and tags become blanks."""
    return F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", " ")


def page_language(html: str = "html") -> Column:
    return F.regexp_extract(html, r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z-]+)""", 1)


def page_host(url: str = "url") -> Column:
    return F.regexp_extract(url, r"://(?:[^/?#@]*@)?([^/?#:]*)", 1)
