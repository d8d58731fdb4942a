"""The registered queries of the subpackage and their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavemill.llm import alignment, bpe, decontamination, hamming_search, language_id, mixing, near_dedup, quality, resampling, sharding, token_counts, training_order, url_rules
from wavemill.llm.common import written
from wavemill.session import scratch_path
from wavemill.sources.tables import read_table

SHARDS = 24
END_OF_TEXT = 50256
#: The place rules of the URL query.
PLACES = (
    url_rules.place_rule("allow", "org/"),
    url_rules.place_rule("block", "example.org/es/"),
    url_rules.place_rule("block", "example.org/en/1"),
    url_rules.place_rule("allow", "com/fr/"),
    url_rules.place_rule("block", "com/de/"),
)


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark, sf_dir, name):
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def op1_language_id(spark, sf_dir):
    """Language of every document (declared: lang, host: source) and of every page (markup, address, host)."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = language_id.train_trigrams(docs, "text", "lang")
    none = F.lit(None).cast("bigint")
    of_docs = docs.select("doc_id", none.alias("page_id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    of_pages = pages.select(
        none.alias("doc_id"), "page_id", language_id.page_text("html").alias("text"),
        language_id.page_language("html").alias("declared"), language_id.page_host("url").alias("host"),
    )
    both = of_docs.unionByName(of_pages)
    return language_id.identify(both, model, ["doc_id", "page_id"], "text", F.col("declared"), F.col("host"))


def op2_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_training_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = scratch_path(spark, "training-shards")
    out = out if "://" in out or out.startswith("file:") else f"file://{out}"
    return training_order.materialise(docs, tokenizer("byte_bpe_50k.json"), out, END_OF_TEXT)


def op4_url_filters(spark, sf_dir):
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), (*PLACES, *url_rules.PATTERNS)).drop("n_tried")


def op5_quality_rules(spark, sf_dir):
    judged = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "score")


def op6_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op7_nearest_neighbours(spark, sf_dir):
    return hamming_search.nearest(table(spark, sf_dir, "embeddings"))


def op8_source_mix(spark, sf_dir):
    """Copies of every document: their shards, and the keys that order each shard."""
    each = [F.col(f"copies.{k}").alias(f"{k}s") for k in ("shard", "slot_key")]
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", *each)


def op9_sharding(spark, sf_dir):
    tree = sharding.balanced_tree(SHARDS)
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.shard_rows(sized, "doc_id", {"shard": tree, "grown_shard": sharding.grown(tree)})
    placed = written(placed, "shards")
    numbered = sharding.number_slots(placed, "shard", ["doc_id", "text_crc32", "size"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard")


def op10_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_decontamination(spark, sf_dir):
    """Words of every document that stand in a window of a benchmark item, and the items."""
    tests = decontamination.TestSet(table(spark, sf_dir, "benchmark"))
    hits = decontamination.hit_documents(table(spark, sf_dir, "documents"), tests)
    ids = F.sha2(F.array_join("items", ","), 256)
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op12_importance_resampling(spark, sf_dir):
    """Weight, score and rank of every document in a draw towards the benchmark's words."""
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_tokenizer_alignment(spark, sf_dir):
    """Groups and links of the tokens that two tokenizers give every document."""
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def _pattern_sql() -> str:
    tests = [f"regexp_matches(lowered, '{r.pattern}')" for r in url_rules.PATTERNS]
    return "(" + " OR ".join(tests) + ")"


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NAMED = " ".join(f"WHEN regexp_matches(lowered, '{r.pattern}') THEN '{r.name}'" for r in sorted(url_rules.PATTERNS, key=lambda r: r.name))

OP4_SQL = f"""
WITH cut AS (
  SELECT page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS mark FROM pages
), rest AS (
  SELECT page_id, {_LOWER.format('url')} AS lowered, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS rest FROM cut
), parts AS (
  SELECT page_id, lowered, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM rest
), split AS (
  SELECT page_id, lowered, {_LOWER.format('raw_host')} AS host,
    regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM parts
), placed AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
    {_pattern_sql()} AS hit, CASE {_NAMED} END AS pattern FROM split
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
  WHEN rule IS NOT NULL OR hit THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM placed
"""

OP11_SQL = f"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), item AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), shape AS (
  SELECT item_id, w, least(len(w), 10) AS size FROM item WHERE len(w) > 0
), gram AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i + 1 : i + size], ' ') AS gram
  FROM (SELECT item_id, w, size, unnest(range(0, len(w) - size + 1)) AS i FROM shape)
), sizes AS (
  SELECT DISTINCT size FROM gram
), place AS (
  SELECT r, size, i, array_to_string(w[i + 1 : i + size], ' ') AS gram
  FROM (SELECT r, w, size, unnest(range(0, len(w) - size + 1)) AS i FROM doc CROSS JOIN sizes WHERE len(w) >= size)
), found AS (
  SELECT r, i, p.size, item_id FROM place p JOIN gram g ON p.gram = g.gram AND p.size = g.size
), hit AS (
  SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS x FROM (SELECT DISTINCT r, i, size FROM found)) GROUP BY r
), ids AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_bpe_round_trip, op3_training_order, op4_url_filters, op5_quality_rules, op6_near_dedup,
        op7_nearest_neighbours, op8_source_mix, op9_sharding, op10_token_counts, op11_decontamination,
        op12_importance_resampling, op13_tokenizer_alignment,
    )
}
CHECKS = {"op4_url_filters": OP4_SQL, "op11_decontamination": OP11_SQL}
