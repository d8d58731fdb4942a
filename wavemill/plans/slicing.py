"""Sources, sinks, filters, splits and the matrix catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavemill.functions.numeric import tidy
from wavemill.operators import catalog as entries
from wavemill.operators import slices
from wavemill.plans import inputs
from wavemill.plans import sqlparts as q
from wavemill.plans.registry import query
from wavemill.session import scratch_path
from wavemill.sources import sinks
from wavemill.sources.schemas import DOCUMENTS
from wavemill.sources.tables import read_results, read_table

LANGUAGES = ["en", "de", "fr", "es", "xx"]
CAP = 400
CAP_PER_SLICE = 150


def documents(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents")


@query("SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents")
def scan_documents(spark, sf_dir):
    docs = read_table(spark, f"{sf_dir}/documents.parquet", DOCUMENTS)
    return docs.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query(q.with_parts([q.event_results()],
                    f"SELECT method, 'events' AS dataset, seed, 'value' AS metric, {q.r('value')} AS value FROM results"))
def results_roundtrip(spark, sf_dir):
    """Result rows written as JSON lines and read back."""
    path = scratch_path(spark, "results")
    sinks.write_results(inputs.results(spark, sf_dir), path)
    back = read_results(spark, path)
    return back.withColumn("value", tidy(F.col("value")))


SPLIT_CASE = f"CASE WHEN {q.u32(42, 'doc_id')} < CAST(floor(0.2 * 4294967296) AS BIGINT) THEN 'test' ELSE 'train' END"


@query("SELECT source AS subset, count(*) AS n FROM documents GROUP BY source")
def subsets_written(spark, sf_dir):
    """One folder per subset, read back and counted."""
    path = scratch_path(spark, "subsets")
    sinks.write_subsets(documents(spark, sf_dir).withColumnRenamed("source", "subset"), path)
    back = spark.read.schema("doc_id long, text string, lang string, n_chars long, subset string").json(path)
    return back.groupBy("subset").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en'")
def slice_lang(spark, sf_dir):
    return documents(spark, sf_dir).where(F.col("lang") == "en").select("doc_id", "source", "n_chars")


@query("SELECT doc_id, lang || '_' || source AS segment FROM documents "
       "WHERE lang IN ('en', 'de') AND source IN ('src0', 'src1')")
def slice_lang_source(spark, sf_dir):
    """Slices by two keys, all in one pass."""
    docs = documents(spark, sf_dir).where(F.col("lang").isin("en", "de") & F.col("source").isin("src0", "src1"))
    return docs.select("doc_id", F.concat_ws("_", "lang", "source").alias("segment"))


@query("SELECT doc_id, upper(lang) AS lang FROM documents WHERE lower(coalesce(upper(lang), 'english')) = 'en'")
def slice_nocase(spark, sf_dir):
    shouted = documents(spark, sf_dir).select("doc_id", F.upper("lang").alias("lang"))
    return shouted.where(slices.equals_nocase("lang", "en", "english"))


@query("SELECT 'en' AS wanted, doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT 'xx', doc_id FROM documents")
def slice_or_all(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "lang")
    some = slices.filter_or_all(docs, F.col("lang") == "en").select(F.lit("en").alias("wanted"), "doc_id")
    none = slices.filter_or_all(docs, F.col("lang") == "xx").select(F.lit("xx").alias("wanted"), "doc_id")
    return some.unionByName(none)


EXACT_SPLIT = f"""ranked AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {q.u32(42, 'doc_id')}, doc_id) AS rn,
  count(*) OVER (PARTITION BY lang) AS n FROM documents),
split AS (SELECT doc_id, lang AS segment, CASE WHEN rn <= (n * 2 + 9) // 10 THEN 'test' ELSE 'train' END AS split FROM ranked)"""


def _exact_split(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.col("lang").alias("segment"))
    return slices.split_exact(docs, ["segment"], "doc_id")


@query("WITH " + EXACT_SPLIT + """, sliced AS (SELECT segment, unnest([split, 'all']) AS split, n_chars FROM split JOIN documents USING (doc_id))
SELECT segment, split, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM sliced GROUP BY ALL""")
def slices_written(spark, sf_dir):
    """Train, test and undivided slices written as folders of JSON lines, then read back and counted."""
    path = scratch_path(spark, "slices")
    docs = documents(spark, sf_dir).withColumnRenamed("lang", "segment")
    sinks.write_slices(slices.split_exact(docs, ["segment"], "doc_id"), path, key="doc_id", whole=True)
    schema = "doc_id long, text string, source string, n_chars long, segment string, split string"
    back = spark.read.schema(schema).json(path)
    return back.groupBy("segment", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")
    )


@query("WITH " + EXACT_SPLIT + " SELECT doc_id, segment, split FROM split")
def split_exact(spark, sf_dir):
    return _exact_split(spark, sf_dir).select("doc_id", "segment", "split")


@query(f"SELECT doc_id, {SPLIT_CASE} AS split FROM documents")
def split_hash(spark, sf_dir):
    return slices.split_hash(documents(spark, sf_dir).select("doc_id"), "doc_id")


@query(f"SELECT doc_id, lang FROM documents ORDER BY {q.u32(42, 'doc_id')}, doc_id LIMIT {CAP}")
def sample_cap(spark, sf_dir):
    return slices.sample_cap(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id", CAP)


@query(f"""SELECT doc_id, lang FROM documents
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {q.u32(42, 'doc_id')}, doc_id) <= {CAP_PER_SLICE}""")
def sample_cap_by_slice(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "lang")
    return slices.sample_cap_by(docs, ["lang"], "doc_id", CAP_PER_SLICE)


WANTED = ", ".join(f"('{x}')" for x in LANGUAGES)


@query("WITH " + EXACT_SPLIT + f""" SELECT w.segment, p.split, count(s.doc_id) AS n
FROM (VALUES {WANTED}) AS w(segment) CROSS JOIN (VALUES ('train'), ('test')) AS p(split)
LEFT JOIN split s ON s.segment = w.segment AND s.split = p.split GROUP BY ALL""")
def slice_report(spark, sf_dir):
    """Rows per expected slice and split; an empty slice shows 0."""
    expected = spark.createDataFrame([(x,) for x in LANGUAGES], "segment string")
    return slices.split_report(_exact_split(spark, sf_dir), "segment", expected)


CATALOG = """catalog AS (SELECT *, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS ord FROM (
  SELECT p_type || '.' || p_brand AS name, p_type AS kind, count(*)::INTEGER AS n_rows, max(p_size)::INTEGER AS n_cols,
    (CASE WHEN max(p_size) = 1 THEN 1 ELSE 2 END)::INTEGER AS n_dims, 4::INTEGER AS bytes_per_value FROM part GROUP BY p_type, p_brand))"""
CATALOG_COLUMNS = ["name", "kind", "ord", "n_dims", "n_rows", "n_cols"]
_LIST = ", ".join(CATALOG_COLUMNS)


@query(f"WITH {CATALOG} SELECT {_LIST} FROM catalog WHERE (contains(name, 'ECO') OR contains(name, 'PROMO')) AND n_dims >= 2")
def catalog_select(spark, sf_dir):
    return entries.select_named(inputs.catalog(spark, sf_dir), ["ECO", "PROMO"]).select(*CATALOG_COLUMNS)


@query(f"WITH {CATALOG} SELECT {_LIST} FROM catalog WHERE n_dims >= 2 AND n_rows <= 14")
def catalog_select_fallback(spark, sf_dir):
    """No name matches, so small two-dimensional entries are taken."""
    chosen = entries.select_named_or_small(inputs.catalog(spark, sf_dir), ["q_proj", "v_proj"], 14)
    return chosen.select(*CATALOG_COLUMNS)


@query(f"WITH {CATALOG} SELECT {_LIST} FROM catalog WHERE n_dims >= 2 ORDER BY ord LIMIT 8")
def catalog_first_n(spark, sf_dir):
    flat = inputs.catalog(spark, sf_dir).where(F.col("n_dims") >= 2)
    return entries.first_entries(flat, 8).select(*CATALOG_COLUMNS)


@query(f"""WITH {CATALOG} SELECT {_LIST} FROM catalog WHERE n_dims >= 2
QUALIFY row_number() OVER (PARTITION BY kind ORDER BY ord) <= 3""")
def catalog_first_by_kind(spark, sf_dir):
    flat = inputs.catalog(spark, sf_dir).where(F.col("n_dims") >= 2)
    return entries.first_entries_by(flat, "kind", 3).select(*CATALOG_COLUMNS)
