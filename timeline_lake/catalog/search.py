"""Search and telemetry queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeline_lake.catalog.sql import FRAMES, TELEMETRY, USAGE, with_
from timeline_lake.catalog.streams import WALK
from timeline_lake.plans import search as S
from timeline_lake.plans import telemetry as Y
from timeline_lake.plans import views as V
from timeline_lake.streaming import runs

KEYS = S.KEYS
# Frequent English function words of the given documents are not known in advance; these occur in any of them.
TERMS = ["the", "license"]


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return V.table(spark, folder, "documents").select(
        F.col("lang").alias("project_slug"), F.concat(F.col("source"), F.lit("-"), F.col("doc_id")).alias("source_slug"), F.col("text").alias("full_text"), "doc_id"
    )


def _index(spark: SparkSession, folder: str, stemmed: bool = False) -> DataFrame:
    return S.postings(S.tokens(S.by_document(_documents(spark, folder)), stemmed))


def fts_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.tokens(_documents(spark, folder), stemmed=False)
    return rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("term").alias("vocabulary"), F.sum(F.length("term") * F.col("position")).alias("weight"))


def fts_tokens_stemmed(spark: SparkSession, folder: str) -> DataFrame:
    return S.tokens(_documents(spark, folder)).groupBy("term").agg(F.count(F.lit(1)).alias("occurrences"))


def fts_index(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).select("term", *KEYS, "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


def fts_terms(spark: SparkSession, folder: str) -> DataFrame:
    return S.term_counts(_index(spark, folder))


def _stored_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index as a table sorted by term: a search reads the row groups of its terms, and texts are cut into terms once."""
    path = runs.work_folder(spark, "index")
    index = _index(spark, folder)
    S.write_index(index, path)
    return spark.read.schema(index.schema).parquet(path)


def fts_search(spark: SparkSession, folder: str) -> DataFrame:
    index = _stored_index(spark, folder)
    hits = S.search(index, S.lengths_of(index), TERMS, project="en", stemmed=False)
    return hits.select(*KEYS, F.round(F.col("score") * 1e6).cast("long").alias("score_ppm"))


def fts_boolean(spark: SparkSession, folder: str) -> DataFrame:
    return S.boolean_search(_index(spark, folder), any_of=["license", "copyright"], none_of=["apache"], prefix="th", stemmed=False)


def fts_folded_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Searches as they are typed: accents, capitals and a word that is cut in two."""
    index = _stored_index(spark, folder)
    accented = S.boolean_search(index, any_of=["MÉNT", "Öch"], stemmed=False).withColumn("asked", F.lit("accents"))
    prefix = S.boolean_search(index, prefix="Él", stemmed=False).withColumn("asked", F.lit("prefix"))
    cut = S.search(index, S.lengths_of(index), ["of-THE"], stemmed=False).select(*KEYS, F.lit("phrase").alias("asked"))
    return accented.unionByName(prefix).unionByName(cut)


def fts_phrase(spark: SparkSession, folder: str) -> DataFrame:
    return S.phrase_search(_index(spark, folder), ["of", "the"], stemmed=False)


def fts_maintain(spark: SparkSession, folder: str) -> DataFrame:
    documents = _documents(spark, folder)
    rest = F.pmod("doc_id", F.lit(6))
    changed = documents.filter(rest == 0).withColumn("full_text", F.concat(F.lit("changed "), "project_slug"))
    index = S.maintain(_index(spark, folder), changed, documents.filter(rest == 1), stemmed=False)
    return S.term_counts(index)


def phase_profile(spark: SparkSession, folder: str) -> DataFrame:
    return Y.phase_profile(V.telemetry(spark, folder))


def frame_stats(spark: SparkSession, folder: str) -> DataFrame:
    return Y.frame_stats(V.frames(spark, folder))


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    body = F.struct(
        F.when(F.pmod(key, F.lit(40)) != 7, F.concat(F.lit("p"), "o_custkey", F.lit("/r"), key)).alias("render_id"), F.concat(F.lit("p"), "o_custkey").alias("project"),
        F.concat(F.lit("r"), key).alias("slug"), F.lit("completed").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("finished_at"),
        F.create_map(F.lit("wall_seconds"), F.pmod(key, F.lit(90)) * 0.5, F.lit("export_total_seconds"), F.pmod(key, F.lit(50)) * 0.25).alias("timing"),
        (F.pmod(key, F.lit(480)) / F.lit(8.0)).alias("output_duration_seconds"), (key * 1024).alias("file_size_bytes"), F.lit("1920x1080").alias("resolution"),
        F.when(F.pmod(key, F.lit(2)) == 0, F.lit("h264")).otherwise(F.lit("hevc")).alias("codec"), F.lit(30.0).alias("fps"),
        F.pmod(key, F.lit(3)).alias("source_count"), F.pmod(key, F.lit(9)).alias("segment_count"), (F.pmod(key, F.lit(2)) == 0).alias("captions_applied"),
    )
    return V.table(spark, folder, "orders").select(F.to_json(body).alias("json"))


def render_fact(spark: SparkSession, folder: str) -> DataFrame:
    return Y.render_facts(_payloads(spark, folder)).filter(~F.col("bad")).drop("json", "bad", "timing")


def render_timing(spark: SparkSession, folder: str) -> DataFrame:
    return Y.timing_rows(Y.render_facts(_payloads(spark, folder)))


def usage_quota(spark: SparkSession, folder: str) -> DataFrame:
    return Y.quota_decisions(V.usage(spark, folder))


def usage_rollup(spark: SparkSession, folder: str) -> DataFrame:
    requests = V.usage(spark, folder)
    return Y.usage_rollup(Y.quota_decisions(requests), requests)


QUERIES = {
    f.__name__: f
    for f in (
        fts_tokens, fts_tokens_stemmed, fts_index, fts_terms, fts_search, fts_boolean, fts_folded_terms, fts_phrase, fts_maintain, phase_profile, frame_stats, render_fact,
        render_timing, usage_quota, usage_rollup,
    )
}

_TOKENS = r"""
docs AS (SELECT lang AS project_slug, source || '-' || doc_id AS source_slug, doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS t FROM documents),
tok AS (SELECT project_slug, source_slug, doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS position FROM docs)"""
_POST = """
post AS (SELECT term, project_slug, source_slug, COUNT(*) AS tf FROM tok GROUP BY ALL)"""
_FACT = """
fact AS (SELECT 'p' || o_custkey || '/r' || o_orderkey AS render_id, 'p' || o_custkey AS project, 'r' || o_orderkey AS slug, 'completed' AS status, (o_orderkey % 480) / 8.0::DOUBLE AS output_duration_seconds,
  o_orderkey * 1024 AS file_size_bytes, '1920x1080' AS resolution, CASE WHEN o_orderkey % 2 = 0 THEN 'h264' ELSE 'hevc' END AS codec, 30.0::DOUBLE AS fps, o_orderkey % 3 AS source_count, o_orderkey % 9 AS segment_count,
  o_orderkey % 2 = 0 AS captions_applied, o_orderdate AS finished_at, o_orderkey AS k FROM orders WHERE o_orderkey % 40 <> 7)"""

ORACLES = {
    "fts_tokens": with_(_TOKENS) + " SELECT project_slug, source_slug, COUNT(*) AS n, COUNT(DISTINCT term) AS vocabulary, SUM(length(term) * position)::BIGINT AS weight FROM tok GROUP BY ALL",
    "fts_index": with_(_TOKENS) + " SELECT term, project_slug, source_slug, COUNT(*) AS tf, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions FROM tok GROUP BY ALL",
    "fts_terms": with_(_TOKENS, _POST) + " SELECT term, COUNT(*) AS df, SUM(tf)::BIGINT AS occurrences FROM post GROUP BY term",
    "fts_search": with_(_TOKENS, _POST) + f""", tot AS (SELECT COUNT(*) AS docs, AVG(len(t)) AS mean FROM docs), hit AS (SELECT * FROM post WHERE term IN ({', '.join(f"'{t}'" for t in TERMS)})),
w AS (SELECT term, mean, CASE WHEN ln((docs - COUNT(*) + 0.5) / (COUNT(*) + 0.5)) > 0 THEN ln((docs - COUNT(*) + 0.5::DOUBLE) / (COUNT(*) + 0.5::DOUBLE)) ELSE 1e-6 END AS idf FROM hit, tot GROUP BY term, docs, mean),
sc AS (SELECT hit.project_slug, hit.source_slug, COUNT(*) AS m, SUM(idf * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t) / mean))) AS score FROM hit JOIN w USING (term) JOIN docs USING (project_slug, source_slug) WHERE project_slug = 'en' GROUP BY ALL)
SELECT project_slug, source_slug, round(score * 1e6)::BIGINT AS score_ppm FROM sc WHERE m = {len(TERMS)}""",
    "fts_boolean": with_(_TOKENS, _POST) + """ SELECT DISTINCT project_slug, source_slug FROM post p WHERE term IN ('license', 'copyright')
  AND source_slug IN (SELECT source_slug FROM post WHERE term LIKE 'th%') AND source_slug NOT IN (SELECT source_slug FROM post WHERE term = 'apache')""",
    "fts_folded_terms": with_(_TOKENS, _POST) + """ SELECT DISTINCT project_slug, source_slug, 'accents' AS asked FROM post WHERE term IN ('ment', 'och')
UNION ALL SELECT DISTINCT project_slug, source_slug, 'prefix' FROM post WHERE term LIKE 'el%'
UNION ALL SELECT DISTINCT a.project_slug, a.source_slug, 'phrase' FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.position = a.position + 1 WHERE a.term = 'of' AND b.term = 'the'""",
    "fts_phrase": with_(_TOKENS) + " SELECT DISTINCT a.project_slug, a.source_slug FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.position = a.position + 1 WHERE a.term = 'of' AND b.term = 'the'",
    "fts_maintain": r"""WITH now AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'changed ' || lang ELSE text END AS t FROM documents WHERE doc_id % 6 <> 1),
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(strip_accents(t)), '[\p{L}\p{N}]+')) AS term FROM now)
SELECT term, COUNT(DISTINCT doc_id) AS df, COUNT(*) AS occurrences FROM tok GROUP BY term""",
    "phase_profile": with_(TELEMETRY) + """, w AS (SELECT render_id, SUM(seconds) AS wall FROM telemetry GROUP BY render_id), l AS (SELECT render_id, phase, arg_max(seconds, seq) AS seconds FROM telemetry GROUP BY ALL)
SELECT render_id, phase, seconds, CASE WHEN wall > 0 THEN floor(seconds / wall * 100)::BIGINT ELSE 0 END AS percent FROM l JOIN w USING (render_id)""",
    "frame_stats": with_(FRAMES) + """, s AS (SELECT *, row_number() OVER (PARTITION BY render_id ORDER BY elapsed) - 1 AS r, COUNT(*) OVER (PARTITION BY render_id) AS n FROM frames)
SELECT render_id, any_value(n) AS n, SUM(elapsed) / any_value(n) AS mean, MAX(CASE WHEN r = n // 2 THEN elapsed END) AS p50, MAX(CASE WHEN r = least(floor(n * 0.95::DOUBLE)::BIGINT, n - 1) THEN elapsed END) AS p95,
  MIN(elapsed) AS min, MAX(elapsed) AS max, arg_max(recorded_at, seq) - arg_min(recorded_at, seq) AS wall,
  CASE WHEN arg_max(recorded_at, seq) - arg_min(recorded_at, seq) > 0 THEN any_value(n) / (arg_max(recorded_at, seq) - arg_min(recorded_at, seq)) ELSE 0.0 END AS fps FROM s GROUP BY render_id""",
    "render_fact": with_(_FACT) + " SELECT * EXCLUDE (k) FROM fact",
    "render_timing": with_(_FACT) + " SELECT render_id, 'wall_seconds' AS measure, (k % 90) * 0.5::DOUBLE AS seconds FROM fact UNION ALL SELECT render_id, 'export_total_seconds', (k % 50) * 0.25::DOUBLE FROM fact",
    "usage_quota": with_(USAGE, WALK) + " SELECT * FROM walk",
    "usage_rollup": with_(USAGE, WALK) + """ SELECT uid, SUM(CASE WHEN accepted THEN CAST(round(minutes * 60000) AS BIGINT) ELSE 0 END) / 60000.0::DOUBLE AS minutes_used, MAX(CASE WHEN accepted THEN ts END) AS last_use, COUNT(*) FILTER (NOT accepted) AS rejected
FROM walk JOIN (SELECT uid, request_id, ts FROM usage) USING (uid, request_id) GROUP BY uid""",
}
