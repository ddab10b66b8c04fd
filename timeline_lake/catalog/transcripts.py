"""Transcript queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeline_lake.catalog.sql import DOC_WORDS, DURATIONS, UTTERANCES, WORDS, with_
from timeline_lake.plans import retakes as R
from timeline_lake.plans import transcripts as T
from timeline_lake.plans import views as V

KEYS = T.KEYS


def _durations(words: DataFrame) -> DataFrame:
    return T.transcript_rollup(words).select(*KEYS, "duration_seconds")


def utterances(spark: SparkSession, folder: str) -> DataFrame:
    return T.compact_utterances(V.words(spark, folder))


def gaps(spark: SparkSession, folder: str) -> DataFrame:
    return T.gaps(V.words(spark, folder))


def compact_json(spark: SparkSession, folder: str) -> DataFrame:
    # The JSON text itself is compared in the tests; engines differ in how they print it.
    entries = T.compact_entries(V.words(spark, folder))
    parsed = F.from_json("json", "start double, end double, text string, gap double")
    return entries.withColumn("_j", parsed).select(*KEYS, "word_index", "entry", "_j.start", "_j.end", "_j.text", "_j.gap")


def silence_segments(spark: SparkSession, folder: str) -> DataFrame:
    words = V.words(spark, folder)
    # With 0.17 s of padding no two spans touch exactly, so the plain SQL form gives the same answer.
    return T.silence_segments(words, _durations(words), padding=0.17).drop("span")


def silence_summary(spark: SparkSession, folder: str) -> DataFrame:
    words = V.words(spark, folder)
    return T.silence_summary(words, _durations(words), gap_threshold=0.6)


def word_flags(spark: SparkSession, folder: str) -> DataFrame:
    return T.word_flags(V.words(spark, folder), context=False)


def word_flags_normalized(spark: SparkSession, folder: str) -> DataFrame:
    return T.word_flags(V.words(spark, folder), normalize=True, context=False)


def word_context(spark: SparkSession, folder: str) -> DataFrame:
    return T.word_flags(V.words(spark, folder)).select(*KEYS, "word_index", "context")


def _damaged(words: DataFrame) -> DataFrame:
    index = F.col("word_index")
    return words.withColumn(
        "end_time",
        F.when(F.pmod(index, F.lit(5)) == 0, F.lit(0.0))
        .when(F.pmod(index, F.lit(7)) == 0, F.col("end_time") + 3.0)
        .otherwise(F.col("end_time")),
    )


def endtime_repair(spark: SparkSession, folder: str) -> DataFrame:
    return T.repair_end_times(_damaged(V.words(spark, folder))).select(*KEYS, "word_index", "start_time", "end_time")


def chunk_stitch(spark: SparkSession, folder: str) -> DataFrame:
    words = V.words(spark, folder)
    # Chunk k covers [20k, 25k+…): each word goes to its chunk and, in the 5 s overlap, to the one before as well.
    own = F.floor(F.col("start_time") / 20.0).cast("long")
    in_overlap = (F.col("start_time") - own * 20.0 < 5.0) & (own > 0)
    chunked = words.withColumn(
        "chunk_index", F.explode(F.array_compact(F.array(own, F.when(in_overlap, own - 1))))
    )
    offset = F.col("chunk_index") * 20.0
    chunk_words = chunked.select(
        *KEYS, "chunk_index", "word_index", "word",
        (F.col("start_time") - offset).alias("start_time"), (F.col("end_time") - offset).alias("end_time"), "confidence",
    )
    chunks = chunk_words.select(*KEYS, "chunk_index").distinct().select(
        *KEYS, "chunk_index", (F.col("chunk_index") * 20.0).alias("offset"),
        F.when(F.pmod("chunk_index", F.lit(3)) == 1, F.lit(0.0)).otherwise(F.lit(24.0)).alias("duration"),
    )
    return T.stitch_chunks(chunk_words, chunks).drop("confidence")


def transcript_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return T.transcript_rollup(V.words(spark, folder))


def transcript_text(spark: SparkSession, folder: str) -> DataFrame:
    return T.transcript_text(V.words(spark, folder), words_per_part=100)


def near_duplicate_next(spark: SparkSession, folder: str) -> DataFrame:
    return R.nearest_alike(V.doc_words(spark, folder), longest=V.longest_doc(spark, folder)).select(*KEYS, "i", "j", F.floor(F.col("similarity") * 100).cast("long").alias("percent"))


def retake_flags(spark: SparkSession, folder: str) -> DataFrame:
    flags = R.retake_flags(V.doc_words(spark, folder), longest=V.longest_doc(spark, folder))
    return flags.select(*KEYS, "i", "j", "text", "start", "end", "reason", F.col("duplicate_of.text").alias("of_text"))


QUERIES = {
    "near_duplicate_next": near_duplicate_next,
    "retake_flags": retake_flags,
    "utterances": utterances,
    "gaps": gaps,
    "compact_json": compact_json,
    "silence_segments": silence_segments,
    "silence_summary": silence_summary,
    "word_flags": word_flags,
    "word_flags_normalized": word_flags_normalized,
    "word_context": word_context,
    "endtime_repair": endtime_repair,
    "chunk_stitch": chunk_stitch,
    "transcript_rollup": transcript_rollup,
    "transcript_text": transcript_text,
}

# Fixed values, written out once more so that the SQL does not follow the code.
_SHORT = """'i', 'a', 'an', 'is', 'it', 'be', 'to', 'in', 'of', 'on', 'at', 'by', 'we', 'he', 'me', 'my', 'no', 'so', 'up', 'us', 'or', 'if', 'as', 'do', 'go', 'oh', 'ok', 'hi', 'yo', 'ah', 'um', 'uh'"""


def _flags_sql(word: str, tail: str) -> str:
    return with_(
        WORDS,
        f""" near AS (SELECT *, {word} AS w, COALESCE(start_time - lag(end_time) OVER o, 0) AS gb, COALESCE(lead(start_time) OVER o - end_time, 0) AS ga,
  array_to_string(list_filter([lag(word, 3) OVER o, lag(word, 2) OVER o, lag(word) OVER o, '[' || word || ']', lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o], lambda x: x IS NOT NULL), ' ') AS context
  FROM words WINDOW o AS (PARTITION BY project_slug, source_slug ORDER BY word_index)),
flagged AS (SELECT project_slug, source_slug, word_index, word, round(start_time * 10) / 10 AS start, round(end_time * 10) / 10 AS "end", context,
  CASE WHEN length(w) <= 2 AND regexp_matches(w, '^[a-zA-Z]+$') AND lower(w) NOT IN ({_SHORT}) THEN 'unusually short word'
    WHEN NOT regexp_matches(w, '^[a-zA-Z]+(-[a-zA-Z]+)*(''[a-zA-Z]+)?$') THEN 'unusual character pattern'
    WHEN gb > 2.0 OR ga > 2.0 THEN 'adjacent to long silence gap'
    WHEN confidence < 0.5 THEN 'low confidence (' || floor(confidence * 100)::BIGINT || '%)' END AS reason FROM near)
{tail}""",
    )


_NORMALIZED = r"regexp_replace(word, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')"

_ALIKE = """
tok AS (SELECT project_slug AS p, source_slug AS s, first_index AS i, n_words AS n, list_distinct(list_transform(string_split(text, ' '), lambda x: lower(x))) AS t FROM utt WHERE n_words >= 3),
pre AS (SELECT p, s, i, n, t, unnest(list_sort(list_transform(t, lambda x: {'l': -length(x), 'w': x}))[:len(t) - ((7 * len(t) + 9) // 10) + 1]).w AS w FROM tok),
pairs AS (SELECT DISTINCT a.p, a.s, a.i, b.i AS j, a.n AS na, b.n AS nb, a.t AS ta, b.t AS tb FROM pre a JOIN pre b ON a.p = b.p AND a.s = b.s AND a.w = b.w AND b.i > a.i),
alike AS (SELECT p, s, i, j, len(list_intersect(ta, tb))::DOUBLE / len(list_distinct(ta || tb)) AS sim FROM pairs WHERE least(na, nb)::DOUBLE / greatest(na, nb) >= 0.5 AND len(list_intersect(ta, tb))::DOUBLE / len(list_distinct(ta || tb)) >= 0.7)"""

ORACLES = {
    "near_duplicate_next": with_(DOC_WORDS, UTTERANCES, _ALIKE)
    + " SELECT p AS project_slug, s AS source_slug, i, MIN(j) AS j, floor(arg_min(sim, j) * 100)::BIGINT AS percent FROM alike GROUP BY p, s, i",
    "retake_flags": with_(DOC_WORDS, UTTERANCES, _ALIKE)
    + """, cand AS (SELECT p, s, i, list(j ORDER BY j) AS js, row_number() OVER (PARTITION BY p, s ORDER BY i) AS rn FROM alike GROUP BY p, s, i),
greedy AS (SELECT p, s, i, rn, js[1] AS j, [js[1]] AS taken FROM cand WHERE rn = 1
  UNION ALL SELECT c.p, c.s, c.i, c.rn, list_filter(c.js, lambda x: NOT list_contains(g.taken, x))[1], list_append(g.taken, list_filter(c.js, lambda x: NOT list_contains(g.taken, x))[1])
  FROM greedy g JOIN cand c ON c.p = g.p AND c.s = g.s AND c.rn = g.rn + 1)
SELECT g.p AS project_slug, g.s AS source_slug, g.i, g.j, b.text, round(b.s * 10) / 10 AS start, round(b.e * 10) / 10 AS "end",
  'near-duplicate of earlier utterance (' || floor(sim * 100)::BIGINT || '% match) — possible retake' AS reason, a.text AS of_text
FROM greedy g JOIN alike k ON k.p = g.p AND k.s = g.s AND k.i = g.i AND k.j = g.j JOIN utt b ON b.project_slug = g.p AND b.source_slug = g.s AND b.first_index = g.j
JOIN utt a ON a.project_slug = g.p AND a.source_slug = g.s AND a.first_index = g.i""",
    "utterances": with_(WORDS, UTTERANCES)
    + """ SELECT project_slug, source_slug, first_index AS word_index, round(s * 10) / 10 AS start, round(e * 10) / 10 AS "end", text FROM utt""",
    "gaps": with_(WORDS, UTTERANCES)
    + " SELECT project_slug, source_slug, word_index, round(gap * 10) / 10 AS gap FROM gapped WHERE gap >= 0.4",
    "compact_json": with_(WORDS, UTTERANCES)
    + """ SELECT project_slug, source_slug, first_index AS word_index, 1 AS entry, round(s * 10) / 10 AS start, round(e * 10) / 10 AS "end", text, NULL::DOUBLE AS gap FROM utt
UNION ALL SELECT project_slug, source_slug, word_index, 0, NULL, NULL, NULL, round(gap * 10) / 10 FROM gapped WHERE gap >= 0.4""",
    "silence_segments": with_(WORDS, UTTERANCES, DURATIONS)
    + """, padded AS (SELECT u.project_slug, u.source_slug, first_index, greatest(0, round(s * 10) / 10 - 0.17::DOUBLE) AS ps, least(duration_seconds, round(e * 10) / 10 + 0.17::DOUBLE) AS pe
  FROM utt u JOIN durations USING (project_slug, source_slug)),
opened AS (SELECT *, CASE WHEN ps <= lag(pe) OVER (PARTITION BY project_slug, source_slug ORDER BY first_index) THEN 0 ELSE 1 END AS opens FROM padded),
grouped AS (SELECT *, SUM(opens) OVER (PARTITION BY project_slug, source_slug ORDER BY first_index) AS g FROM opened)
SELECT project_slug, source_slug, round(arg_min(ps, first_index) * 100) / 100 AS start,
  CASE WHEN COUNT(*) = 1 THEN round(arg_max(pe, first_index) * 100) / 100 ELSE arg_max(pe, first_index) END AS "end" FROM grouped GROUP BY project_slug, source_slug, g""",
    "silence_summary": with_(WORDS, UTTERANCES, DURATIONS)
    + """ SELECT project_slug, source_slug, COUNT(g) AS gaps_removed, COALESCE(SUM(round(g * 10)::BIGINT), 0)::BIGINT / 10.0::DOUBLE AS time_saved_seconds,
  round(duration_seconds * 100) / 100 AS original_duration_seconds
FROM durations LEFT JOIN (SELECT project_slug, source_slug, round(gap * 10) / 10 AS g FROM gapped WHERE gap >= 0.4 AND round(gap * 10) / 10 >= 0.6) USING (project_slug, source_slug)
GROUP BY project_slug, source_slug, duration_seconds""",
    "word_flags": _flags_sql("word", "SELECT project_slug, source_slug, word_index, word, start, \"end\", reason FROM flagged WHERE reason IS NOT NULL"),
    "word_flags_normalized": _flags_sql(
        _NORMALIZED, "SELECT project_slug, source_slug, word_index, word, start, \"end\", reason FROM flagged WHERE reason IS NOT NULL"
    ),
    "word_context": _flags_sql("word", "SELECT project_slug, source_slug, word_index, context FROM flagged WHERE reason IS NOT NULL"),
    "endtime_repair": with_(WORDS)
    + """, damaged AS (SELECT project_slug, source_slug, word_index, start_time, CASE WHEN word_index % 5 = 0 THEN 0.0::DOUBLE WHEN word_index % 7 = 0 THEN end_time + 3.0::DOUBLE ELSE end_time END AS e FROM words),
n AS (SELECT *, lead(start_time) OVER (PARTITION BY project_slug, source_slug ORDER BY word_index) AS ns FROM damaged)
SELECT project_slug, source_slug, word_index, start_time, CASE WHEN e <= start_time THEN greatest(COALESCE(ns, start_time + 0.3::DOUBLE), start_time + 0.01::DOUBLE)
  WHEN e > ns + 0.5::DOUBLE THEN ns ELSE e END AS end_time FROM n""",
    "chunk_stitch": with_(WORDS)
    + """, own AS (SELECT *, floor(start_time / 20.0::DOUBLE)::BIGINT AS o FROM words),
ch AS (SELECT *, o AS chunk_index FROM own UNION ALL SELECT *, o - 1 FROM own WHERE start_time - o * 20.0::DOUBLE < 5.0 AND o > 0),
loc AS (SELECT project_slug, source_slug, chunk_index, word_index, word, start_time - chunk_index * 20.0::DOUBLE AS ls, end_time - chunk_index * 20.0::DOUBLE AS le,
  chunk_index * 20.0::DOUBLE AS off, CASE WHEN chunk_index % 3 = 1 THEN 55.0::DOUBLE ELSE 24.0::DOUBLE END AS dur,
  COUNT(DISTINCT chunk_index) OVER (PARTITION BY project_slug, source_slug) AS nc FROM ch),
placed AS (SELECT *, ls + off AS s, CASE WHEN nc = 1 THEN le WHEN least(le, dur) > ls THEN least(le, dur) ELSE ls + 0.3::DOUBLE END + off AS e FROM loc WHERE nc = 1 OR ls <= dur + 1.0),
per AS (SELECT project_slug, source_slug, chunk_index, list({'s': s, 'e': e} ORDER BY word_index) AS ws, row_number() OVER (PARTITION BY project_slug, source_slug ORDER BY chunk_index) AS rn
  FROM placed GROUP BY project_slug, source_slug, chunk_index),
walk AS (SELECT project_slug, source_slug, chunk_index, rn, ws, NULL::DOUBLE AS cutoff FROM per WHERE rn = 1
  UNION ALL SELECT p.project_slug, p.source_slug, p.chunk_index, p.rn, p.ws,
    COALESCE(list_filter(w.ws, lambda r: w.chunk_index = 0 OR w.cutoff IS NULL OR r.s >= w.cutoff)[-1].e, w.cutoff)
  FROM walk w JOIN per p ON p.project_slug = w.project_slug AND p.source_slug = w.source_slug AND p.rn = w.rn + 1)
SELECT project_slug, source_slug, chunk_index, word_index, word, s AS start_time, e AS end_time FROM placed JOIN walk USING (project_slug, source_slug, chunk_index)
WHERE chunk_index = 0 OR cutoff IS NULL OR s >= cutoff""",
    "transcript_rollup": with_(WORDS)
    + """, r AS (SELECT project_slug, source_slug, COUNT(*) AS word_count, arg_max(greatest(end_time, start_time), word_index) AS duration_seconds FROM words GROUP BY ALL)
SELECT *, CASE WHEN duration_seconds <= 55 THEN 'sync' ELSE 'chunked-sync (' || ceil(duration_seconds / 50.0)::BIGINT || ' chunks)' END AS mode FROM r""",
    "transcript_text": with_(WORDS)
    + " SELECT project_slug, source_slug, word_index // 100 AS part, string_agg(word, ' ' ORDER BY word_index) AS full_text FROM words GROUP BY ALL",
}
