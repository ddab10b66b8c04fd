"""Streaming queries: the given tables (or files Spark writes from them) are read as streams and run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeline_lake.catalog.sql import USAGE, WORDS, with_
from timeline_lake.plans import views as V
from timeline_lake.streaming import runs, search, telemetry, transcripts, usage

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
#: The day recordings are taken to begin, in milliseconds: event times have to lie after the first watermark, which is 1970.
SAID_ON_MS = 946_684_800_000
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    schema = ", ".join(f"{name} {kind}" for name, kind in V.table(spark, folder, "events").dtypes)
    return runs.file_stream(spark, folder, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _payloads_of(events: DataFrame) -> DataFrame:
    """Telemetry payloads as JSON: five in a hundred events repeat the render before, one in fifty lacks its id."""
    event, user = F.col("event_id"), F.col("user_id")
    number = event - F.when(F.pmod(event, F.lit(100)) < 5, F.lit(1)).otherwise(F.lit(0))
    render = F.when(F.pmod(event, F.lit(50)) != 49, F.concat(F.lit("u"), number))
    body = F.struct(
        render.alias("render_id"), F.concat(F.lit("p"), F.pmod(user, F.lit(5))).alias("project"), F.col("event_type").alias("codec"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("finished_at"), (F.floor(F.col("value") * 4) / F.lit(4.0)).alias("output_duration_seconds"),
        F.pmod(event, F.lit(60)).cast("double").alias("fps"), F.create_map(F.lit("wall_seconds"), F.floor("value") * 1.0).alias("timing"),
    )
    return events.select("event_id", F.to_json(body).alias("json"))


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    return _payloads_of(_events(spark, folder)).select("json")


def _payload_files(spark: SparkSession, folder: str) -> str:
    """The payloads as files of JSON lines; one line in 151 is cut short, as a crash would leave it."""
    made = _payloads_of(V.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    line = F.when(F.pmod("event_id", F.lit(151)) == 3, F.substring("json", 1, 25)).otherwise(F.col("json"))
    path = runs.work_folder(spark, "payloads")
    made.select(line.alias("value")).repartition(6).write.text(path)
    return path


def telemetry_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Facts from files of JSON lines, read two files at a time; finished files are archived."""
    path = _payload_files(spark, folder)
    lines = telemetry.payload_lines(spark, path, files_per_batch=2, archive=f"{path}-done")
    facts = runs.collect_stream(telemetry.unique_facts(lines, "2000 days"), "facts")
    return facts.groupBy("render_id").agg(F.count(F.lit(1)).alias("n"))


def telemetry_rejects(spark: SparkSession, folder: str) -> DataFrame:
    bad = runs.collect_stream(telemetry.rejects(telemetry.payload_lines(spark, _payload_files(spark, folder), files_per_batch=2)), "rejects")
    parsed = F.from_json("json", "project string, fps double")
    whole = F.col("reason") != "broken line"
    return bad.select("reason", F.when(whole, parsed["project"]).alias("project"), F.when(whole, parsed["fps"]).alias("fps"), F.when(~whole, F.col("json")).alias("line"))


def _all_facts(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.render_facts(_payloads(spark, folder)).filter(~F.col("bad"))


def telemetry_windows(spark: SparkSession, folder: str) -> DataFrame:
    return runs.collect_stream(telemetry.windowed_counts(_all_facts(spark, folder), "1 hour"), "windows")


def telemetry_sliding_windows(spark: SparkSession, folder: str) -> DataFrame:
    return runs.collect_stream(telemetry.windowed_counts(_all_facts(spark, folder), "6 hours", "2 hours"), "sliding")


def utterance_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The words table is written once and read as a stream; a last row a day later closes every utterance."""
    words = V.words(spark, folder).select(
        "project_slug", "source_slug", "word_index", "word",
        F.timestamp_millis(F.round(F.col("start_time") * 1000).cast("long") + SAID_ON_MS).alias("spoken_from"),
        F.timestamp_millis(F.round(F.col("end_time") * 1000).cast("long") + SAID_ON_MS).alias("spoken_until"),
    )
    path = runs.work_folder(spark, "words")
    closing = words.groupBy().agg((F.max("spoken_from") + F.expr("interval 1 day")).alias("spoken_from")).select(
        F.lit("end").alias("project_slug"), F.lit("end").alias("source_slug"), F.lit(0).cast("long").alias("word_index"),
        F.lit("").alias("word"), "spoken_from", F.col("spoken_from").alias("spoken_until"),
    )
    words.unionByName(closing).write.parquet(path)
    schema = ", ".join(f"{name} {kind}" for name, kind in words.dtypes)
    parts = runs.collect_stream(transcripts.utterance_parts(runs.file_stream(spark, path, schema), part_words=16), "utterances")
    said = transcripts.joined_parts(parts)
    return said.select(
        "project_slug", "source_slug", "first_index", "n_words", "text",
        F.expr(f"from_us div 1000 - {SAID_ON_MS}").alias("from_ms"), F.expr(f"until_us div 1000 - {SAID_ON_MS}").alias("until_ms"),
    )


def fts_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Documents arrive, then a third of them again: a sixth with the text cut to its language code, a sixth deleted."""
    base = V.table(spark, folder, "documents").select(
        F.col("lang").alias("project_slug"), F.concat(F.lit("d"), "doc_id").alias("source_slug"), F.col("text").alias("full_text"), "doc_id", "lang"
    )
    rest = F.pmod("doc_id", F.lit(6))
    again = base.filter(rest < 2).withColumn("full_text", F.when(rest == 0, F.concat(F.lit("changed "), "lang")))
    path = runs.work_folder(spark, "documents")
    columns = ["project_slug", "source_slug", "full_text"]
    base.select(*columns, F.lit(0).cast("long").alias("changed_at")).write.parquet(f"{path}/in")
    schema = "project_slug string, source_slug string, full_text string, changed_at bigint"
    follow = lambda: search.follow(runs.file_stream(spark, f"{path}/in", schema), f"{path}/index", f"{path}/checkpoint", stemmed=False)
    follow()
    again.select(*columns, F.lit(1).cast("long").alias("changed_at")).write.mode("append").parquet(f"{path}/in")
    follow()
    return search.current_index(spark, f"{path}/index").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


def quota_stream(spark: SparkSession, folder: str) -> DataFrame:
    return runs.collect_stream(usage.decisions(V.usage_of(_events(spark, folder))), "quota")


QUERIES = {
    f.__name__: f
    for f in (telemetry_stream, telemetry_rejects, telemetry_windows, telemetry_sliding_windows, utterance_stream, fts_stream, quota_stream)
}

_FACTS = """
facts AS (SELECT 'u' || (event_id - CASE WHEN event_id % 100 < 5 THEN 1 ELSE 0 END) AS render_id, 'p' || (user_id % 5) AS project, event_type AS codec, date_trunc('second', ts) AS finished_at,
  floor(value * 4) / 4.0::DOUBLE AS secs, (event_id % 60)::DOUBLE AS fps FROM events WHERE event_id % 50 <> 49)"""
WALK = """
reqs AS (SELECT *, duration_seconds / 60.0::DOUBLE AS minutes, CASE WHEN isfinite(duration_seconds) AND duration_seconds > 0 THEN CAST(round(duration_seconds * 1000) AS BIGINT) END AS ms,
  row_number() OVER (PARTITION BY uid ORDER BY ts, request_id) AS rn FROM usage),
taken AS (SELECT uid, MIN(rn) AS rn, arg_min(ms, rn) AS used FROM reqs WHERE tier = 'free' AND ms <= 5400000 GROUP BY uid
  UNION ALL SELECT t.uid, MIN(r.rn), arg_min(t.used + r.ms, r.rn) FROM taken t JOIN reqs r ON r.uid = t.uid AND r.rn > t.rn AND r.ms <= 5400000 - t.used GROUP BY t.uid),
walk AS (SELECT r.uid, r.request_id, r.minutes, ms IS NOT NULL AND (tier <> 'free' OR t.rn IS NOT NULL) AS accepted,
  CASE WHEN ms IS NULL THEN 'missing_duration' WHEN tier = 'free' AND t.rn IS NULL THEN 'quota_exceeded' END AS reason FROM reqs r LEFT JOIN taken t ON t.uid = r.uid AND t.rn = r.rn)"""


def _windows_sql(length: int, slide: int) -> str:
    hours = length // slide
    return with_(_FACTS) + f""", w AS (SELECT *, to_timestamp((floor(epoch(finished_at) / {slide * 3600})::BIGINT - i) * {slide * 3600})::TIMESTAMP AS window_start FROM facts, range(0, {hours}) r(i))
SELECT window_start, window_start + INTERVAL {length} HOUR AS window_end, project, codec, COUNT(*) AS renders, SUM(secs) AS seconds, SUM(fps) / COUNT(*) AS mean_fps FROM w
GROUP BY window_start, project, codec HAVING window_start + INTERVAL {length} HOUR <= (SELECT MAX(finished_at) - INTERVAL 10 MINUTE FROM facts)"""


ORACLES = {
    "telemetry_stream": """SELECT DISTINCT 'u' || (event_id - CASE WHEN event_id % 100 < 5 THEN 1 ELSE 0 END) AS render_id, 1 AS n FROM events WHERE event_id % 50 <> 49 AND event_id % 151 <> 3""",
    "telemetry_rejects": """SELECT CASE WHEN event_id % 151 = 3 THEN 'broken line' ELSE 'no id or time' END AS reason, CASE WHEN event_id % 151 <> 3 THEN 'p' || (user_id % 5) END AS project,
  CASE WHEN event_id % 151 <> 3 THEN (event_id % 60)::DOUBLE END AS fps,
  CASE WHEN event_id % 151 = 3 THEN left(CASE WHEN event_id % 50 <> 49 THEN '{"render_id":"u' || (event_id - CASE WHEN event_id % 100 < 5 THEN 1 ELSE 0 END) || '",' ELSE '{' END
    || '"project":"p' || (user_id % 5) || '","codec":"' || event_type || '"', 25) END AS line
FROM events WHERE event_id % 50 = 49 OR event_id % 151 = 3""",
    "telemetry_windows": _windows_sql(1, 1),
    "telemetry_sliding_windows": _windows_sql(6, 2),
    "utterance_stream": with_(WORDS) + """, wm AS (SELECT project_slug, source_slug, word_index, word, round(start_time * 1000)::BIGINT AS s, round(end_time * 1000)::BIGINT AS e FROM words),
g AS (SELECT *, s - lag(e) OVER (PARTITION BY project_slug, source_slug ORDER BY word_index) AS gap FROM wm),
r AS (SELECT *, SUM(CASE WHEN gap IS NULL OR gap >= 400 THEN 1 ELSE 0 END) OVER (PARTITION BY project_slug, source_slug ORDER BY word_index) AS run FROM g)
SELECT project_slug, source_slug, MIN(word_index) AS first_index, COUNT(*) AS n_words, MIN(s) AS from_ms, MAX(e) AS until_ms, string_agg(word, ' ' ORDER BY word_index) AS text FROM r GROUP BY project_slug, source_slug, run""",
    "fts_stream": """WITH now AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'changed ' || lang ELSE text END AS t FROM documents WHERE doc_id % 6 <> 1),
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(strip_accents(t)), '[\\p{L}\\p{N}]+')) AS term FROM now)
SELECT term, COUNT(DISTINCT doc_id) AS df, COUNT(*) AS occurrences FROM tok GROUP BY term""",
    "quota_stream": with_(USAGE, WALK) + " SELECT * FROM walk",
}
