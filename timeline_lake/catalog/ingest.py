"""Source, sink and document queries and their SQL. Documents are rows Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeline_lake.catalog.sql import ASSETS, DURATIONS, PROJECTS, RENDERS, UTTERANCES, WORDS, with_
from timeline_lake.catalog.warehouse import ASSET_KEY, SOURCE_KEY, _presets
from timeline_lake.operators import keyed as K
from timeline_lake.plans import transcripts as T
from timeline_lake.plans import views as V
from timeline_lake.sources import documents as D
from timeline_lake.sources import presets as P
from timeline_lake.sources import tables as S
from timeline_lake.streaming import runs


def _number(column: str) -> Column:
    return F.regexp_extract(column, "([0-9]+)$", 1).cast("long")


def scan_tables(spark: SparkSession, folder: str) -> DataFrame:
    raw = V.assets(spark, folder).withColumn("has_audio", F.when(_number("slug") % 10 > 0, F.col("has_audio").cast("int")))
    raw = raw.withColumn("tags_json", F.when(_number("slug") % 7 == 0, F.lit("not a list")).otherwise(F.col("tags_json")))
    return S.decode(raw).select(*ASSET_KEY, "duration_seconds", "has_audio", F.array_join("tags", "|").alias("tags"))


def scan_warehouse(spark: SparkSession, folder: str) -> DataFrame:
    """All eight tables written as they are stored, range-partitioned by key, and read through their declared schemas."""
    words = V.words(spark, folder).select(*SOURCE_KEY, "word_index", "word", "start_time", "end_time", "confidence")
    renders = V.renders(spark, folder).withColumn("spec_json", F.concat(F.lit('{"of":"'), "slug", F.lit('"}')))
    old = F.lit("2024-01-01").cast("timestamp")
    stored = {
        "projects": V.projects(spark, folder).withColumn("tags_json", F.when(_number("slug") % 3 > 0, F.concat(F.lit('["t'), _number("slug"), F.lit('"]')))),
        "assets": V.assets(spark, folder).withColumn("has_audio", F.when(_number("slug") % 10 > 0, F.col("has_audio").cast("int"))),
        "transcripts": words.groupBy(*SOURCE_KEY).agg(F.count(F.lit(1)).cast("int").alias("word_count"), F.max("end_time").alias("duration_seconds")).withColumns(
            {"source_path": F.concat(F.lit("/media/"), "source_slug"), "language": F.lit("en"), "mode": F.lit("words"), "full_text": F.lit(""), "created": old}),
        "transcript_words": words,
        "analyses": words.select(*SOURCE_KEY).distinct().withColumns(
            {"source_path": F.concat(F.lit("/media/"), "source_slug"), "status": F.lit("new"), "sample_fps": F.lit(1.0), "frame_count": F.lit(0), "scene_count": F.lit(0),
             "duration_seconds": F.lit(0.0), "frames_dir": F.concat(F.lit("/frames/"), "source_slug"), "created": old}),
        "scenes": V.turns(spark, folder).withColumns({"description": F.lit("turn"), "tags_json": F.lit("broken"), "scene_type": F.lit(None).cast("string")}),
        "renders": renders,
        "presets": _presets(spark, folder),
    }
    shown = {
        "projects": ["slug", "name", F.array_join("tags", "|")], "assets": ["slug", "has_audio", F.array_join("tags", "|")], "transcripts": [*SOURCE_KEY, "word_count"],
        "transcript_words": [*SOURCE_KEY, "word_index", "word"], "analyses": [*SOURCE_KEY, "frames_dir"], "scenes": [*SOURCE_KEY, "scene_index", F.coalesce(F.array_join("tags", "|"), F.lit("none"))],
        "renders": ["slug", F.array_join("sources", "|"), "spec_json"], "presets": ["name", "config_json"],
    }
    keys = {"projects": ["slug"], "assets": ASSET_KEY, "renders": ASSET_KEY, "presets": ["name"], "transcript_words": [*SOURCE_KEY, "word_index"], "scenes": [*SOURCE_KEY, "scene_index"]}
    path = runs.work_folder(spark, "warehouse")
    result = None
    for name, df in stored.items():
        columns = [c.split()[0] for c in S.SCHEMAS[name].split(", ")]
        S.write_table(df.select(*[F.col(c).cast(S.column_type(name, c)) for c in columns]), path, name, keys.get(name, SOURCE_KEY))
        rows = S.read_table(spark, path, name).select(F.lit(name).alias("table_name"), F.concat_ws("/", *shown[name]).alias("shown"))
        result = rows if result is None else result.unionByName(rows)
    return result


def _project_files(spark: SparkSession, folder: str) -> DataFrame:
    """Project documents as (path, text): some unclosed, some without a header, quoted and folded values, tag lists."""
    k = F.col("c_custkey")
    description = F.when(F.pmod(k, F.lit(4)) == 0, F.lit("null")).when(F.pmod(k, F.lit(4)) == 1, F.concat(F.lit('"say \\"'), "c_mktsegment", F.lit('\\"\n  twice"'))).when(
        F.pmod(k, F.lit(4)) == 2, F.concat(F.lit("'it''s "), "c_mktsegment", F.lit("'"))
    ).otherwise(F.col("c_mktsegment"))
    tags = F.when(F.pmod(k, F.lit(3)) == 0, F.concat(F.lit("tags:\n- "), F.lower("c_mktsegment"), F.lit("\n- 'n "), k, F.lit("'\n"))).otherwise(F.lit(""))
    head = F.concat(
        F.lit("---\nslug: p"), k, F.lit("\nname: "), "c_name", F.lit("\nstatus: active\n"), tags, F.lit("description: "), description,
        F.lit("\nbalance: "), F.when(F.pmod(k, F.lit(9)) == 5, F.lit("much")).otherwise(F.col("c_acctbal").cast("string")), F.lit("\n"),
    )
    text = (
        F.when(F.pmod(k, F.lit(20)) == 3, head)
        .when(F.pmod(k, F.lit(20)) == 4, F.concat(F.lit("\n"), head, F.lit("---\n")))
        .when(F.pmod(k, F.lit(2)) == 0, F.concat(head, F.lit("---\n\nBody of "), k, F.lit("\n---\nmore")))
        .otherwise(F.concat(head, F.lit("---\nBody of "), k))
    )
    return V.table(spark, folder, "customer").select(F.concat(F.lit("/data/projects/p"), k, F.lit("/project.md")).alias("path"), text.alias("text"))


def _tree(spark: SparkSession, folder: str) -> str:
    """A tree of files: project documents, and beside them the words and scenes of recordings."""
    path = runs.work_folder(spark, "tree")
    D.write_tree(_project_files(spark, folder).unionByName(_sidecars(spark, folder)).unionByName(_scene_sidecars(spark, folder)), path)
    return path


def front_matter_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Headers of the markdown files of a tree that is written first; other files are not opened."""
    read = D.front_matter(D.read_tree(spark, _tree(spark, folder), ".md"), {"slug": "string", "name": "string", "description": "string", "balance": "double"}, ["tags"])
    return read.withColumn("tags", F.array_join("tags", "|"))


def _sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """One words file per conversation turn, each a JSON array; every eleventh is cut short, every thirteenth has an element without a start."""
    t = V.table(spark, folder, "conversations")
    tokens = F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda x: x != "")
    items = F.transform(tokens, lambda w, i: F.struct(w.alias("word"), (i * 0.5).alias("start"), (i * 0.5 + 0.25).alias("end"), F.when(i % 2 == 0, F.lit(0.75)).alias("confidence")))
    json = F.to_json(items)
    return t.select(
        F.concat(F.lit("/data/projects/p"), F.pmod("conv_id", F.lit(5)), F.lit("/c"), "conv_id", F.lit("-t"), "turn", F.lit(".words.json")).alias("path"),
        F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(11)) == 0, F.substring(json, 1, 20))
        .when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(13)) == 0, F.concat(F.substring(json, 1, F.length(json) - 1), F.lit(',{"word":"x","start":"soon","end":1.0}]')))
        .otherwise(json).alias("text"),
    )


def _scene_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """One scenes file per conversation; every seventh has a scene without an end."""
    t = V.table(spark, folder, "conversations").filter("turn < 3")
    scene = F.struct(
        F.col("turn").alias("scene_index"), (F.col("turn") * 10.0).alias("start_time"),
        F.when((F.pmod("conv_id", F.lit(7)) != 3) | (F.col("turn") > 0), F.col("turn") * 10.0 + 9.5).alias("end_time"), F.lit("said by ").alias("description"),
        F.array("role").alias("tags"), F.when(F.col("turn") == 0, F.lit("opening")).alias("scene_type"),
    )
    listed = t.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(scene))).alias("text"))  # three at most
    return listed.select(F.concat(F.lit("/data/projects/p"), F.pmod("conv_id", F.lit(5)), F.lit("/c"), "conv_id", F.lit(".scenes.json")).alias("path"), "text")


def json_sidecar_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Words from the JSON files of a tree that is written first."""
    return D.words_sidecars(D.read_tree(spark, _tree(spark, folder), ".words.json"))


def scene_sidecar_scan(spark: SparkSession, folder: str) -> DataFrame:
    scenes = D.scenes_sidecars(D.read_tree(spark, _tree(spark, folder), ".scenes.json"))
    return scenes.withColumn("tags", F.array_join("tags", "|"))


def insert_or_ignore(spark: SparkSession, folder: str) -> DataFrame:
    """Half the conversations are known; the rest are imported, words only for those that were new."""
    words = V.words(spark, folder).select(*SOURCE_KEY, "word_index", "word")
    parents = words.select(*SOURCE_KEY).distinct().withColumn("origin", F.lit("import"))
    known = parents.filter(_number("source_slug") % 2 == 0).withColumn("origin", F.lit("kept"))
    _, inserted = K.insert_or_ignore(known, parents, SOURCE_KEY)
    return K.children_of(words, inserted, SOURCE_KEY)


def stt_response_ingest(spark: SparkSession, folder: str) -> DataFrame:
    return D.speech_words(_responses(spark, folder), ["conv_id", "turn"])


def _responses(spark: SparkSession, folder: str) -> DataFrame:
    """A recognition response per turn; offsets in all the forms such responses have."""
    tokens = F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda x: x != "")

    def quoted(c: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))

    def word(w: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit("")).when(i % 3 == 0, F.concat(F.lit('"startOffset":"'), i * 0.5, F.lit('s",'))).when(
            i % 3 == 1, F.concat(F.lit('"startOffset":{"seconds":'), F.floor(i * 0.5), F.lit(',"nanos":'), F.pmod(i, F.lit(2)) * 500000000, F.lit("},"))
        ).otherwise(F.concat(F.lit('"startOffset":'), i * 0.5, F.lit(",")))
        end = F.when(i % 4 > 0, F.concat(F.lit('"endOffset":"'), i * 0.5 + 0.25, F.lit('s",'))).otherwise(F.lit(""))
        return F.concat(F.lit("{"), start, end, F.lit('"word":'), quoted(w), F.when(i % 2 == 0, F.lit(',"confidence":0.5')).otherwise(F.lit("")), F.lit("}"))

    listed = F.concat(F.lit('"words":['), F.array_join(F.transform(tokens, word), ","), F.lit("]"))
    first = F.concat(F.lit('{"alternatives":[{"transcript":'), quoted(F.array_join(tokens, " ")), F.lit(","), listed, F.lit('},{"transcript":"second choice"}]}'))
    json = F.concat(F.lit('{"results":['), first, F.lit(',{"alternatives":[]},{"alternatives":[{"transcript":"tail"}]}]}'))
    return V.table(spark, folder, "conversations").select("conv_id", "turn", json.alias("json"))


def stt_response_text(spark: SparkSession, folder: str) -> DataFrame:
    return D.speech_text(_responses(spark, folder), ["conv_id", "turn"])


def _bodies(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    spec = F.concat(F.lit('{"id": '), k, F.lit(',\n  "p": "'), "o_orderpriority", F.lit('"}'))
    notes = F.when(F.pmod(k, F.lit(3)) == 0, F.concat(F.lit("Note "), k, F.lit("\nend"))).otherwise(F.lit(""))
    whole = D.render_document(F.concat(F.lit("r"), k), spec, notes)
    body = (
        F.when(F.pmod(k, F.lit(10)) == 7, F.concat(F.lit("only notes "), k, F.lit("  \n")))
        .when(F.pmod(k, F.lit(10)) == 8, F.concat(F.lit("# T\n```json\nnever closed "), k))
        .otherwise(whole)
    )
    return V.table(spark, folder, "orders").select(k.alias("render"), body.alias("body"))


def render_body_split(spark: SparkSession, folder: str) -> DataFrame:
    spec, notes = D.split_render_body("body")
    return _bodies(spark, folder).select("render", spec.alias("spec_json"), notes.alias("notes_md"))


def render_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return _bodies(spark, folder).select("render", F.md5("body").alias("body_md5"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    words = V.words(spark, folder)
    heads = words.select(*SOURCE_KEY).distinct().withColumn("source_path", F.concat(F.lit("/media/"), "project_slug", F.lit("/"), "source_slug", F.lit(".mp4")))
    return D.transcript_lines(T.compact_utterances(words), heads)


def transcript_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder)


def transcript_markdown_parse(spark: SparkSession, folder: str) -> DataFrame:
    return D.parse_transcript_lines(_lines(spark, folder))


def json_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Rows written as JSON files and read back."""
    path = runs.work_folder(spark, "json")
    rows = V.renders(spark, folder).select("project_slug", "slug", "duration_seconds", "file_size_bytes")
    D.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


def preset_seed(spark: SparkSession, folder: str) -> DataFrame:
    return K.upsert(_presets(spark, folder), P.built_in_presets(spark), ["name"]).select("name", "type", "description", "config_json")


def frame_sample_plan(spark: SparkSession, folder: str) -> DataFrame:
    return S.sample_instants(V.assets(spark, folder), 0.5)


def stt_chunk_plan(spark: SparkSession, folder: str) -> DataFrame:
    longer = V.assets(spark, folder).withColumn("duration_seconds", F.col("duration_seconds") * 4)
    return S.speech_chunks(longer)


QUERIES = {
    f.__name__: f
    for f in (
        scan_tables, scan_warehouse, front_matter_scan, json_sidecar_scan, scene_sidecar_scan, insert_or_ignore, stt_response_ingest, stt_response_text, render_body_split, transcript_markdown,
        transcript_markdown_parse, render_markdown, json_sink, preset_seed, frame_sample_plan, stt_chunk_plan,
    )
}

_TURN_TOKENS = """
tt AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS t FROM conversations),
tw AS (SELECT conv_id, turn, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS i FROM tt)"""
_LINES = """
lines AS (SELECT project_slug, source_slug, first_index, round(s * 10) / 10 AS s1, round(e * 10) / 10 AS e1, text FROM utt)"""
_BODY = """
parts AS (SELECT o_orderkey AS k, '{"id": ' || o_orderkey || ',' || chr(10) || '  "p": "' || o_orderpriority || '"}' AS spec,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Note ' || o_orderkey || chr(10) || 'end' ELSE '' END AS notes FROM orders)"""
_MIN = "floor({0} / 60)::BIGINT || ':' || printf('%05.2f', {0} - floor({0} / 60)::BIGINT * 60)"
# Fixed values, written out once more so that the SQL does not follow the code: the built-in presets.
_SEEDS = """
  ('tiktok', 'Bold centered captions for TikTok/Reels — yellow highlight, 3 words',
   '{"allCaps":true,"color":"#FFFFFF","fontFamily":"Arial","fontSize":5.5,"fontWeight":"bold","highlightColor":"#FFD700","position":70.0,"punctuation":true,"shadow":true,"wordsPerGroup":3}'),
  ('subtitle', 'Professional subtitle style — bottom-aligned, 6 words per group',
   '{"allCaps":false,"color":"#FFFFFF","fontFamily":"Helvetica","fontSize":4.5,"fontWeight":"medium","position":90.0,"punctuation":true,"shadow":true,"wordsPerGroup":6}'),
  ('minimal', 'Understated minimal captions — light font, no shadow',
   '{"allCaps":false,"color":"#FFFFFF","fontFamily":"Helvetica","fontSize":4.0,"fontWeight":"light","position":85.0,"punctuation":true,"shadow":false,"wordsPerGroup":4}'),
  ('bold_center', 'Bold centered captions — green highlight, 2 words per group',
   '{"allCaps":true,"color":"#FFFFFF","fontFamily":"Arial","fontSize":7.0,"fontWeight":"bold","highlightColor":"#00FF88","position":50.0,"punctuation":true,"shadow":true,"wordsPerGroup":2}'),
  ('william', 'Poppins bold, cream/burnt orange karaoke — 3 words, no punctuation',
   '{"allCaps":true,"color":"#FAF9F5","fontFamily":"Poppins","fontSize":5.5,"fontWeight":"bold","highlightColor":"#D97757","position":70.0,"punctuation":false,"shadow":true,"wordsPerGroup":3}'),
  ('social_karaoke_pink', 'Pink-highlight karaoke variant of william — Poppins bold, hot pink active word',
   '{"allCaps":true,"color":"#FAF9F5","fontFamily":"Poppins","fontSize":5.5,"fontWeight":"bold","highlightColor":"#FF3EA5","position":70.0,"punctuation":false,"shadow":true,"wordsPerGroup":3}'),
  ('social_karaoke_white', 'Monochrome karaoke — white Poppins bold, no colored highlight',
   '{"allCaps":true,"color":"#AAAAAA","fontFamily":"Poppins","fontSize":5.5,"fontWeight":"bold","highlightColor":"#FFFFFF","position":70.0,"punctuation":false,"shadow":true,"wordsPerGroup":3}'),
  ('interview_attribution', 'Understated interview captions — bottom, Helvetica medium, 8 words',
   '{"allCaps":false,"color":"#FFFFFF","fontFamily":"Helvetica","fontSize":4.0,"fontWeight":"medium","position":90.0,"punctuation":true,"shadow":true,"wordsPerGroup":8}'),
  ('podcast_big', 'Oversized podcast captions — centered black Helvetica, yellow highlight, 2 words',
   '{"allCaps":true,"color":"#FFFFFF","fontFamily":"Helvetica","fontSize":10.0,"fontWeight":"black","highlightColor":"#FFE135","position":50.0,"punctuation":false,"shadow":true,"wordsPerGroup":2}'),
  ('slideshow_serif', 'Clean serif lower-third — Georgia regular, 7 words per group',
   '{"allCaps":false,"color":"#FFFFFF","fontFamily":"Georgia","fontSize":4.5,"fontWeight":"regular","position":88.0,"punctuation":true,"shadow":true,"wordsPerGroup":7}'),
  ('screencast_clean', 'Low-distraction screencast captions — Helvetica medium at 92% height, 8 words',
   '{"allCaps":false,"color":"#FFFFFF","fontFamily":"Helvetica","fontSize":4.0,"fontWeight":"medium","position":92.0,"punctuation":true,"shadow":true,"wordsPerGroup":8}')"""

ORACLES = {
    "scan_tables": with_(ASSETS) + """ SELECT project_slug, slug, duration_seconds, CASE WHEN p_partkey % 10 = 0 THEN true ELSE has_audio END AS has_audio,
  CASE WHEN p_partkey % 7 <> 0 THEN array_to_string(from_json(tags_json, '["VARCHAR"]'), '|') END AS tags FROM assets""",
    "scan_warehouse": with_(WORDS, ASSETS, PROJECTS, RENDERS) + """, sources AS (SELECT DISTINCT project_slug, source_slug FROM words)
SELECT 'projects' AS table_name, concat_ws('/', slug, name, CASE WHEN substr(slug, 2)::BIGINT % 3 > 0 THEN 't' || substr(slug, 2) END) AS shown FROM projects
UNION ALL SELECT 'assets', concat_ws('/', slug, CASE WHEN p_partkey % 10 = 0 OR has_audio THEN 'true' ELSE 'false' END, replace(replace(replace(replace(tags_json, '["', ''), '"]', ''), '","', '|'), '"', '')) FROM assets
UNION ALL SELECT 'transcripts', concat_ws('/', project_slug, source_slug, COUNT(*)) FROM words GROUP BY project_slug, source_slug
UNION ALL SELECT 'transcript_words', concat_ws('/', project_slug, source_slug, word_index, word) FROM words
UNION ALL SELECT 'analyses', concat_ws('/', project_slug, source_slug, '/frames/' || source_slug) FROM sources
UNION ALL SELECT 'scenes', concat_ws('/', project_slug, source_slug, turn, 'none') FROM (SELECT DISTINCT project_slug, source_slug, turn FROM words)
UNION ALL SELECT 'renders', concat_ws('/', slug, 'c' || (substr(slug, 2)::BIGINT % 100) || '|c' || ((substr(slug, 2)::BIGINT * 7) % 100), '{"of":"' || slug || '"}') FROM renders
UNION ALL SELECT 'presets', lower(p_brand) || '-' || lower(p_type) || '/{"wordsPerGroup":' || MAX(p_size) || '}' FROM part GROUP BY lower(p_brand) || '-' || lower(p_type)""",
    "front_matter_scan": """SELECT '/data/projects/p' || c_custkey || '/project.md' AS path, 'p' || c_custkey AS slug, c_name AS name,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'say "' || c_mktsegment || '" twice' WHEN 2 THEN 'it''s ' || c_mktsegment ELSE c_mktsegment END AS description,
  CASE WHEN c_custkey % 9 <> 5 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) || '|n ' || c_custkey END AS tags,
  'Body of ' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || '---' || chr(10) || 'more' ELSE '' END AS body FROM customer WHERE c_custkey % 20 NOT IN (3, 4)""",
    "json_sidecar_scan": with_(_TURN_TOKENS) + """ SELECT 'p' || (conv_id % 5) AS project_slug, 'c' || conv_id || '-t' || turn AS source_slug, i AS word_index, word, i * 0.5::DOUBLE AS start_time, i * 0.5::DOUBLE + 0.25::DOUBLE AS end_time,
  CASE WHEN i % 2 = 0 THEN 0.75::DOUBLE END AS confidence FROM tw WHERE (conv_id + turn) % 11 <> 0 AND (conv_id + turn) % 13 <> 0""",
    "scene_sidecar_scan": """SELECT 'p' || (conv_id % 5) AS project_slug, 'c' || conv_id AS source_slug, turn AS scene_index, turn * 10.0::DOUBLE AS start_time, turn * 10.0::DOUBLE + 9.5::DOUBLE AS end_time,
  'said by ' AS description, role AS tags, CASE WHEN turn = 0 THEN 'opening' END AS scene_type FROM conversations WHERE turn < 3 AND conv_id % 7 <> 3""",
    "insert_or_ignore": with_(WORDS) + " SELECT project_slug, source_slug, word_index, word FROM words WHERE substr(source_slug, 2)::BIGINT % 2 = 1",
    "stt_response_ingest": with_(_TURN_TOKENS) + """ SELECT conv_id, turn, i AS word_index, word, i * 0.5::DOUBLE AS start_time, CASE WHEN i % 4 > 0 THEN i * 0.5::DOUBLE + 0.25::DOUBLE ELSE 0.0::DOUBLE END AS end_time,
  CASE WHEN i % 2 = 0 THEN 0.5::DOUBLE END AS confidence FROM tw""",
    "stt_response_text": with_(_TURN_TOKENS) + " SELECT conv_id, turn, array_to_string(t, ' ') || ' tail' AS full_text FROM tt",
    "render_body_split": with_(_BODY) + """ SELECT k AS render, CASE WHEN k % 10 IN (7, 8) THEN NULL ELSE spec END AS spec_json,
  CASE k % 10 WHEN 7 THEN 'only notes ' || k WHEN 8 THEN '# T' || chr(10) || '```json' || chr(10) || 'never closed ' || k ELSE notes END AS notes_md FROM parts""",
    "render_markdown": with_(_BODY) + """ SELECT k AS render, md5(CASE k % 10 WHEN 7 THEN 'only notes ' || k || '  ' || chr(10) WHEN 8 THEN '# T' || chr(10) || '```json' || chr(10) || 'never closed ' || k
  ELSE '# Render: r' || k || chr(10) || chr(10) || '## RenderSpec' || chr(10) || chr(10) || '```json' || chr(10) || spec || chr(10) || '```' || CASE WHEN notes <> '' THEN chr(10) || chr(10) || '## Notes' || chr(10) || chr(10) || notes ELSE '' END || chr(10) END) AS body_md5 FROM parts""",
    "transcript_markdown": with_(WORDS, UTTERANCES, _LINES) + f""" SELECT project_slug, source_slug, first_index AS line_no, '- [' || {_MIN.format('s1')} || ' – ' || {_MIN.format('e1')} || '] ' || text AS line FROM lines
UNION ALL SELECT DISTINCT project_slug, source_slug, -2, '# Transcript: ' || source_slug || '.mp4' FROM words UNION ALL SELECT DISTINCT project_slug, source_slug, -1, '' FROM words""",
    "transcript_markdown_parse": with_(WORDS, UTTERANCES, _LINES) + f""", pr AS (SELECT project_slug, source_slug, first_index AS line_no, floor(s1 / 60) * 60 + printf('%05.2f', s1 - floor(s1 / 60) * 60)::DOUBLE AS start,
  floor(e1 / 60) * 60 + printf('%05.2f', e1 - floor(e1 / 60) * 60)::DOUBLE AS "end", text FROM lines),
pg AS (SELECT *, start - lag("end") OVER (PARTITION BY project_slug, source_slug ORDER BY line_no) AS g FROM pr)
SELECT project_slug, source_slug, line_no, CASE WHEN g >= 0.4 THEN round(g * 10) / 10 END AS gap_before, start, "end", text FROM pg""",
    "json_sink": with_(RENDERS) + " SELECT project_slug, slug, duration_seconds, file_size_bytes FROM renders",
    "preset_seed": """SELECT lower(p_brand) || '-' || lower(p_type) AS name, 'caption' AS type, MIN(p_name) AS description, '{"wordsPerGroup":' || MAX(p_size) || '}' AS config_json FROM part GROUP BY 1
UNION ALL SELECT n, 'caption', d, c FROM (VALUES """ + _SEEDS + ") v(n, d, c)",
    "frame_sample_plan": with_(ASSETS) + """, f AS (SELECT project_slug, slug, duration_seconds AS d, unnest(range(0, greatest(ceil(duration_seconds * 0.5::DOUBLE)::BIGINT, 1))) AS i FROM assets)
SELECT project_slug, slug, i AS frame_index, round(i / 0.5::DOUBLE * 10) / 10.0::DOUBLE AS time, printf('frame_%04d.jpg', i) AS filename FROM f WHERE i / 0.5::DOUBLE < d""",
    "stt_chunk_plan": with_(ASSETS) + """, f AS (SELECT project_slug, slug, duration_seconds * 4 AS d, unnest(range(0, CASE WHEN duration_seconds * 4 <= 55 THEN 1 ELSE ceil(duration_seconds * 4 / 50.0::DOUBLE)::BIGINT END)) AS i FROM assets)
SELECT project_slug, slug, i AS chunk_index, i * 50.0::DOUBLE AS "offset", least(55.0::DOUBLE, d - i * 50.0::DOUBLE) AS length FROM f WHERE i = 0 OR d - i * 50.0::DOUBLE >= 2""",
}
