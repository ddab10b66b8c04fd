"""Keyed-table queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeline_lake.catalog.sql import ASSETS, PROJECTS, RENDERS, WORDS, with_
from timeline_lake.functions import text as X
from timeline_lake.operators import keyed as K
from timeline_lake.plans import views as V
from timeline_lake.session import cut_lineage
from timeline_lake.sources import versions
from timeline_lake.streaming import runs

ASSET_KEY = ["project_slug", "slug"]
SOURCE_KEY = ["project_slug", "source_slug"]
NOW = "2024-06-01 00:00:00"


def _number(column: str) -> Column:
    return F.regexp_extract(column, "([0-9]+)$", 1).cast("long")


def _later() -> Column:
    return F.lit(NOW).cast("timestamp")


def _assets(spark: SparkSession, folder: str) -> DataFrame:
    return V.assets(spark, folder).drop("tags_json")


def _asset_batch(assets: DataFrame) -> DataFrame:
    """Every third asset comes again, changed, some of them twice; every seventh under a new slug. ``nth`` tells the order."""
    n = _number("slug")
    changed = assets.withColumns({"filename": F.concat(F.lit("v2 "), "filename"), "duration_seconds": F.when(F.pmod(n, F.lit(2)) == 0, F.col("duration_seconds") + 1.0), "has_audio": F.lit(False), "created": _later()})
    again = changed.filter(F.pmod(n, F.lit(3)) == 0)
    new = changed.filter(F.pmod(n, F.lit(7)) == 0).withColumn("slug", F.concat(F.lit("n"), "slug"))
    batch = again.unionByName(new).withColumn("nth", F.lit(1))
    earlier = batch.filter(F.pmod(n, F.lit(2)) == 1).withColumns({"filename": F.lit("zz superseded"), "nth": F.lit(0), "created": _later() - F.expr("interval 1 day")})
    return batch.unionByName(earlier)


def upsert_assets(spark: SparkSession, folder: str) -> DataFrame:
    assets = _assets(spark, folder)
    return K.upsert(assets, _asset_batch(assets), ASSET_KEY, order="nth")


def upsert_renders(spark: SparkSession, folder: str) -> DataFrame:
    renders = V.renders(spark, folder)
    batch = renders.filter(F.pmod(_number("slug"), F.lit(4)) == 1).withColumns({"status": F.lit("completed"), "notes_md": F.lit("again"), "created": _later()})
    return K.upsert(renders, batch, ASSET_KEY)


def _presets(spark: SparkSession, folder: str) -> DataFrame:
    """One preset per brand and part type."""
    part = V.table(spark, folder, "part")
    return part.groupBy(F.concat_ws("-", F.lower("p_brand"), F.lower("p_type")).alias("name")).agg(
        F.lit("caption").alias("type"), F.min("p_name").alias("description"), F.concat(F.lit('{"wordsPerGroup":'), F.max("p_size"), F.lit("}")).alias("config_json"),
    ).withColumns({"created": F.lit("2024-01-01").cast("timestamp"), "updated": F.lit("2024-01-01").cast("timestamp")})


def upsert_presets(spark: SparkSession, folder: str) -> DataFrame:
    presets = _presets(spark, folder)
    batch = presets.filter(F.col("name").endswith("promo")).withColumn("config_json", F.lit("{}")).withColumn("created", _later())
    return K.upsert(presets, batch, ["name"], always={"updated": _later()})


def _analyses(spark: SparkSession, folder: str) -> DataFrame:
    """One analysis per conversation, not yet scanned for scenes."""
    conversations = V.table(spark, folder, "conversations")
    key = F.col("conv_id")
    return conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("frame_count")).select(
        F.concat(F.lit("p"), F.pmod(key, F.lit(5))).alias("project_slug"), F.concat(F.lit("c"), key).alias("source_slug"),
        F.concat(F.lit("/media/"), key).alias("source_path"), F.lit("extracted").alias("status"), F.lit(1.0).alias("sample_fps"), "frame_count",
        F.lit(0).cast("long").alias("scene_count"), (F.pmod(key, F.lit(90)) * 1.0).alias("duration_seconds"), F.concat(F.lit("/frames/"), key).alias("frames_dir"),
        F.lit("2024-01-01").cast("timestamp").alias("created"),
    )


def upsert_analyses(spark: SparkSession, folder: str) -> DataFrame:
    analyses = _analyses(spark, folder)
    n = _number("source_slug")
    batch = analyses.filter(F.pmod(n, F.lit(3)) == 0).withColumns(
        {"source_slug": F.when(F.pmod(n, F.lit(2)) == 0, F.concat(F.lit("x"), "source_slug")).otherwise(F.col("source_slug")),
         "sample_fps": F.lit(2.0), "status": F.lit("new"), "scene_count": F.lit(9).cast("long"), "frames_dir": F.concat(F.lit("/new"), "frames_dir"), "created": _later()})
    return K.upsert(analyses, batch, SOURCE_KEY, update=["source_path", "sample_fps", "frame_count", "duration_seconds", "frames_dir"])


def _transcripts(spark: SparkSession, folder: str) -> DataFrame:
    words = V.words(spark, folder)
    return words.groupBy(*SOURCE_KEY).agg(F.count(F.lit(1)).alias("word_count"), F.max("end_time").alias("duration_seconds")).withColumn("created", F.lit("2024-01-01").cast("timestamp"))


def upsert_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    transcripts = _transcripts(spark, folder)
    batch = transcripts.filter(F.pmod(_number("source_slug"), F.lit(2)) == 0).withColumns({"word_count": F.col("word_count") + 1, "created": _later()})
    return K.upsert(transcripts, batch, SOURCE_KEY, update=["word_count", "duration_seconds", "created"])


def _word_table(spark: SparkSession, folder: str) -> DataFrame:
    return V.words(spark, folder).select(*SOURCE_KEY, "word_index", "word", "start_time", "end_time")


def replace_children(spark: SparkSession, folder: str) -> DataFrame:
    """Every third transcript is saved again with only its odd words."""
    words = _word_table(spark, folder)
    saved = words.filter(F.pmod(_number("source_slug"), F.lit(3)) == 0)
    fresh = saved.filter(F.pmod("word_index", F.lit(2)) == 1)
    return K.replace_children(words, saved, fresh, SOURCE_KEY, ["word_index"], "word_index", F.floor(F.col("word_index") / 100000))


def parent_rollup(spark: SparkSession, folder: str) -> DataFrame:
    analyses = _analyses(spark, folder)
    n = _number("source_slug")
    scenes = V.turns(spark, folder).filter(F.pmod(n, F.lit(4)) != 0)
    saved = analyses.filter(F.pmod(n, F.lit(6)) != 5)
    return K.parent_rollup(analyses, saved, K.children_of(scenes, saved, SOURCE_KEY), SOURCE_KEY)


def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter of the projects goes, and with them assets, renders, transcripts with words and analyses with scenes."""
    tables = {
        "projects": V.projects(spark, folder), "assets": _assets(spark, folder), "renders": V.renders(spark, folder), "transcripts": _transcripts(spark, folder),
        "words": _word_table(spark, folder), "analyses": _analyses(spark, folder), "scenes": V.turns(spark, folder),
    }
    links = {
        **{child: ("projects", {"project_slug": "slug"}) for child in ("assets", "renders", "transcripts", "analyses")},
        "words": ("transcripts", {"project_slug": "project_slug"}), "scenes": ("analyses", {"project_slug": "project_slug"}),
    }
    doomed = tables["projects"].filter(F.pmod(_number("slug"), F.lit(4)) == 1).select("slug")
    left = K.cascade_delete(tables, links, "projects", doomed)
    keys = {"projects": ["slug"], "assets": ASSET_KEY, "renders": ASSET_KEY, "transcripts": SOURCE_KEY, "words": [*SOURCE_KEY, "word_index"], "analyses": SOURCE_KEY, "scenes": [*SOURCE_KEY, "scene_index"]}
    result = None
    for name, df in left.items():
        rows = df.select(F.lit(name).alias("table_name"), F.concat_ws("/", *keys[name]).alias("key"))
        result = rows if result is None else result.unionByName(rows)
    return result


def deletion_report(spark: SparkSession, folder: str) -> DataFrame:
    projects = V.projects(spark, folder)
    doomed = V.table(spark, folder, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey") * 20).alias("slug"))
    return K.deletion_report(projects, doomed, ["slug"])


def archive_projects(spark: SparkSession, folder: str) -> DataFrame:
    projects = V.projects(spark, folder)
    listed = V.table(spark, folder, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey") * 20).alias("slug"))
    return K.set_columns(projects, listed.withColumns({"status": F.lit("archived"), "updated": _later()}), ["slug"], ["status", "updated"])


def set_tags(spark: SparkSession, folder: str) -> DataFrame:
    assets = V.assets(spark, folder).withColumn("tags", F.from_json("tags_json", "array<string>")).select(*ASSET_KEY, "tags")
    changes = assets.filter(F.pmod(_number("slug"), F.lit(5)) == 0).withColumn("tags", F.when(F.pmod(_number("slug"), F.lit(10)) == 0, F.array(F.lit("a"), F.lit("b"))))
    return K.set_columns(assets, changes, ASSET_KEY, ["tags"]).withColumn("tags", F.array_join("tags", "|"))


def _stored(spark: SparkSession, df: DataFrame, keys: list[str], order: list[str] | None = None, buckets: int = 16) -> str:
    """The table written as version 0 below a fresh folder."""
    path = f"{runs.work_folder(spark, 'versions')}/table"
    versions.create(df, path, keys, order, buckets)
    return path


def merge_assets(spark: SparkSession, folder: str) -> DataFrame:
    """The batch of `upsert_assets`, merged into a stored table: only the buckets it falls into are read and written."""
    assets = _assets(spark, folder)
    path = _stored(spark, assets, ASSET_KEY)
    batch = cut_lineage(_asset_batch(assets))
    versions.merge(spark, path, batch, lambda rows: K.upsert(rows, batch, ASSET_KEY, order="nth"))
    return versions.read(spark, path)


def merge_words(spark: SparkSession, folder: str) -> DataFrame:
    """The children of `replace_children` in a stored table, dealt by their parents."""
    words = _word_table(spark, folder)
    path = _stored(spark, words, SOURCE_KEY, [*SOURCE_KEY, "word_index"])
    saved = cut_lineage(words.filter(F.pmod(_number("source_slug"), F.lit(3)) == 0))
    fresh = saved.filter(F.pmod("word_index", F.lit(2)) == 1)
    block = F.floor(F.col("word_index") / 100000)
    versions.merge(spark, path, saved, lambda rows: K.replace_children(rows, saved, fresh, SOURCE_KEY, ["word_index"], "word_index", block))
    return versions.read(spark, path)


def get_by_key(spark: SparkSession, folder: str) -> DataFrame:
    return versions.lookup(spark, _stored(spark, _assets(spark, folder), ["slug"]), slug="a15")


def get_by_keys(spark: SparkSession, folder: str) -> DataFrame:
    wanted = V.table(spark, folder, "supplier").select(F.concat(F.lit("a"), F.col("s_suppkey") * 7).alias("slug"))
    path = _stored(spark, _assets(spark, folder).select(*ASSET_KEY, "filename"), ["slug"])
    return versions.lookup_many(spark, path, wanted)


def children_in_order(spark: SparkSession, folder: str) -> DataFrame:
    path = _stored(spark, _word_table(spark, folder), SOURCE_KEY, [*SOURCE_KEY, "word_index"])
    return versions.lookup(spark, path, project_slug="p2", source_slug="c7").orderBy("word_index")


def list_newest(spark: SparkSession, folder: str) -> DataFrame:
    renders = V.renders(spark, folder).filter("status = 'completed'")
    return renders.select(*ASSET_KEY, "created").orderBy(F.desc("created"), *ASSET_KEY)


def list_presets(spark: SparkSession, folder: str) -> DataFrame:
    return _presets(spark, folder).filter("type = 'caption'").select("name", "description").orderBy("name")


def list_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return V.renders(spark, folder).select(*ASSET_KEY, "status", "created").orderBy(F.desc("created"), *ASSET_KEY).limit(50)


def list_all_with_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _transcripts(spark, folder).select(F.concat_ws("/", *SOURCE_KEY).alias("id"), "word_count", "duration_seconds")


def split_compound_id(spark: SparkSession, folder: str) -> DataFrame:
    raw = V.renders(spark, folder).select(F.concat(F.when(F.pmod(_number("slug"), F.lit(3)) > 0, F.concat("project_slug", F.lit("/"))).otherwise(F.lit("")), "slug", F.when(F.pmod(_number("slug"), F.lit(5)) == 0, F.lit("/x")).when(F.pmod(_number("slug"), F.lit(7)) == 0, F.lit("//y")).otherwise(F.lit(""))).alias("id"))
    parts = X.split_compound_id("id")
    return raw.select("id", parts["project"].alias("project"), parts["source"].alias("source"))


def slugify(spark: SparkSession, folder: str) -> DataFrame:
    return V.table(spark, folder, "documents").select("doc_id", F.md5(X.slugify("text")).alias("slug_md5"))


def derive_slugs_from_path(spark: SparkSession, folder: str) -> DataFrame:
    return V.assets(spark, folder).select("file_path", X.project_slug_of("file_path").alias("project"), X.source_slug_of("file_path").alias("source"))


def unique_slug(spark: SparkSession, folder: str) -> DataFrame:
    """New renders ask for the slug of their priority; some names of each project are taken."""
    orders = V.table(spark, folder, "orders").select(
        F.concat(F.lit("p"), F.pmod("o_custkey", F.lit(50))).alias("project_slug"), X.slugify("o_orderpriority").alias("base"), F.col("o_orderkey").alias("request_id"), "o_orderstatus"
    )
    wanted = orders.filter("o_orderstatus <> 'F'").drop("o_orderstatus")
    n = F.pmod("request_id", F.lit(30))
    taken = orders.filter("o_orderstatus = 'F'").select("project_slug", F.when(n <= 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), n)).alias("slug")).distinct()
    named = K.unique_slugs(wanted, taken, ["project_slug"], ["request_id"], F.floor(F.col("request_id") / 10000))
    # Names past the hundredth carry a hash, which SQL engines cut differently; show only that they do.
    plain = F.col("slug").rlike("^[a-z0-9-]*?(-[0-9]{1,3})?$") & (F.length("slug") < F.length("base") + 5)
    return named.select("project_slug", "base", "request_id", F.when(plain, F.col("slug")).otherwise(F.lit("hashed")).alias("slug"))


def unique_slug_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Every line item asks for a slug: few bases, one of them for a third of all, some equal to numbered names of others, a null scope.

    Rows, rows with a name, different names and names that were taken before, by scope.
    """
    lines = V.table(spark, folder, "lineitem")
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    base = F.when(F.pmod(key, F.lit(3)) == 0, F.lit("clip")).when(F.pmod(key, F.lit(50)) == 1, F.concat(F.lit("clip-"), F.pmod(key, F.lit(120)))).otherwise(F.lower("l_returnflag"))
    wanted = lines.select(F.when(F.col("l_linestatus") == "O", F.lit("p1")).alias("scope"), base.alias("base"), key.alias("request_id"))
    taken = V.table(spark, folder, "supplier").select(F.lit("p1").alias("scope"), F.concat(F.lit("clip-"), F.col("s_suppkey") * 2).alias("slug"))
    named = K.unique_slugs(wanted, taken, ["scope"], ["request_id"], F.floor(F.col("request_id") / 10000))
    met = named.select("scope", "slug").join(taken.withColumn("was", F.lit(1)), ["scope", "slug"], "left")
    return met.groupBy("scope").agg(F.count(F.lit(1)).alias("n_rows"), F.count("slug").alias("n_named"), F.countDistinct("slug").alias("n_names"), F.count("was").alias("n_taken"))


def get_or_create(spark: SparkSession, folder: str) -> DataFrame:
    customers = V.table(spark, folder, "customer")
    key = F.col("c_custkey")
    existing = customers.filter(F.pmod(key, F.lit(2)) == 0).select(
        X.slugify("c_name").alias("slug"), F.when(F.pmod(key, F.lit(6)) == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("name"), F.lit("active").alias("status")
    )
    table, _ = K.get_or_create(existing, customers.select(F.col("c_name").alias("name")), {"status": F.lit("active")})
    return table


def constraint_audit(spark: SparkSession, folder: str) -> DataFrame:
    segments = V.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("spec_id"), F.col("l_linenumber").alias("seg_index"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("rate"))
    projects = V.projects(spark, folder)
    renders = V.renders(spark, folder)
    tables = {"segments": segments, "projects": projects.filter(F.pmod(_number("slug"), F.lit(20)) != 7), "renders": renders}
    return K.constraint_audit(
        tables, {"segments": ["spec_id", "seg_index"], "projects": ["slug"], "renders": ASSET_KEY},
        {"segments": ["rate"], "projects": ["description"]}, [("renders", ["project_slug"], "projects", ["slug"])],
    )


def _disk(table: DataFrame) -> DataFrame:
    """A second copy: a tenth is gone, a tenth is changed, all times jitter below a second."""
    n = _number("slug")
    gone = table.filter(F.pmod(n, F.lit(10)) != 3)
    changed = gone.withColumns({"duration_seconds": F.when(F.pmod(n, F.lit(10)) == 5, F.col("duration_seconds") + 0.01).otherwise(F.col("duration_seconds") + 0.0001), "created": F.col("created") + F.expr("interval 250 milliseconds")})
    return changed.unionByName(changed.filter(F.pmod(n, F.lit(10)) == 7).withColumn("slug", F.concat(F.lit("d"), "slug")))


def parity_diff(spark: SparkSession, folder: str) -> DataFrame:
    renders = V.renders(spark, folder).select(*ASSET_KEY, "status", "duration_seconds", "created", "notes_md")
    diff = K.parity_diff(renders, _disk(renders), ASSET_KEY, ["status", "duration_seconds", "created", "notes_md"])
    return diff.withColumn("detail", F.regexp_replace("detail", "=[^ ;]*", "="))


def parity_children(spark: SparkSession, folder: str) -> DataFrame:
    words = _word_table(spark, folder)
    n = _number("source_slug")
    disk = words.filter((F.pmod(n, F.lit(5)) != 1) | (F.col("word_index") > 0)).filter(F.pmod(n, F.lit(7)) != 6)
    disk = disk.withColumn("word", F.when((F.pmod(n, F.lit(4)) == 2) & (F.col("word_index") == 0), F.lit("other")).otherwise(F.col("word")))
    return K.parity_children(words, disk, SOURCE_KEY, "word_index", "word")


def parity_summary(spark: SparkSession, folder: str) -> DataFrame:
    return K.parity_summary(parity_diff(spark, folder))


def adhoc_sql(spark: SparkSession, folder: str) -> DataFrame:
    """A user's own SELECT over the tables as temporary views."""
    V.renders(spark, folder).createOrReplaceTempView("renders")
    V.projects(spark, folder).createOrReplaceTempView("projects")
    return spark.sql(
        "SELECT p.status AS project_status, r.status AS render_status, GROUPING(r.status) AS subtotal, COUNT(*) AS n, SUM(r.duration_seconds) AS seconds "
        "FROM renders r JOIN projects p ON p.slug = r.project_slug GROUP BY ROLLUP (p.status, r.status)"
    )


QUERIES = {
    f.__name__: f
    for f in (
        upsert_assets, upsert_renders, upsert_presets, upsert_analyses, upsert_transcripts, replace_children, merge_assets, merge_words, parent_rollup, cascade_delete, deletion_report,
        archive_projects, set_tags, get_by_key, get_by_keys, children_in_order, list_newest, list_presets, list_top_k, list_all_with_ids, split_compound_id,
        slugify, derive_slugs_from_path, unique_slug, unique_slug_audit, get_or_create, constraint_audit, parity_diff, parity_children, parity_summary, adhoc_sql,
    )
}

_NOW = f"TIMESTAMP '{NOW}'"
_OLD = "TIMESTAMP '2024-01-01'"
_PRESETS = """
presets AS (SELECT lower(p_brand) || '-' || lower(p_type) AS name, 'caption' AS type, MIN(p_name) AS description, '{"wordsPerGroup":' || MAX(p_size) || '}' AS config_json FROM part GROUP BY ALL)"""
_ANALYSES = f"""
analyses AS (SELECT 'p' || (conv_id % 5) AS project_slug, 'c' || conv_id AS source_slug, '/media/' || conv_id AS source_path, 'extracted' AS status, 1.0::DOUBLE AS sample_fps, COUNT(*) AS frame_count,
  0 AS scene_count, (conv_id % 90)::DOUBLE AS duration_seconds, '/frames/' || conv_id AS frames_dir, {_OLD} AS created, conv_id AS k FROM conversations GROUP BY conv_id)"""
_TRANSCRIPTS = f"""
transcripts AS (SELECT project_slug, source_slug, COUNT(*) AS word_count, MAX(end_time) AS duration_seconds, {_OLD} AS created, substr(source_slug, 2)::BIGINT AS k FROM words GROUP BY ALL)"""
_FOLD = """regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g')"""
_DISK = """
db AS (SELECT *, substr(slug, 2)::BIGINT AS k FROM renders),
disk AS (SELECT project_slug, CASE WHEN d THEN 'd' || slug ELSE slug END AS slug, status, notes_md, k, duration_seconds + CASE WHEN k % 10 = 5 THEN 0.01::DOUBLE ELSE 0.0001::DOUBLE END AS duration_seconds, created
  FROM db, (VALUES (false), (true)) v(d) WHERE k % 10 <> 3 AND (NOT d OR k % 10 = 7)),
diff AS (SELECT project_slug, slug, CASE WHEN db.status IS NULL THEN 'MISSING_IN_DB' WHEN disk.status IS NULL THEN 'MISSING_ON_DISK' WHEN round(db.duration_seconds * 1000) <> round(disk.duration_seconds * 1000) THEN 'DIFFER' ELSE 'OK' END AS kind,
  CASE WHEN round(db.duration_seconds * 1000) <> round(disk.duration_seconds * 1000) THEN 'duration_seconds: db= md=' ELSE '' END AS detail FROM db FULL OUTER JOIN disk USING (project_slug, slug))"""

ORACLES = {
    "upsert_assets": with_(ASSETS) + f""", base AS (SELECT * EXCLUDE (tags_json, p_partkey), p_partkey AS k FROM assets)
SELECT project_slug, slug, CASE WHEN k % 3 = 0 THEN 'v2 ' ELSE '' END || filename AS filename, file_path, file_size_bytes, CASE WHEN k % 3 > 0 THEN duration_seconds WHEN k % 2 = 0 THEN duration_seconds + 1.0 END AS duration_seconds,
  width, height, fps, codec, CASE WHEN k % 3 = 0 THEN false ELSE has_audio END AS has_audio, created FROM base
UNION ALL SELECT project_slug, 'n' || slug, 'v2 ' || filename, file_path, file_size_bytes, CASE WHEN k % 2 = 0 THEN duration_seconds + 1.0 END, width, height, fps, codec, false, CASE WHEN k % 2 = 1 THEN {_NOW} - INTERVAL 1 DAY ELSE {_NOW} END FROM base WHERE k % 7 = 0""",
    "upsert_renders": with_(RENDERS) + """ SELECT * REPLACE (CASE WHEN substr(slug, 2)::BIGINT % 4 = 1 THEN 'completed' ELSE status END AS status, CASE WHEN substr(slug, 2)::BIGINT % 4 = 1 THEN 'again' ELSE notes_md END AS notes_md) FROM renders""",
    "upsert_presets": with_(_PRESETS) + f""" SELECT name, type, description, CASE WHEN name LIKE '%promo' THEN '{{}}' ELSE config_json END AS config_json, {_OLD} AS created, CASE WHEN name LIKE '%promo' THEN {_NOW} ELSE {_OLD} END AS updated FROM presets""",
    "upsert_analyses": with_(_ANALYSES) + f""" SELECT * EXCLUDE (k) REPLACE (CASE WHEN k % 6 = 3 THEN 2.0::DOUBLE ELSE sample_fps END AS sample_fps, CASE WHEN k % 6 = 3 THEN '/new' || frames_dir ELSE frames_dir END AS frames_dir) FROM analyses
UNION ALL SELECT project_slug, 'x' || source_slug, source_path, 'new', 2.0, frame_count, 9, duration_seconds, '/new' || frames_dir, {_NOW} FROM analyses WHERE k % 6 = 0""",
    "upsert_transcripts": with_(WORDS, _TRANSCRIPTS) + f""" SELECT project_slug, source_slug, word_count + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS word_count, duration_seconds, CASE WHEN k % 2 = 0 THEN {_NOW} ELSE created END AS created FROM transcripts""",
    "replace_children": with_(WORDS) + """ SELECT project_slug, source_slug, word_index, word, start_time, end_time FROM words WHERE substr(source_slug, 2)::BIGINT % 3 <> 0
UNION ALL SELECT project_slug, source_slug, row_number() OVER (PARTITION BY project_slug, source_slug ORDER BY word_index) - 1, word, start_time, end_time FROM words WHERE substr(source_slug, 2)::BIGINT % 3 = 0 AND word_index % 2 = 1""",
    "parent_rollup": with_(WORDS, _ANALYSES) + """, sc AS (SELECT project_slug, source_slug, COUNT(DISTINCT turn) AS n, MAX(end_time) AS e FROM words WHERE substr(source_slug, 2)::BIGINT % 4 <> 0 GROUP BY ALL)
SELECT * EXCLUDE (k, n, e) REPLACE (CASE WHEN k % 6 <> 5 THEN 'analyzed' ELSE status END AS status, CASE WHEN k % 6 <> 5 THEN COALESCE(n, 0) ELSE scene_count END AS scene_count,
  CASE WHEN k % 6 <> 5 THEN greatest(duration_seconds, COALESCE(e, 0)) ELSE duration_seconds END AS duration_seconds) FROM analyses LEFT JOIN sc USING (project_slug, source_slug)""",
    "cascade_delete": with_(WORDS, PROJECTS, ASSETS, RENDERS) + """, doomed AS (SELECT slug FROM projects WHERE substr(slug, 2)::BIGINT % 4 = 1), sources AS (SELECT DISTINCT project_slug, source_slug FROM words)
SELECT 'projects' AS table_name, slug AS key FROM projects WHERE slug NOT IN (FROM doomed)
UNION ALL SELECT 'assets', project_slug || '/' || slug FROM assets WHERE project_slug NOT IN (FROM doomed) UNION ALL SELECT 'renders', project_slug || '/' || slug FROM renders WHERE project_slug NOT IN (FROM doomed)
UNION ALL SELECT t, project_slug || '/' || source_slug FROM sources, (VALUES ('transcripts'), ('analyses')) v(t) WHERE project_slug NOT IN (FROM doomed)
UNION ALL SELECT 'words', project_slug || '/' || source_slug || '/' || word_index FROM words WHERE project_slug NOT IN (FROM doomed)
UNION ALL SELECT 'scenes', project_slug || '/' || source_slug || '/' || turn FROM (SELECT DISTINCT project_slug, source_slug, turn FROM words) WHERE project_slug NOT IN (FROM doomed)""",
    "deletion_report": with_(PROJECTS) + """ SELECT 'p' || (s_suppkey * 20) AS slug, 'p' || (s_suppkey * 20) IN (SELECT slug FROM projects) AS deleted FROM supplier""",
    "archive_projects": with_(PROJECTS) + f""" SELECT * EXCLUDE (hit) REPLACE (CASE WHEN hit THEN 'archived' ELSE status END AS status, CASE WHEN hit THEN {_NOW} ELSE updated END AS updated) FROM (SELECT slug, name, status, description, created, updated FROM projects),
  LATERAL (SELECT slug IN (SELECT 'p' || (s_suppkey * 20) FROM supplier) AS hit)""",
    "set_tags": with_(ASSETS) + """ SELECT project_slug, slug, CASE WHEN p_partkey % 10 = 0 THEN 'a|b' WHEN p_partkey % 5 = 0 THEN NULL ELSE array_to_string(from_json(tags_json, '["VARCHAR"]'), '|') END AS tags FROM assets""",
    "get_by_key": with_(ASSETS) + " SELECT * EXCLUDE (tags_json, p_partkey) FROM assets WHERE slug = 'a15'",
    "get_by_keys": with_(ASSETS) + " SELECT project_slug, slug, filename FROM assets WHERE p_partkey IN (SELECT s_suppkey * 7 FROM supplier)",
    "children_in_order": with_(WORDS) + " SELECT project_slug, source_slug, word_index, word, start_time, end_time FROM words WHERE project_slug = 'p2' AND source_slug = 'c7' ORDER BY word_index",
    "list_newest": with_(RENDERS) + " SELECT project_slug, slug, created FROM renders WHERE status = 'completed' ORDER BY created DESC, project_slug, slug",
    "list_presets": with_(_PRESETS) + " SELECT name, description FROM presets ORDER BY name",
    "list_top_k": with_(RENDERS) + " SELECT project_slug, slug, status, created FROM renders ORDER BY created DESC, project_slug, slug LIMIT 50",
    "list_all_with_ids": with_(WORDS, _TRANSCRIPTS) + " SELECT project_slug || '/' || source_slug AS id, word_count, duration_seconds FROM transcripts",
    "split_compound_id": with_(RENDERS) + """, raw AS (SELECT CASE WHEN k % 3 > 0 THEN project_slug || '/' ELSE '' END || slug || CASE WHEN k % 5 = 0 THEN '/x' WHEN k % 7 = 0 THEN '//y' ELSE '' END AS id FROM (SELECT *, substr(slug, 2)::BIGINT AS k FROM renders))
SELECT id, CASE WHEN id LIKE '%/%' THEN split_part(id, '/', 1) END AS project, CASE WHEN id LIKE '%/%' THEN substr(id, strpos(id, '/') + 1) END AS source FROM raw""",
    "slugify": f"WITH f AS (SELECT doc_id, trim({_FOLD}, '-') AS s FROM documents) SELECT doc_id, md5(CASE WHEN s = '' THEN 'untitled' ELSE s END) AS slug_md5 FROM f",
    "derive_slugs_from_path": with_(ASSETS) + """ SELECT file_path, trim(regexp_replace(lower(split_part(file_path, '/', 3)), '[^a-z0-9]+', '-', 'g'), '-') AS project,
  trim(regexp_replace(lower(regexp_replace(split_part(file_path, '/', 4), '[.][^.]*$', '')), '[^a-z0-9]+', '-', 'g'), '-') AS source FROM assets""",
    "unique_slug": """WITH o AS (SELECT 'p' || (o_custkey % 50) AS project_slug, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') AS base, o_orderkey AS request_id, o_orderstatus AS st FROM orders),
wanted AS (SELECT *, row_number() OVER (PARTITION BY project_slug, base ORDER BY request_id) AS k FROM o WHERE st <> 'F'),
taken AS (SELECT project_slug, base, list(DISTINCT CASE WHEN request_id % 30 <= 1 THEN 1 ELSE request_id % 30 END) AS used FROM o WHERE st = 'F' GROUP BY ALL),
free AS (SELECT w.*, list_filter(range(1, 101), lambda x: NOT list_contains(COALESCE(used, []), x))[k] AS n FROM wanted w LEFT JOIN taken USING (project_slug, base))
SELECT project_slug, base, request_id, CASE WHEN n IS NULL THEN 'hashed' WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM free""",
    "unique_slug_audit": """SELECT CASE WHEN l_linestatus = 'O' THEN 'p1' END AS scope, COUNT(*) AS n_rows, COUNT(*) AS n_named, COUNT(*) AS n_names, 0 AS n_taken FROM lineitem GROUP BY ALL""",
    "get_or_create": """WITH c AS (SELECT c_custkey AS k, c_name AS name, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer)
SELECT slug, CASE WHEN k % 6 = 0 THEN upper(name) ELSE name END AS name, 'active' AS status FROM c UNION ALL SELECT slug || '-2', name, 'active' FROM c WHERE k % 6 = 0""",
    "constraint_audit": with_(PROJECTS, RENDERS) + """, pr AS (SELECT * FROM projects WHERE substr(slug, 2)::BIGINT % 20 <> 7)
SELECT 'segments' AS table_name, 'duplicate key' AS rule, l_orderkey || '/' || l_linenumber AS key FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1
UNION ALL SELECT 'segments', 'rate is null', l_orderkey || '/' || l_linenumber FROM lineitem WHERE NOT l_tax > 0
UNION ALL SELECT 'projects', 'description is null', slug FROM pr WHERE description IS NULL
UNION ALL SELECT 'renders', 'no projects row', project_slug || '/' || slug FROM renders WHERE project_slug NOT IN (SELECT slug FROM pr)""",
    "parity_diff": with_(RENDERS, _DISK) + " SELECT * FROM diff",
    "parity_children": with_(WORDS) + """, w AS (SELECT *, substr(source_slug, 2)::BIGINT AS k FROM words),
d AS (SELECT project_slug, source_slug, word_index, CASE WHEN k % 4 = 2 AND word_index = 0 THEN 'other' ELSE word END AS word FROM w WHERE (k % 5 <> 1 OR word_index > 0) AND k % 7 <> 6),
a AS (SELECT project_slug, source_slug, COUNT(*) AS n, arg_min(word, word_index) AS f, arg_max(word, word_index) AS l FROM w GROUP BY ALL), b AS (SELECT project_slug, source_slug, COUNT(*) AS n, arg_min(word, word_index) AS f, arg_max(word, word_index) AS l FROM d GROUP BY ALL)
SELECT project_slug, source_slug, a.n AS db_count, b.n AS md_count, CASE WHEN a.n <> b.n THEN 'COUNT_DIFFERS' WHEN a.f <> b.f OR a.l <> b.l THEN 'ENDS_DIFFER' ELSE 'OK' END AS kind FROM b JOIN a USING (project_slug, source_slug)""",
    "parity_summary": with_(RENDERS, _DISK) + " SELECT kind, COUNT(*) AS n FROM diff GROUP BY kind",
    "adhoc_sql": with_(PROJECTS, RENDERS) + """ SELECT p.status AS project_status, r.status AS render_status, GROUPING(r.status) AS subtotal, COUNT(*) AS n, SUM(r.duration_seconds) AS seconds
FROM renders r JOIN projects p ON p.slug = r.project_slug GROUP BY ROLLUP (p.status, r.status)""",
}
# A merge into a stored table gives what the merge of whole tables gives.
ORACLES["merge_assets"] = ORACLES["upsert_assets"]
ORACLES["merge_words"] = ORACLES["replace_children"]
