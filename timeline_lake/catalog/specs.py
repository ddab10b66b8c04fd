"""Spec queries and their SQL. The SQL works on the numbers the documents are built from, not on their JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeline_lake.catalog.sql import RENDERS, with_
from timeline_lake.functions.numbers import finite_or_zero, to_number
from timeline_lake.operators import keyed as K
from timeline_lake.plans import specs as S
from timeline_lake.plans import views as V
from timeline_lake.sources.presets import built_in_presets

KEY = ["spec_id"]


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return S.parse_specs(V.specs(spark, folder))


def _good(spark: SparkSession, folder: str) -> DataFrame:
    return S.good_specs(_parsed(spark, folder))


def spec_parse(spark: SparkSession, folder: str) -> DataFrame:
    size = S.resolution_size(F.col("spec.resolution"))
    return _parsed(spark, folder).select(
        *KEY, "problem", F.size("spec.sources").cast("long").alias("n_sources"), F.size("spec.segments").cast("long").alias("n_segments"),
        F.col("spec.captions.font_size").alias("font_size"), F.col("spec.audio.music_volume").alias("music_volume"), F.col("spec.fps").alias("fps"),
        size["preset"].alias("preset"), size["width"].alias("width"), F.col("spec.output_path").alias("output_path"),
    )


#: Something else in place of a text, a number, a truth value, a list and an object.
WRONG_TYPES = (
    ',"output_path":5', ',"captions":{"fontFamily":["a"]}', ',"captions":{"color":7,"fontSize":3}', ',"overlays":[{"start":0,"end":1,"x":0,"y":0,"width":1,"height":1,"text":{"title":true}}]',
    ',"resolution":720', ',"aspectRatio":{"w":1}', ',"audio":{"musicVolume":"loud"}', ',"captions":{"allCaps":1}', ',"overlays":{"start":0}', ',"lut":"file"', ',"quality":{"bitrate":"much"}',
)


def _faulty(spark: SparkSession, folder: str) -> DataFrame:
    """One small document per order, every kind of fault in turn."""
    k = F.col("o_orderkey")
    segment = {
        1: ',"transition":{"type":"wipe","duration":1}', 2: ',"transition":{"type":"crossfade"}', 3: ',"keyframes":[{"time":0},{"scale":2}]',
        4: ',"speed":"fast"', 5: ',"transition":{"type":"crossfade","duration":0.5},"keyframes":[{"time":0.5}]',
    }
    rest = {
        6: ',"aspect_ratio":"7:3"', 7: ',"quality":{"codec":"av1"}', 8: ',"resolution":"8k"', 9: ',"fps":"fast"', 10: ',"lut":{"strength":0.5}',
        11: ',"overlays":[{"start":0,"end":1,"x":0,"y":0,"width":1,"height":1,"keyframes":[{"opacity":1}]}]', 12: ',"overlays":[{"start":0,"end":1,"x":0,"y":0,"width":1}]',
        13: ',"aspectRatio":"4:5","resolution":{"width":10,"height":20},"quality":{"codec":"h264"}', 14: ',"audio":{"normalizeAudio":"yes"}',
        **{19 + n: t for n, t in enumerate(WRONG_TYPES)}, 19 + len(WRONG_TYPES): ',"note":{"id":5,"path":[1]},"x-color":7,"captions":{"color":"a \\"id\\": 5"}',
    }
    turn = F.pmod(k, F.lit(20 + len(WRONG_TYPES)))

    def chosen(texts: dict[int, str]) -> Column:
        value = F.lit("")
        for n, t in texts.items():
            value = F.when(turn == n, F.lit(t)).otherwise(value)
        return value

    whole = F.concat(
        F.lit('{"sources":[{"id":"a","path":"/a"}],"segments":[{"source_id":"a","start":0,"end":'), F.when(turn == 15, F.lit('"2"')).otherwise(F.lit("2")), chosen(segment), F.lit('}],"outputPath":"/o'), k, F.lit('"'), chosen(rest), F.lit("}")
    )
    text = F.when(turn == 16, F.lit("nonsense")).when(turn == 17, F.concat(F.lit("["), whole, F.lit("]"))).when(turn == 18, F.substring(whole, 1, 60)).otherwise(whole)
    return V.table(spark, folder, "orders").select(k.alias("spec_id"), text.alias("spec_json"))


def spec_problems(spark: SparkSession, folder: str) -> DataFrame:
    return S.parse_specs(_faulty(spark, folder)).select("spec_id", "problem")


def spec_segments(spark: SparkSession, folder: str) -> DataFrame:
    return S.explode_part(_good(spark, folder), "segments", KEY).select(
        *KEY, "position", "source_id", "start", "end", "speed", F.col("transition.duration").alias("transition"), "volume", "audio_from_prev"
    )


def spec_sources(spark: SparkSession, folder: str) -> DataFrame:
    return S.explode_part(_good(spark, folder), "sources", KEY)


def spec_keyframes(spark: SparkSession, folder: str) -> DataFrame:
    good = _good(spark, folder)
    overlay = S.explode_keyframes(good, "overlays", KEY).select(*KEY, F.lit("overlay").alias("of"), "element", "position", "time", "scale", F.col("rotation").alias("extra"))
    segment = S.explode_keyframes(good, "segments", KEY).select(*KEY, F.lit("segment").alias("of"), "element", "position", "time", "scale", F.col("pan_y").alias("extra"))
    return overlay.unionByName(segment)


def overlay_kind(spark: SparkSession, folder: str) -> DataFrame:
    rows = _good(spark, folder).select(*KEY, F.posexplode("spec.overlays").alias("position", "o"))
    return rows.select(*KEY, F.col("position").cast("long").alias("position"), S.overlay_kind(F.col("o")).alias("kind"))


def _issues(spark: SparkSession, folder: str) -> DataFrame:
    specs = _good(spark, folder)
    customers = V.table(spark, folder, "customer")
    media = customers.filter("c_custkey % 10 <> 4").select(
        F.concat(F.lit("/media/"), F.pmod("c_custkey", F.lit(1000)), F.lit(".mp4")).alias("path"), (F.pmod("c_custkey", F.lit(1000)) % 7 * 1.0).alias("duration")
    ).distinct()
    transcripts = V.table(spark, folder, "conversations").select(F.concat(F.lit("p"), F.pmod("conv_id", F.lit(5))).alias("project_slug"), F.concat(F.lit("c"), "conv_id").alias("source_slug")).distinct()
    nations = V.table(spark, folder, "nation")
    files = nations.select(F.explode(F.array(F.concat(F.lit("/img/"), "n_nationkey", F.lit(".png")), F.concat(F.lit("/music/"), "n_nationkey", F.lit(".mp3")))).alias("path"))
    folders = nations.filter("n_nationkey <> 13").select(F.concat(F.lit("/out/"), "n_nationkey").alias("folder"))
    return S.validate_specs(specs, KEY, media, transcripts, files, folders)


def spec_validate(spark: SparkSession, folder: str) -> DataFrame:
    return _issues(spark, folder)


def spec_valid(spark: SparkSession, folder: str) -> DataFrame:
    counted = _issues(spark, folder).groupBy(*KEY).agg(F.count(F.lit(1)).alias("issues"))
    joined = _good(spark, folder).select(*KEY).join(counted, KEY, "left")
    return joined.select(*KEY, F.coalesce("issues", F.lit(0)).alias("issues"), F.col("issues").isNull().alias("valid"))


def spec_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Overrides for every second spec: a caption colour, a codec for some, other segments for some, a new path."""
    base = _good(spark, folder)
    k = F.col("spec_id")
    text = F.concat(
        F.lit('{"captions":{"color":"#FF0000","allCaps":false}'), F.when(F.pmod(k, F.lit(3)) == 1, F.lit(',"quality":{"bitrate":8000000}')).otherwise(F.lit("")),
        F.when(F.pmod(k, F.lit(8)) == 0, F.lit(',"segments":[{"sourceId":"s0","start":0,"end":9}]')).otherwise(F.lit("")),
        F.when(F.pmod(k, F.lit(10)) == 0, F.lit(',"outputPath":"/new.mp4"')).otherwise(F.lit("")), F.lit("}"),
    )
    overrides = S.parse_specs(base.filter(F.pmod(k, F.lit(2)) == 0).select(*KEY, text.alias("spec_json")))
    merged = S.merge_specs(base, overrides, KEY)
    c = F.col("spec.captions")
    return merged.select(
        *KEY, c["color"].alias("color"), c["font_size"].alias("font_size"), c["all_caps"].alias("all_caps"), F.col("spec.quality.codec").alias("codec"),
        F.col("spec.quality.bitrate").cast("long").alias("bitrate"), F.size("spec.segments").cast("long").alias("n_segments"), F.col("spec.output_path").alias("output_path"),
    )


def preset_resolve(spark: SparkSession, folder: str) -> DataFrame:
    captioned = _good(spark, folder).filter(F.col("spec.captions").isNotNull())
    resolved = S.resolve_presets(captioned, built_in_presets(spark), KEY)
    c = F.col("captions")
    return resolved.select(*KEY, c["preset"].alias("preset"), c["font_family"].alias("font_family"), c["font_size"].alias("font_size"), c["all_caps"].alias("all_caps"), c["words_per_group"].cast("long").alias("words_per_group"), "problem")


def rerender_naming(spark: SparkSession, folder: str) -> DataFrame:
    renders = V.renders(spark, folder)
    again = renders.select("project_slug", F.concat("slug", F.lit("-rerender")).alias("base"), F.col("slug").alias("of"), "output_path", "created")
    taken = renders.unionByName(renders.filter("duration_seconds < 20").withColumn("slug", F.concat("slug", F.lit("-rerender"))))
    named = K.unique_slugs(again, taken.select("project_slug", "slug"), ["project_slug"], ["of"], F.lit(0))
    return named.select("project_slug", "of", "slug", S.rerender_path(F.col("output_path")).alias("output_path"))


def spec_lineage(spark: SparkSession, folder: str) -> DataFrame:
    return S.source_use(S.source_edges(V.renders(spark, folder)))


def numeric_coerce(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("event_id")
    value = F.col("value").cast("string")
    raw = F.when(k % 7 == 0, F.concat(value, F.lit("x"))).when(k % 7 == 1, F.lit("NaN")).when(k % 7 == 2, F.lit("Infinity")).when(k % 7 == 3, F.lit(None)).otherwise(value)
    return V.table(spark, folder, "events").select("event_id", to_number(raw).alias("_n")).select("event_id", finite_or_zero("_n").alias("number"))


QUERIES = {
    f.__name__: f
    for f in (
        spec_parse, spec_problems, spec_sources, spec_segments, spec_keyframes, overlay_kind, spec_validate, spec_valid, spec_merge, preset_resolve, rerender_naming,
        spec_lineage, numeric_coerce,
    )
}

_DOCS = """
o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
good AS (SELECT * FROM o WHERE k % 37 <> 1 AND k % 29 <> 3),
srcs AS (SELECT k, c, i, 's' || CASE WHEN k % 19 = 0 AND i > 0 THEN 0 ELSE i END AS id, '/media/' || ((c + i) % 1000) || '.mp4' AS path,
  CASE WHEN k % 2 = 0 AND i < 2 THEN 'p' || (k % 5) || '/c' || ((k + i) % 140) END AS tid, CASE WHEN k % 2 = 0 AND i < 2 THEN (k + i) % 140 END AS conv, k % 5 AS proj FROM (SELECT *, unnest(range(0, k % 3 + 1)) AS i FROM good)),
segs AS (SELECT k, c, i, 's' || (i % (k % 3 + 1 + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END)) AS source_id, st AS start, st + ((k + i) % 5) * 0.5::DOUBLE AS "end",
  CASE WHEN (k + i) % 4 = 1 THEN CASE WHEN k % 4 = 1 THEN 2.0::DOUBLE ELSE 0.125::DOUBLE END END AS speed, CASE WHEN i % 2 = 1 THEN (k % 8) * 0.25::DOUBLE END AS tr,
  CASE WHEN i % 3 = 2 THEN 0.5::DOUBLE END AS volume, CASE WHEN k % 31 = 5 THEN true END AS afp FROM (SELECT *, i * 2.0::DOUBLE - CASE WHEN k % 23 = 0 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS st FROM (SELECT *, unnest(range(0, k % 4)) AS i FROM good))),
ovs AS (SELECT k, c, i, (k + i) % 5 AS kd, i * 0.5::DOUBLE AS start, i * 0.5::DOUBLE + (c % 6) * 0.5::DOUBLE AS "end", (k % 6) * 0.25::DOUBLE AS x, (c % 4) * 0.5::DOUBLE AS height,
  CASE WHEN c % 3 = 0 THEN CASE WHEN k % 3 = 0 THEN 8.0::DOUBLE ELSE 2.0::DOUBLE END END AS speed FROM (SELECT *, unnest(range(0, c % 3)) AS i FROM good)),
totals AS (SELECT k, SUM(("end" - start) / COALESCE(speed, 1.0::DOUBLE)) AS total FROM segs GROUP BY k)"""

_ISSUES = """
media AS (SELECT DISTINCT '/media/' || (c_custkey % 1000) || '.mp4' AS path, ((c_custkey % 1000) % 7)::DOUBLE AS duration FROM customer WHERE c_custkey % 10 <> 4),
lens AS (SELECT k, id AS source_id, arg_max(duration, i) AS duration FROM srcs JOIN media USING (path) GROUP BY ALL),
issues AS (
  SELECT k, 'No segments defined — nothing to render.' AS issue FROM good WHERE k % 4 = 0
  UNION ALL SELECT k, 'Captions requested but no transcriptId specified' FROM good WHERE k % 3 = 0 AND k % 2 = 1 AND k % 5 <> 1
  UNION ALL SELECT k, 'Duplicate source ID: s0' FROM srcs WHERE k % 19 = 0 AND i > 0
  UNION ALL SELECT k, 'Warning: source ''' || id || ''' has no transcriptId — segments from this source won''t have captions' FROM srcs WHERE k % 3 = 0 AND k % 2 = 0 AND tid IS NULL AND EXISTS (SELECT 1 FROM segs WHERE segs.k = srcs.k AND source_id = id)
  UNION ALL SELECT k, 'Segment ' || i || ': references unknown source ''' || source_id || '''' FROM segs WHERE NOT EXISTS (SELECT 1 FROM srcs WHERE srcs.k = segs.k AND id = source_id)
  UNION ALL SELECT k, 'Segment ' || i || ': end (' || "end" || 's) must be after start (' || start || 's)' FROM segs WHERE "end" <= start
  UNION ALL SELECT k, 'Segment ' || i || ': speed ' || speed || 'x out of range (0.25-4.0)' FROM segs WHERE speed < 0.25
  UNION ALL SELECT k, 'Segment ' || i || ': transition duration must be positive' FROM segs WHERE tr <= 0
  UNION ALL SELECT k, 'Segment ' || i || ': transition duration (' || tr || 's) exceeds half segment duration' FROM segs WHERE tr > ("end" - start) / 2
  UNION ALL SELECT k, 'Segment ' || i || ': start (' || start || 's) is negative' FROM segs JOIN lens USING (k, source_id) WHERE start < 0
  UNION ALL SELECT k, 'Segment ' || i || ': end (' || "end" || 's) exceeds source duration (' || duration || 's)' FROM segs JOIN lens USING (k, source_id) WHERE "end" > duration + 0.1::DOUBLE
  UNION ALL SELECT k, 'Source file not found: ' || path FROM srcs WHERE path NOT IN (SELECT path FROM media)
  UNION ALL SELECT k, 'Source ''' || id || ''': transcript ''' || tid || ''' not found' FROM srcs WHERE tid IS NOT NULL AND NOT (conv % 5 = proj AND conv IN (SELECT conv_id FROM conversations))
  UNION ALL SELECT k, 'Caption transcript not found: c' || (k % 140) FROM good WHERE k % 3 = 0 AND k % 2 = 1 AND k % 5 = 1 AND NOT ((k % 140) % 5 = c % 5 AND k % 140 IN (SELECT conv_id FROM conversations))
  UNION ALL SELECT k, 'Overlay ' || i || ': references unknown source ''s' || (k % 4) || '''' FROM ovs WHERE kd = 0 AND NOT EXISTS (SELECT 1 FROM srcs WHERE srcs.k = ovs.k AND id = 's' || (ovs.k % 4))
  UNION ALL SELECT k, 'Overlay ' || i || ': invalid backgroundColor ''#12345''' FROM ovs WHERE kd = 1 AND k % 3 = 0
  UNION ALL SELECT k, 'Overlay ' || i || ': color overlay requires backgroundColor' FROM ovs WHERE kd = 4
  UNION ALL SELECT k, 'Overlay ' || i || ': text overlay requires at least title or body' FROM ovs WHERE kd = 2 AND k % 2 = 1
  UNION ALL SELECT k, 'Overlay ' || i || ': image file not found or not readable: /img/' || (c % 50) || '.png' FROM ovs WHERE kd = 3 AND c % 50 NOT IN (SELECT n_nationkey FROM nation)
  UNION ALL SELECT k, 'Overlay ' || i || ': end must be after start' FROM ovs WHERE "end" <= start
  UNION ALL SELECT k, 'Overlay ' || i || ': end (' || "end" || 's) exceeds composition duration (~' || round(COALESCE(total, 0.0::DOUBLE) * 100) / 100.0::DOUBLE || 's)' FROM ovs LEFT JOIN totals USING (k) WHERE "end" > COALESCE(total, 0.0::DOUBLE) + 0.1::DOUBLE
  UNION ALL SELECT k, 'Overlay ' || i || ': x/y out of range [0, 1]' FROM ovs WHERE x > 1
  UNION ALL SELECT k, 'Overlay ' || i || ': width/height out of range (0, 1]' FROM ovs WHERE height <= 0 OR height > 1
  UNION ALL SELECT k, 'Warning: overlay ' || i || ' has speed=' || speed || ' but is not a video overlay — speed only applies to video overlays' FROM ovs WHERE speed IS NOT NULL AND kd <> 0
  UNION ALL SELECT k, 'Overlay ' || i || ': speed ' || speed || 'x out of range (0.25-4.0)' FROM ovs WHERE speed > 4
  UNION ALL SELECT k, 'Music file not found: /music/' || (c % 30) || '.mp3' FROM good WHERE k % 4 = 1 AND c % 30 NOT IN (SELECT n_nationkey FROM nation)
  UNION ALL SELECT k, 'Output directory does not exist: /out/' || (c % 20) FROM good WHERE c % 20 NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey <> 13))"""

ORACLES = {
    "spec_parse": """SELECT o_orderkey AS spec_id, CASE WHEN o_orderkey % 37 = 1 THEN 'segments' WHEN o_orderkey % 29 = 3 THEN 'output_path' END AS problem, o_orderkey % 3 + 1 AS n_sources,
  CASE WHEN o_orderkey % 37 <> 1 THEN o_orderkey % 4 END AS n_segments, CASE WHEN o_orderkey % 12 = 0 THEN 6.5::DOUBLE END AS font_size, CASE WHEN o_orderkey % 4 = 1 THEN 0.25::DOUBLE END AS music_volume,
  CASE WHEN o_orderkey % 2 = 0 THEN 30.0::DOUBLE END AS fps, CASE WHEN o_orderkey % 5 > 2 AND o_orderkey % 3 <> 1 THEN '720p' END AS preset, CASE WHEN o_orderkey % 5 > 2 AND o_orderkey % 3 = 1 THEN 640 END AS width,
  CASE WHEN o_orderkey % 29 <> 3 THEN '/out/' || (o_custkey % 20) || '/r' || o_orderkey || '.mp4' END AS output_path FROM orders""",
    "spec_problems": """SELECT o_orderkey AS spec_id, CASE o_orderkey % 31 WHEN 1 THEN 'segments.transition.type' WHEN 2 THEN 'segments.transition.type, duration' WHEN 3 THEN 'segments.keyframes.time'
  WHEN 4 THEN 'a value of the wrong type' WHEN 6 THEN 'aspect_ratio' WHEN 7 THEN 'quality.codec' WHEN 8 THEN 'resolution' WHEN 9 THEN 'a value of the wrong type' WHEN 10 THEN 'lut.path' WHEN 11 THEN 'overlays.keyframes.time'
  WHEN 12 THEN 'overlays.start, end, x, y, width, height' WHEN 14 THEN 'a value of the wrong type' WHEN 15 THEN 'segments.source_id, start, end' WHEN 16 THEN 'not a JSON object' WHEN 17 THEN 'not a JSON object' WHEN 18 THEN 'not a JSON object'
  WHEN 23 THEN 'resolution' WHEN 24 THEN 'aspect_ratio' WHEN 0 THEN NULL WHEN 5 THEN NULL WHEN 13 THEN NULL WHEN 30 THEN NULL ELSE 'a value of the wrong type' END AS problem FROM orders""",
    "spec_sources": with_(_DOCS) + " SELECT k AS spec_id, i AS position, id, path, tid AS transcript_id FROM srcs",
    "spec_segments": with_(_DOCS) + """ SELECT k AS spec_id, i AS position, source_id, start, "end", speed, tr AS transition, volume, afp AS audio_from_prev FROM segs""",
    "spec_keyframes": with_(_DOCS) + """ SELECT k AS spec_id, 'segment' AS of, i AS element, p AS position, p::DOUBLE AS time, CASE WHEN p = 0 THEN 1.5::DOUBLE END AS scale, CASE WHEN p = 1 THEN -0.5::DOUBLE END AS extra FROM segs, range(0, 2) r(p) WHERE (k + i) % 6 = 0
UNION ALL SELECT k, 'overlay', i, p, p * 0.5::DOUBLE, CASE WHEN p = 0 THEN 2.0::DOUBLE END, CASE WHEN p = 1 THEN 90.0::DOUBLE END FROM ovs, range(0, 2) r(p) WHERE k % 10 = 0""",
    "overlay_kind": with_(_DOCS) + " SELECT k AS spec_id, i AS position, ['video', 'color', 'text', 'image', 'color'][kd + 1] AS kind FROM ovs",
    "spec_validate": with_(_DOCS, _ISSUES) + " SELECT k AS spec_id, issue FROM issues",
    "spec_valid": with_(_DOCS, _ISSUES) + " SELECT g.k AS spec_id, COUNT(i.issue) AS issues, COUNT(i.issue) = 0 AS valid FROM good g LEFT JOIN issues i USING (k) GROUP BY g.k",
    "spec_merge": with_(_DOCS) + """ SELECT k AS spec_id, CASE WHEN k % 2 = 0 THEN '#FF0000' END AS color, CASE WHEN k % 12 = 0 THEN 6.5::DOUBLE END AS font_size, CASE WHEN k % 2 = 0 THEN false WHEN k % 3 = 0 THEN true END AS all_caps,
  CASE WHEN k % 7 = 2 THEN 'hevc' END AS codec, CASE WHEN k % 6 = 4 THEN 8000000 END AS bitrate, CASE WHEN k % 8 = 0 THEN 1 ELSE k % 4 END AS n_segments, CASE WHEN k % 10 = 0 THEN '/new.mp4' ELSE '/out/' || (c % 20) || '/r' || k || '.mp4' END AS output_path FROM good""",
    "preset_resolve": with_(_DOCS) + """ SELECT k AS spec_id, CASE WHEN pn = 'minimal' THEN 'minimal' END AS preset, CASE WHEN pn = 'minimal' THEN 'Helvetica' END AS font_family,
  CASE WHEN pn = 'nope' THEN NULL WHEN k % 4 = 0 THEN 6.5::DOUBLE WHEN pn = 'minimal' THEN 4.0::DOUBLE END AS font_size, CASE WHEN pn = 'nope' THEN NULL ELSE true END AS all_caps, CASE WHEN pn = 'minimal' THEN 4 END AS words_per_group,
  CASE WHEN pn = 'nope' THEN 'preset ''nope'' not found' END AS problem FROM (SELECT *, CASE WHEN k % 6 = 3 THEN 'none' WHEN k % 9 = 0 THEN 'nope' ELSE 'minimal' END AS pn FROM good WHERE k % 3 = 0)""",
    "rerender_naming": with_(RENDERS) + """ SELECT project_slug, slug AS of, slug || '-rerender' || CASE WHEN duration_seconds < 20 THEN '-2' ELSE '' END AS slug, replace(output_path, '.mp4', '_rerender.mp4') AS output_path FROM renders""",
    "spec_lineage": """WITH e AS (SELECT o_custkey, o_orderkey, unnest(['c' || (o_orderkey % 100), 'c' || ((o_orderkey * 7) % 100)]) AS source_slug FROM orders) SELECT source_slug, COUNT(*) AS uses, COUNT(DISTINCT o_orderkey) AS renders FROM e GROUP BY source_slug""",
    "numeric_coerce": "SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 0.0::DOUBLE WHEN 3 THEN NULL ELSE value END AS number FROM events",
}
