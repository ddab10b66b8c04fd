"""Timeline, caption, overlay and format queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeline_lake.catalog.sql import ASSETS, DURATIONS, KEYFRAMES, OVERLAYS, SEGMENTS, WORDS, with_
from timeline_lake.plans import captions as C
from timeline_lake.plans import formats as M
from timeline_lake.plans import overlays as O
from timeline_lake.plans import timeline as L
from timeline_lake.plans import views as V
from timeline_lake.session import cut_lineage
from timeline_lake.plans.transcripts import KEYS

SPEC = ["spec_id"]


def _micro(column: str):
    """Whole microseconds: sums of these do not depend on the order of addition."""
    return F.round(F.col(column) * 1e6).cast("long")


def _transcript_of(segments: DataFrame) -> DataFrame:
    return segments.filter("seg_index = 0").select(*SPEC, F.col("source_id").alias("transcript"))


def _source_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return V.words(spark, folder).groupBy(F.col("source_slug").alias("source_id")).agg(F.max("end_time").alias("source_length"))


def segment_timeline(spark: SparkSession, folder: str) -> DataFrame:
    return L.segment_timeline(V.segments(spark, folder)).select(*SPEC, "seg_index", "comp_start", "length")


def cross_cuts(spark: SparkSession, folder: str) -> DataFrame:
    return L.with_cross_cuts(V.segments(spark, folder)).select(*SPEC, "seg_index", "cross_cut")


def _rows(mapped: DataFrame, *more: str) -> DataFrame:
    """Words as they are placed, times in whole microseconds."""
    return mapped.select(*SPEC, *more, "word_index", "word", _micro("new_start").alias("start_us"), _micro("new_end").alias("end_us"))


def remap_single(spark: SparkSession, folder: str) -> DataFrame:
    segments = V.segments(spark, folder)
    return _rows(L.remap_single(V.words(spark, folder), segments, _transcript_of(segments)), "seg_index")


def remap_multi(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(L.remap_multi(V.words(spark, folder), V.segments(spark, folder)), "seg_index")


def remap_overlays(spark: SparkSession, folder: str) -> DataFrame:
    words, segments = V.words(spark, folder), V.segments(spark, folder)
    return L.remap_overlays(words, V.overlays(spark, folder), segments).select(
        *SPEC, "ov_index", "source_slug", "word_index", "word", "new_start", "new_end"
    )


def caption_words(spark: SparkSession, folder: str) -> DataFrame:
    captions = L.caption_words(V.words(spark, folder), V.overlays(spark, folder), V.segments(spark, folder))
    return _rows(captions, "part", "element")


def caption_text(spark: SparkSession, folder: str) -> DataFrame:
    captions = L.caption_words(V.words(spark, folder), V.overlays(spark, folder), V.segments(spark, folder), listed=True)
    return L.caption_text(captions).select(*SPEC, "part", "element", F.md5("text").alias("text_md5"))


def builder_timeline(spark: SparkSession, folder: str) -> DataFrame:
    return L.builder_timeline(V.segments(spark, folder)).select(
        *SPEC, "seg_index", "cross_cut", "comp_start", "length", "transition", "bridged", "speaker_index", "track"
    )


def bridge_audit(spark: SparkSession, folder: str) -> DataFrame:
    return L.bridge_audit(L.builder_timeline(V.segments(spark, folder)))


def caption_drift(spark: SparkSession, folder: str) -> DataFrame:
    segments = V.segments(spark, folder)
    return L.caption_drift(L.builder_timeline(segments), segments)


def cross_cut_overlays(spark: SparkSession, folder: str) -> DataFrame:
    """Overlays of cross-cuts; those of sources nobody knows come back with a problem."""
    known = _source_lengths(spark, folder).filter(F.substring("source_id", 2, 9).cast("int") % 7 != 5)
    return L.cross_cut_overlays(L.builder_timeline(V.segments(spark, folder)), known)


def _segment_times(segments: DataFrame) -> DataFrame:
    """Keyframes at the start, the middle and three quarters of every fourth segment."""
    length = (F.col("end") - F.col("start")) / F.coalesce("speed", F.lit(1.0))
    return segments.filter(F.pmod("seg_index", F.lit(4)) == 3).select(
        *SPEC, "seg_index", F.explode(F.array(F.lit(0.0), length * 0.5, length * 0.75)).alias("time")
    )


def _plan(spark: SparkSession, folder: str) -> DataFrame:
    segments = V.segments(spark, folder)
    return L.timeline_plan(L.builder_timeline(segments), _segment_times(segments))


def timeline_plan(spark: SparkSession, folder: str) -> DataFrame:
    return _plan(spark, folder)


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    return O.overlay_windows(V.overlays(spark, folder), _source_lengths(spark, folder), 1920, 1080)


def _split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Pieces of the timeline and what lies over them: overlays and cross-cuts. The layout is worked out once.

    Cross-cuts of unknown sources, which cannot be rendered, are reported by `cross_cut_overlays`.
    """
    segments, lengths = V.segments(spark, folder), cut_lineage(_source_lengths(spark, folder))
    layout = L.builder_timeline(segments)
    windows = O.overlay_windows(V.overlays(spark, folder), lengths, 1920, 1080)
    windows = cut_lineage(O.with_cross_cuts(windows, L.cross_cut_overlays(layout, lengths), 1920, 1080))
    return O.split_at_overlays(L.timeline_plan(layout, _segment_times(segments)), windows, ["seg_index", "kind", "piece"]), windows


def overlay_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _windows(spark, folder)


def interval_split(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder)[0]


def _visible(spark: SparkSession, folder: str) -> DataFrame:
    return O.overlays_in_pieces(*_split(spark, folder))


def interval_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return _visible(spark, folder).select(
        *SPEC, "seg_index", "kind", "piece", "ov_index", "cross_cut", _micro("piece_start").alias("start_us"), _micro("piece_end").alias("end_us")
    )


def fade_opacity(spark: SparkSession, folder: str) -> DataFrame:
    return O.fade_opacity(_visible(spark, folder)).select(
        *SPEC, "seg_index", "kind", "piece", "ov_index", "cross_cut", "piece_start",
        F.round(F.col("opacity_start") * 1e6).cast("long").alias("opacity_start_ppm"),
        F.round(F.col("opacity_end") * 1e6).cast("long").alias("opacity_end_ppm"),
    )


def keyframe_fill(spark: SparkSession, folder: str) -> DataFrame:
    return O.fill_keyframes(V.keyframes(spark, folder))


def keyframe_sample(spark: SparkSession, folder: str) -> DataFrame:
    marks = V.keyframes(spark, folder)
    points = marks.select("track_id", F.col("keyframe_id").alias("sample_id"), (F.col("time") + 1800.0).alias("time"))
    sampled = O.sample_keyframes(points, O.fill_keyframes(marks))
    return sampled.select("track_id", "sample_id", "time", *[F.round(F.col(c) * 1e6).cast("long").alias(f"{c}_ppm") for c in O.CHANNEL_DEFAULTS])


def _segment_keyframes(segments: DataFrame) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(t).alias("time"), s.alias("scale"), p.alias("pan_x")) for t, s, p in (
        (0.0, F.lit(None).cast("double"), F.lit(0.0)),
        (1.0, F.lit(1.5), F.lit(None).cast("double")),
        (2.0, F.lit(2.0), F.lit(-0.5)),
    )])
    portrait = F.pmod(F.col("spec_id"), F.lit(3)) == 1
    return segments.select(
        *SPEC, "seg_index", F.inline(steps),
    ).select(
        "*", F.lit(0.25).alias("pan_y"), F.when(portrait, F.lit(1080.0)).otherwise(F.lit(2560.0)).alias("width"),
        F.when(portrait, F.lit(1920.0)).otherwise(F.lit(1440.0)).alias("height"),
    )


def segment_transform_lerp(spark: SparkSession, folder: str) -> DataFrame:
    segments = V.segments(spark, folder)
    points = segments.select(*SPEC, "seg_index", (F.pmod("seg_index", F.lit(5)) * 0.625).alias("time"))
    at = O.segment_transform_at(points, O.segment_transforms(_segment_keyframes(segments), (1920, 1080)))
    return at.select(*SPEC, "seg_index", "time", *[F.round(F.col(c) * 1e6).cast("long").alias(f"{c}_ppm") for c in ("a", "tx", "ty")])


def _captions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    words = V.words(spark, folder)
    # The composition stops two seconds before the recording does, so the last words fall outside.
    totals = words.groupBy(*KEYS).agg((F.max("end_time") - 2.0).alias("total"))
    grouped = C.caption_groups(words, KEYS, totals, size=3)
    return grouped, C.caption_windows(grouped, KEYS)


def caption_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _captions(spark, folder)[0].select(*KEYS, "word_index", "position", "group_start")


def caption_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _captions(spark, folder)[1]


def _zones(spark: SparkSession, folder: str) -> DataFrame:
    quiet = V.overlays(spark, folder).filter(F.col("source_id").isNull() & (F.col("title").isNotNull() | F.col("image_path").isNotNull()))
    return quiet.select(
        F.concat(F.lit("p"), F.pmod("spec_id", F.lit(5))).alias("project_slug"), F.concat(F.lit("c"), "spec_id").alias("source_slug"),
        F.col("start").alias("zone_start"), F.col("end").alias("zone_end"),
    )


def caption_exclusion(spark: SparkSession, folder: str) -> DataFrame:
    windows = _captions(spark, folder)[1]
    return C.exclude_zones(windows, _zones(spark, folder), KEYS).select(*KEYS, "group_start", "start", "end")


def caption_highlights(spark: SparkSession, folder: str) -> DataFrame:
    return C.caption_highlights(*_captions(spark, folder), KEYS)


def caption_lines(spark: SparkSession, folder: str) -> DataFrame:
    # Only letters both engines raise alike: ß has no single upper-case letter.
    grouped = _captions(spark, folder)[0].withColumn("word", F.translate("word", "ß", "s"))
    return C.caption_lines(grouped, KEYS, all_caps=True, strip=True)


def audio_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return L.audio_schedule(L.builder_timeline(V.segments(spark, folder)))


def music_range(spark: SparkSession, folder: str) -> DataFrame:
    music = V.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("spec_id"), (F.pmod("o_custkey", F.lit(60)) * 0.5).alias("music_length"),
        F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.lit(0.5)).alias("music_volume"),
    )
    return L.music_range(L.composition_lengths(L.builder_timeline(V.segments(spark, folder))), music)


def remap_stats(spark: SparkSession, folder: str) -> DataFrame:
    segments = V.segments(spark, folder)
    return L.remap_stats(V.words(spark, folder), segments, _transcript_of(segments))


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    """Layout sections: a customer's orders in time order; a few have no duration."""
    names = F.array(*[F.lit(n) for n in ("pip_small", "pip_medium", "split", "speaker_focus", "screen_only", "speaker_only")])
    ratios = F.array(*[F.lit(r) for r in ("16:9", "9:16", "1:1", "4:5")])
    start = F.datediff("o_orderdate", F.lit("1990-01-01")).cast("double")
    return V.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("timeline_id"), F.col("o_orderkey").alias("section_id"),
        F.get(names, F.pmod("o_orderkey", F.lit(6)).cast("int")).alias("layout"),
        start.alias("start"), (start + F.when(F.pmod("o_orderkey", F.lit(97)) == 0, F.lit(0.0)).otherwise(F.pmod("o_orderkey", F.lit(40)) * 0.5 + 1)).alias("end"),
        F.get(ratios, F.pmod("o_custkey", F.lit(4)).cast("int")).alias("aspect_ratio"),
        F.lit("screen").alias("screen"), F.lit("cam").alias("speaker"), _style(F.pmod("o_custkey", F.lit(3))).alias("style"),
    )


def _style(turn):
    """Every third timeline has no style; of the others some give a radius and a crop, some a background without fades."""
    crop = F.struct(F.lit(0.25).alias("x"), F.lit(None).cast("double").alias("y"), F.lit(0.5).alias("width"), F.lit(None).cast("double").alias("height"))
    one = F.struct(F.lit(0.3).alias("corner_radius"), F.lit(None).cast("string").alias("background"), F.lit(0.8).alias("transition_duration"), crop.alias("speaker_crop"))
    two = F.struct(F.lit(0.0).alias("corner_radius"), F.lit("#000000").alias("background"), F.lit(0.0).alias("transition_duration"), F.when(F.lit(False), crop).alias("speaker_crop"))
    return F.when(turn == 1, one).when(turn == 2, two)


def layout_overlays(spark: SparkSession, folder: str) -> DataFrame:
    return M.layout_overlays(_sections(spark, folder), ["timeline_id"], F.floor(F.col("start") / 16.0).cast("long"))


def layout_problems(spark: SparkSession, folder: str) -> DataFrame:
    return M.layout_problems(_sections(spark, folder)).filter("problem is not null").select("timeline_id", "section_id", "problem")


def layout_summary(spark: SparkSession, folder: str) -> DataFrame:
    return M.layout_summary(_sections(spark, folder), ["timeline_id"])


def render_size(spark: SparkSession, folder: str) -> DataFrame:
    key = F.regexp_extract("slug", "(\\d+)$", 1).cast("long")
    ratios = F.array(*[F.lit(r) for r in ("16:9", "9:16", "1:1", "4:5")])
    presets = F.array(*[F.lit(r) for r in ("720p", "1080p", "4k")])
    requests = V.assets(spark, folder).select(
        "slug", "width", "height",
        F.get(ratios, F.pmod(key, F.lit(5)).cast("int")).alias("aspect_ratio"), F.get(presets, F.pmod(key, F.lit(4)).cast("int")).alias("resolution"),
        F.when(F.pmod(key, F.lit(50)) == 0, F.lit(640)).cast("long").alias("custom_width"),
        F.when(F.pmod(key, F.lit(50)) == 0, F.lit(360)).cast("long").alias("custom_height"),
    )
    return M.render_sizes(requests).select("slug", "render_width", "render_height")


def aspect_preview(spark: SparkSession, folder: str) -> DataFrame:
    return M.aspect_preview(V.assets(spark, folder))


def encode_params(spark: SparkSession, folder: str) -> DataFrame:
    return M.encode_params(V.assets(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        segment_timeline, cross_cuts, remap_single, remap_multi, remap_overlays, caption_words, caption_text, builder_timeline, bridge_audit,
        caption_drift, cross_cut_overlays, overlay_windows, interval_split, interval_overlap, fade_opacity, timeline_plan, keyframe_fill,
        keyframe_sample, segment_transform_lerp, caption_groups, caption_windows, caption_exclusion, caption_highlights, caption_lines,
        audio_schedule, music_range, layout_overlays, layout_problems, layout_summary, render_size, aspect_preview, encode_params, remap_stats,
    )
}

_CUTS = """
rated AS (SELECT *, COALESCE(speed, 1.0::DOUBLE) AS rate, ("end" - start) / COALESCE(speed, 1.0::DOUBLE) AS len,
  CASE WHEN transition_type = 'crossfade' THEN transition_duration END AS fade,
  seg_index > 0 AND COALESCE(audio_from_prev, COALESCE(volume, 1.0) = 0 AND lag(source_id) OVER (PARTITION BY spec_id ORDER BY seg_index) <> source_id) AS cc FROM segments)"""
_PLACED = """
pulled AS (SELECT *, CASE WHEN seg_index > 0 AND fade IS NOT NULL THEN least(fade, len) ELSE 0 END AS pull FROM rated),
placed AS (SELECT *, COALESCE(SUM(len - pull) OVER (PARTITION BY spec_id ORDER BY seg_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - pull AS comp FROM pulled),
speakers AS (SELECT *, COALESCE(SUM(len - pull) OVER (PARTITION BY spec_id ORDER BY seg_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - pull AS scomp FROM pulled WHERE NOT cc)"""
_SINGLE = """
hits AS (SELECT s.spec_id, s.seg_index, w.word_index, w.word, comp + (start_time - start) / rate AS new_start, comp + (least(end_time, "end") - start) / rate AS new_end,
  row_number() OVER (PARTITION BY s.spec_id, w.word_index ORDER BY s.seg_index) AS rn
  FROM placed s JOIN (SELECT spec_id, source_id AS transcript FROM segments WHERE seg_index = 0) t USING (spec_id)
  JOIN words w ON w.source_slug = t.transcript AND w.start_time >= s.start AND w.start_time < s."end"),
single AS (SELECT * FROM hits WHERE rn = 1 AND new_end > new_start)"""
_MULTI = """
multi AS (SELECT * FROM (SELECT s.spec_id, s.seg_index, w.word_index, w.word, scomp + (start_time - start) / rate AS new_start, scomp + (least(end_time, "end") - start) / rate AS new_end
  FROM speakers s JOIN words w ON w.source_slug = s.source_id AND w.start_time >= s.start AND w.start_time < s."end") WHERE new_end > new_start)"""
_OVER = """
own AS (SELECT *, COALESCE(source_start, 0.0::DOUBLE) AS b FROM overlays o WHERE source_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM segments s WHERE s.spec_id = o.spec_id AND s.source_id = o.source_id)),
over_words AS (SELECT * FROM (SELECT o.spec_id, o.ov_index, o.source_id AS source_slug, w.word_index, w.word, start + (start_time - b) / 1.0::DOUBLE AS new_start, start + (least(end_time, b + ("end" - start)) - b) / 1.0::DOUBLE AS new_end
  FROM own o JOIN words w ON w.source_slug = o.source_id AND w.start_time >= b AND w.start_time < b + ("end" - start)) WHERE new_end > new_start)"""
_US = "round(new_start * 1e6)::BIGINT AS start_us, round(new_end * 1e6)::BIGINT AS end_us"
_ALL_CAPTIONS = """
captions AS (SELECT spec_id, 0 AS part, seg_index AS element, word_index, word, new_start, new_end FROM multi
  UNION ALL SELECT spec_id, 1, ov_index, word_index, word, new_start, new_end FROM over_words)"""
_BUILD = """
ticks AS (SELECT *, round("end" * 600)::BIGINT - round(start * 600)::BIGINT AS l0 FROM rated),
ticked AS (SELECT *, CASE WHEN rate = 1.0 THEN l0 ELSE round(l0 / 600.0::DOUBLE / rate * 600)::BIGINT END AS l FROM ticks),
steps AS (SELECT *, CASE WHEN seg_index > 0 AND fade IS NOT NULL THEN round(least(fade, l / 600.0::DOUBLE) * 600)::BIGINT ELSE 0 END AS p FROM ticked),
walk AS (SELECT spec_id, seg_index, cc, l, p, 0::BIGINT AS t, false AS bridged, 0::BIGINT AS spk, 0::BIGINT AS track,
    l::BIGINT AS t_next, 1::BIGINT AS spk_next, []::STRUCT(a BIGINT, b BIGINT)[] AS shown FROM steps WHERE seg_index = 0
  UNION ALL SELECT s.spec_id, s.seg_index, s.cc, s.l, s.p, w.t_next - CASE WHEN s.cc OR x.br THEN 0 ELSE s.p END, x.br, w.spk_next,
    CASE WHEN s.cc THEN w.track WHEN x.br THEN w.track ELSE w.spk_next % 2 END,
    w.t_next + CASE WHEN s.cc THEN 0 WHEN x.br THEN s.l ELSE s.l - s.p END, w.spk_next + CASE WHEN s.cc THEN 0 ELSE 1 END,
    CASE WHEN s.cc THEN list_append(w.shown, {'a': w.t_next - s.p, 'b': w.t_next - s.p + s.l}) ELSE w.shown END
  FROM walk w JOIN steps s ON s.spec_id = w.spec_id AND s.seg_index = w.seg_index + 1,
  LATERAL (SELECT NOT s.cc AND s.p > 0 AND len(list_filter(w.shown, lambda r: r.a <= w.t_next - s.p AND r.b >= w.t_next)) > 0 AS br) x),
layout AS (SELECT w.spec_id, w.seg_index, s.source_id, s.start AS source_start, w.cc AS cross_cut, w.t / 600.0::DOUBLE AS comp_start, w.l / 600.0::DOUBLE AS length,
  CASE WHEN w.cc OR w.bridged THEN 0 ELSE w.p END / 600.0::DOUBLE AS transition, w.bridged, CASE WHEN NOT w.cc THEN w.spk END AS speaker_index,
  CASE WHEN NOT w.cc THEN w.track END AS track, COALESCE(s.volume, 1.0::DOUBLE) AS volume, COALESCE(s.fade, 0.0::DOUBLE) AS fade_in FROM walk w JOIN steps s USING (spec_id, seg_index)),
spk AS (SELECT *, lag(track) OVER o AS ptrack, lag(comp_start + length) OVER o AS pend, lag(volume) OVER o AS pvol, COALESCE(lead(transition) OVER o, 0) AS outgoing
  FROM layout WHERE NOT cross_cut WINDOW o AS (PARTITION BY spec_id ORDER BY seg_index))"""
_LENGTHS = """
source_lengths AS (SELECT source_slug AS source_id, MAX(end_time) AS source_length FROM words GROUP BY ALL)"""
_PLAN = """
stimes AS (SELECT spec_id, seg_index, unnest([0.0::DOUBLE, len * 0.5::DOUBLE, len * 0.75::DOUBLE]) AS a, unnest([len * 0.5::DOUBLE, len * 0.75::DOUBLE, NULL]) AS b, unnest([0, 1, 2]) AS piece FROM rated WHERE seg_index % 4 = 3),
plain AS (SELECT spec_id, seg_index, comp_start, comp_start + transition AS start, comp_start + length - outgoing AS "end" FROM spk WHERE comp_start + length - outgoing > comp_start + transition),
plan AS (SELECT spec_id, seg_index, 'crossfade' AS kind, 0 AS piece, comp_start AS start, comp_start + transition AS "end" FROM spk WHERE transition > 0
  UNION ALL SELECT spec_id, seg_index, 'plain', 0, start, "end" FROM plain WHERE seg_index % 4 <> 3
  UNION ALL SELECT * FROM (SELECT p.spec_id, p.seg_index, 'keyframed', piece, greatest(start, comp_start + a) AS s, least("end", comp_start + b) AS e FROM plain p JOIN stimes USING (spec_id, seg_index) WHERE b IS NOT NULL) WHERE e > s)"""
_WINDOWS = """
rated_ov AS (SELECT o.* REPLACE (round(start * 600) / 600.0::DOUBLE AS start), (round("end" * 600)::BIGINT - round(start * 600)::BIGINT) / 600.0::DOUBLE AS span, source_length - round(COALESCE(source_start, 0.0::DOUBLE) * 600) / 600.0::DOUBLE AS avail, least(greatest(COALESCE(speed, 1.0::DOUBLE), 0.25::DOUBLE), 4.0::DOUBLE) AS sp FROM overlays o LEFT JOIN source_lengths USING (source_id)),
shown_ov AS (SELECT *, CASE WHEN source_id IS NOT NULL AND COALESCE(span * sp > avail, false) THEN round(avail / sp * 600) / 600.0::DOUBLE ELSE span END AS d FROM rated_ov),
windows AS (SELECT spec_id, ov_index, source_id, COALESCE(z_index, 0) AS z, start AS overlay_start, start + d AS overlay_end, CASE WHEN source_id IS NOT NULL THEN sp END AS rate,
  CASE WHEN source_id IS NOT NULL THEN d * sp END AS source_used, x * 1920 AS "left", y * 1080 AS top, width * 1920 AS target_width, height * 1080 AS target_height,
  COALESCE(opacity, 1.0::DOUBLE) AS opacity, COALESCE(fade_in, 0.0::DOUBLE) AS fade_in, COALESCE(fade_out, 0.0::DOUBLE) AS fade_out FROM shown_ov)"""
_FRAMES = """
fx AS (SELECT *, first_value(CASE WHEN NOT cross_cut THEN fade_in END IGNORE NULLS) OVER (PARTITION BY spec_id ORDER BY seg_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nf FROM layout),
fc AS (SELECT *, least(length, source_length - round(source_start * 600) / 600.0::DOUBLE) AS d, comp_start - round(least(fade_in, length) * 600) / 600.0::DOUBLE AS s FROM fx JOIN source_lengths USING (source_id) WHERE cross_cut),
frames AS (SELECT spec_id, ov_index, overlay_start, overlay_end, opacity, fade_in, fade_out, false AS cross_cut FROM windows
  UNION ALL SELECT spec_id, seg_index, s, s + d, 1.0, fade_in, COALESCE(nf, 0.0::DOUBLE), true FROM fc WHERE d > 0)"""
_PIECES = _FRAMES + """,
cuts AS (SELECT DISTINCT spec_id, unnest([overlay_start, overlay_end, CASE WHEN fade_in > 0 THEN overlay_start + fade_in END, CASE WHEN fade_out > 0 THEN overlay_end - fade_out END]) AS cut FROM frames),
pts AS (SELECT spec_id, seg_index, kind, piece, start AS piece_start, "end" FROM plan UNION SELECT p.spec_id, seg_index, kind, piece, cut, "end" FROM plan p JOIN cuts c ON c.spec_id = p.spec_id AND cut > start AND cut < "end"),
pieces AS (SELECT spec_id, seg_index, kind, piece, piece_start, COALESCE(lead(piece_start) OVER (PARTITION BY spec_id, seg_index, kind, piece ORDER BY piece_start), "end") AS piece_end FROM pts)"""
_VISIBLE = """
visible AS (SELECT * FROM pieces p JOIN frames w USING (spec_id) WHERE greatest(piece_start, overlay_start) < least(piece_end, overlay_end))"""


def _opacity(t: str) -> str:
    return (
        f"CASE WHEN fade_in > 0 AND {t} < overlay_start + fade_in THEN opacity * least(greatest(({t} - overlay_start) / fade_in, 0.0), 1.0) "
        f"WHEN fade_out > 0 AND {t} > overlay_end - fade_out THEN opacity * least(greatest((overlay_end - {t}) / fade_out, 0.0), 1.0) ELSE opacity END"
    )


_FILLED = """
filled AS (SELECT track_id, keyframe_id, time, """ + ", ".join(
    f"COALESCE(last_value({c} IGNORE NULLS) OVER o, {d}::DOUBLE){' * 3.141592653589793::DOUBLE / 180.0::DOUBLE' if c == 'rotation' else ''} AS {c}"
    for c, d in O.CHANNEL_DEFAULTS.items()
) + """ FROM (SELECT *, COUNT(*) OVER (PARTITION BY track_id) AS n FROM keyframes) WHERE n >= 2
  WINDOW o AS (PARTITION BY track_id ORDER BY time, keyframe_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_CAPS = """
totals AS (SELECT project_slug, source_slug, MAX(end_time) - 2.0::DOUBLE AS total FROM words GROUP BY ALL),
valid AS (SELECT *, row_number() OVER (PARTITION BY project_slug, source_slug ORDER BY word_index) - 1 AS position FROM words JOIN totals USING (project_slug, source_slug)
  WHERE start_time >= 0 AND end_time > start_time AND start_time < total),
paused AS (SELECT *, CASE WHEN start_time - lag(end_time) OVER o > 1.0 OR lag(end_time) OVER o IS NULL THEN position END AS fresh FROM valid WINDOW o AS (PARTITION BY project_slug, source_slug ORDER BY position)),
isl AS (SELECT *, last_value(fresh IGNORE NULLS) OVER (PARTITION BY project_slug, source_slug ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i0 FROM paused),
grouped AS (SELECT *, position - (position - i0) % 3 AS group_start FROM isl),
spans AS (SELECT project_slug, source_slug, group_start, arg_min(start_time, position) AS start, arg_max(end_time, position) AS le, any_value(total) AS total, COUNT(*) AS n_words FROM grouped GROUP BY ALL),
capw AS (SELECT * FROM (SELECT project_slug, source_slug, group_start, start, least(le, total, COALESCE(lead(start) OVER (PARTITION BY project_slug, source_slug ORDER BY group_start), total)) AS "end", n_words FROM spans) WHERE "end" > start)"""
_SECTIONS = """
sections AS (SELECT o_custkey AS timeline_id, o_orderkey AS section_id, ['pip_small', 'pip_medium', 'split', 'speaker_focus', 'screen_only', 'speaker_only'][o_orderkey % 6 + 1] AS layout,
  date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::DOUBLE AS start, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::DOUBLE + CASE WHEN o_orderkey % 97 = 0 THEN 0.0::DOUBLE ELSE (o_orderkey % 40) * 0.5::DOUBLE + 1 END AS "end",
  ['16:9', '9:16', '1:1', '4:5'][o_custkey % 4 + 1] AS aspect_ratio FROM orders)"""


# Fixed values, written out once more so that the SQL does not follow the code: boxes of screen and speaker as x, y, width, height, radius.
_LAYOUT_ROWS = """
  ('landscape', 'pip_small', false, 0.0, 0.0, 1.0, 1.0, 0.0, 0.02, 0.72, 0.22, 0.25, 0.15),
  ('landscape', 'pip_medium', false, 0.0, 0.0, 1.0, 1.0, 0.0, 0.02, 0.55, 0.35, 0.4, 0.12),
  ('landscape', 'split', true, 0.38, 0.04, 0.58, 0.92, 0.04, 0.04, 0.15, 0.3, 0.7, 0.08),
  ('landscape', 'speaker_focus', true, 0.58, 0.55, 0.38, 0.4, 0.04, 0.1, 0.08, 0.55, 0.84, 0.06),
  ('landscape', 'screen_only', false, 0.0, 0.0, 1.0, 1.0, 0.0, NULL, NULL, NULL, NULL, NULL),
  ('landscape', 'speaker_only', false, NULL, NULL, NULL, NULL, NULL, 0.0, 0.0, 1.0, 1.0, 0.0),
  ('portrait', 'pip_small', false, 0.0, 0.0, 1.0, 1.0, 0.0, 0.3, 0.78, 0.4, 0.18, 0.15),
  ('portrait', 'pip_medium', false, 0.0, 0.0, 1.0, 1.0, 0.0, 0.2, 0.65, 0.6, 0.3, 0.12),
  ('portrait', 'split', true, 0.04, 0.02, 0.92, 0.52, 0.04, 0.1, 0.58, 0.8, 0.38, 0.06),
  ('portrait', 'speaker_focus', true, 0.15, 0.6, 0.7, 0.35, 0.04, 0.05, 0.04, 0.9, 0.52, 0.04),
  ('portrait', 'screen_only', false, 0.0, 0.0, 1.0, 1.0, 0.0, NULL, NULL, NULL, NULL, NULL),
  ('portrait', 'speaker_only', false, NULL, NULL, NULL, NULL, NULL, 0.0, 0.0, 1.0, 1.0, 0.0),
  ('square', 'pip_small', false, 0.0, 0.0, 1.0, 1.0, 0.0, 0.02, 0.72, 0.26, 0.26, 0.15),
  ('square', 'pip_medium', false, 0.0, 0.0, 1.0, 1.0, 0.0, 0.02, 0.55, 0.4, 0.4, 0.12),
  ('square', 'split', true, 0.38, 0.04, 0.58, 0.92, 0.04, 0.04, 0.15, 0.3, 0.7, 0.08),
  ('square', 'speaker_focus', true, 0.58, 0.55, 0.38, 0.4, 0.04, 0.1, 0.08, 0.55, 0.84, 0.06),
  ('square', 'screen_only', false, 0.0, 0.0, 1.0, 1.0, 0.0, NULL, NULL, NULL, NULL, NULL),
  ('square', 'speaker_only', false, NULL, NULL, NULL, NULL, NULL, 0.0, 0.0, 1.0, 1.0, 0.0)"""

_LAYOUTS = """
presets AS (SELECT family, layout, bg, sx::DOUBLE AS sx, sy::DOUBLE AS sy, sw::DOUBLE AS sw, sh::DOUBLE AS sh, sr::DOUBLE AS sr, px::DOUBLE AS px, py::DOUBLE AS py, pw::DOUBLE AS pw, ph::DOUBLE AS ph, pr::DOUBLE AS pr
  FROM (VALUES """ + _LAYOUT_ROWS + """) v(family, layout, bg, sx, sy, sw, sh, sr, px, py, pw, ph, pr)),
sound AS (SELECT * FROM sections WHERE "end" > start AND timeline_id NOT IN (SELECT timeline_id FROM sections WHERE "end" <= start)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY timeline_id ORDER BY start, section_id) - 1 AS position, COUNT(*) OVER (PARTITION BY timeline_id) AS n,
  CASE aspect_ratio WHEN '9:16' THEN 'portrait' WHEN '16:9' THEN 'landscape' ELSE 'square' END AS family FROM sound),
laidout AS (SELECT * , CASE WHEN position > 0 THEN 0.4::DOUBLE END AS fade_in, CASE WHEN position < n - 1 THEN 0.4::DOUBLE END AS fade_out FROM ordered JOIN presets USING (family, layout))"""

_CROP = """
req AS (SELECT slug, p_partkey AS k, width::DOUBLE AS w, height::DOUBLE AS h, [16.0::DOUBLE / 9.0::DOUBLE, 9.0::DOUBLE / 16.0::DOUBLE, 1.0::DOUBLE, 4.0::DOUBLE / 5.0::DOUBLE][p_partkey % 5 + 1] AS r,
  [720.0::DOUBLE, 1080.0::DOUBLE, 2160.0::DOUBLE][p_partkey % 4 + 1] AS s FROM assets),
base AS (SELECT *, CASE WHEN r IS NULL THEN w WHEN w / h > r THEN floor(h * r / 2.0) * 2.0 ELSE w END AS bw, CASE WHEN r IS NULL THEN h WHEN w / h > r THEN h ELSE floor(w / r / 2.0) * 2.0 END AS bh FROM req)"""

_SEGKEYS = """
sk AS (SELECT spec_id, seg_index, unnest([0.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE]) AS kt, unnest([1.0::DOUBLE, 1.5::DOUBLE, 2.0::DOUBLE]) AS sc, unnest([0.0::DOUBLE, 0.0::DOUBLE, -0.5::DOUBLE]) AS pan,
  CASE WHEN spec_id % 3 = 1 THEN 1080.0::DOUBLE ELSE 2560.0::DOUBLE END AS w, CASE WHEN spec_id % 3 = 1 THEN 1920.0::DOUBLE ELSE 1440.0::DOUBLE END AS h FROM segments),
tf AS (SELECT *, greatest(1920.0::DOUBLE / w, 1080.0::DOUBLE / h) * sc AS a FROM sk),
tx AS (SELECT *, (1920.0::DOUBLE - w * a) / 2.0 + pan * (greatest(0.0, (w * a - 1920.0) / 2.0) + 960.0) AS tx, (1080.0::DOUBLE - h * a) / 2.0 + 0.25::DOUBLE * (greatest(0.0, (h * a - 1080.0) / 2.0) + 540.0) AS ty FROM tf),
pt AS (SELECT spec_id, seg_index, (seg_index % 5) * 0.625::DOUBLE AS time FROM segments),
lr AS (SELECT p.*, (SELECT arg_max({'t': kt, 'a': a, 'tx': tx, 'ty': ty}, kt) FROM tx x WHERE x.spec_id = p.spec_id AND x.seg_index = p.seg_index AND kt <= p.time) AS l,
  (SELECT arg_min({'t': kt, 'a': a, 'tx': tx, 'ty': ty}, kt) FROM tx x WHERE x.spec_id = p.spec_id AND x.seg_index = p.seg_index AND kt >= p.time) AS r FROM pt p),
sh AS (SELECT *, CASE WHEN r.t > l.t THEN (time - l.t) / (r.t - l.t) ELSE 0.0::DOUBLE END AS q FROM lr)"""

_D = SEGMENTS + "," + _CUTS
ORACLES = {
    "segment_timeline": with_(_D, _PLACED) + " SELECT spec_id, seg_index, comp AS comp_start, len AS length FROM placed",
    "cross_cuts": with_(_D) + " SELECT spec_id, seg_index, cc AS cross_cut FROM rated",
    "remap_single": with_(WORDS, _D, _PLACED, _SINGLE) + f" SELECT spec_id, seg_index, word_index, word, {_US} FROM single",
    "remap_multi": with_(WORDS, _D, _PLACED, _MULTI) + f" SELECT spec_id, seg_index, word_index, word, {_US} FROM multi",
    "remap_overlays": with_(WORDS, SEGMENTS, OVERLAYS, _OVER) + " SELECT * FROM over_words",
    "caption_words": with_(WORDS, _D, OVERLAYS, _PLACED, _MULTI, _OVER, _ALL_CAPTIONS) + f" SELECT spec_id, part, element, word_index, word, {_US} FROM captions",
    "caption_text": with_(WORDS, _D, OVERLAYS, _PLACED, _MULTI, _OVER, _ALL_CAPTIONS) + " SELECT spec_id, part, element, md5(string_agg(word, ' ' ORDER BY word_index)) AS text_md5 FROM captions GROUP BY ALL",
    "builder_timeline": with_(_D, _BUILD) + " SELECT spec_id, seg_index, cross_cut, comp_start, length, transition, bridged, speaker_index, track FROM layout",
    "bridge_audit": with_(_D, _BUILD) + " SELECT spec_id, seg_index, track = ptrack AS same_track, comp_start = pend AS back_to_back, transition = 0 AS zero_transition FROM spk WHERE bridged",
    "caption_drift": with_(_D, _BUILD, _PLACED) + " SELECT k.spec_id, k.seg_index, k.comp_start - s.scomp AS drift FROM spk k JOIN speakers s USING (spec_id, seg_index)",
    "cross_cut_overlays": with_(WORDS, _D, _BUILD, _LENGTHS)
    + """, nx AS (SELECT *, first_value(CASE WHEN NOT cross_cut THEN fade_in END IGNORE NULLS) OVER (PARTITION BY spec_id ORDER BY seg_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nf FROM layout),
known AS (SELECT * FROM source_lengths WHERE CAST(substr(source_id, 2, 9) AS INT) % 7 <> 5),
cutov AS (SELECT *, least(length, source_length - round(source_start * 600) / 600.0::DOUBLE) AS d, comp_start - round(least(fade_in, length) * 600) / 600.0::DOUBLE AS s FROM nx LEFT JOIN known USING (source_id) WHERE cross_cut)
SELECT spec_id, seg_index, source_id, CASE WHEN source_length IS NOT NULL THEN s END AS overlay_start, CASE WHEN source_length IS NOT NULL THEN s + d END AS overlay_end, fade_in, COALESCE(nf, 0.0::DOUBLE) AS fade_out, CASE WHEN source_length IS NULL THEN 'unknown source' END AS problem
FROM cutov WHERE d > 0 OR source_length IS NULL""",
    "overlay_windows": with_(WORDS, OVERLAYS, _LENGTHS, _WINDOWS) + " SELECT * FROM windows",
    "timeline_plan": with_(_D, _BUILD, _PLAN) + " SELECT * FROM plan",
    "interval_split": with_(WORDS, _D, _BUILD, _PLAN, OVERLAYS, _LENGTHS, _WINDOWS, _PIECES) + " SELECT * FROM pieces",
    "interval_overlap": with_(WORDS, _D, _BUILD, _PLAN, OVERLAYS, _LENGTHS, _WINDOWS, _PIECES, _VISIBLE)
    + " SELECT spec_id, seg_index, kind, piece, ov_index, cross_cut, round(piece_start * 1e6)::BIGINT AS start_us, round(piece_end * 1e6)::BIGINT AS end_us FROM visible",
    "fade_opacity": with_(WORDS, _D, _BUILD, _PLAN, OVERLAYS, _LENGTHS, _WINDOWS, _PIECES, _VISIBLE)
    + f""", op AS (SELECT *, {_opacity('piece_start')} AS o1, {_opacity('piece_end')} AS o2 FROM visible)
SELECT spec_id, seg_index, kind, piece, ov_index, cross_cut, piece_start, round(o1 * 1e6)::BIGINT AS opacity_start_ppm, CASE WHEN abs(o1 - o2) > 0.001 THEN round(o2 * 1e6)::BIGINT END AS opacity_end_ppm FROM op""",
    "keyframe_fill": with_(KEYFRAMES, _FILLED) + " SELECT * FROM filled",
    "keyframe_sample": with_(KEYFRAMES, _FILLED)
    + """, pts AS (SELECT track_id, keyframe_id AS sample_id, time + 1800.0::DOUBLE AS time FROM keyframes SEMI JOIN filled USING (track_id)),
b AS (SELECT p.*, a.keyframe_id AS k, a.time AS lt, """
    + ", ".join(f"a.{c} AS a_{c}" for c in O.CHANNEL_DEFAULTS)
    + " FROM pts p ASOF LEFT JOIN filled a ON a.track_id = p.track_id AND a.time <= p.time), c AS (SELECT b.*, n.time AS nt, "
    + ", ".join(f"n.{c} AS n_{c}" for c in O.CHANNEL_DEFAULTS)
    + " FROM b ASOF LEFT JOIN filled n ON n.track_id = b.track_id AND n.time >= b.time) SELECT track_id, sample_id, time, "
    + ", ".join(
        f"round(CASE WHEN lt IS NULL THEN n_{c} WHEN nt IS NULL THEN a_{c} ELSE a_{c} + (n_{c} - a_{c}) * CASE WHEN nt > lt THEN (time - lt) / (nt - lt) ELSE 0.0 END END * 1e6)::BIGINT AS {c}_ppm"
        for c in O.CHANNEL_DEFAULTS
    )
    + " FROM c",
    "segment_transform_lerp": with_(SEGMENTS, _SEGKEYS)
    + " SELECT spec_id, seg_index, time, "
    + ", ".join(f"round(COALESCE(l.{c} + (r.{c} - l.{c}) * q, l.{c}, r.{c}) * 1e6)::BIGINT AS {c}_ppm" for c in ("a", "tx", "ty"))
    + " FROM sh",
    "caption_groups": with_(WORDS, _CAPS) + " SELECT project_slug, source_slug, word_index, position, group_start FROM grouped",
    "caption_windows": with_(WORDS, _CAPS) + " SELECT * FROM capw",
    "caption_exclusion": with_(WORDS, OVERLAYS, _CAPS)
    + """ SELECT project_slug, source_slug, group_start, start, "end" FROM capw c WHERE NOT EXISTS (SELECT 1 FROM overlays o WHERE o.source_id IS NULL AND (title IS NOT NULL OR image_path IS NOT NULL)
  AND 'c' || o.spec_id = c.source_slug AND c.start < o."end" AND c."end" > o.start)""",
    "caption_highlights": with_(WORDS, _CAPS)
    + """ SELECT project_slug, source_slug, group_start, position, word, greatest(start_time, start) AS lit_from, greatest(least(end_time, "end"), greatest(start_time, start) + 0.01::DOUBLE) AS lit_until
FROM grouped JOIN capw USING (project_slug, source_slug, group_start)""",
    "caption_lines": with_(WORDS, _CAPS)
    + r""" SELECT project_slug, source_slug, group_start, string_agg(upper(regexp_replace(replace(word, 'ß', 's'), '[^\P{P}''’]', '', 'g')), ' ' ORDER BY position) AS text FROM grouped GROUP BY ALL""",
    "audio_schedule": with_(_D, _BUILD)
    + """ SELECT spec_id, seg_index, 'ramp_out' AS action, ptrack AS track, comp_start AS start, comp_start + transition AS "end", pvol AS from_volume, 0.0::DOUBLE AS to_volume FROM spk WHERE transition > 0
UNION ALL SELECT spec_id, seg_index, 'ramp_in', track, comp_start, comp_start + transition, 0.0, volume FROM spk WHERE transition > 0
UNION ALL SELECT spec_id, seg_index, 'set', track, comp_start + transition, NULL, NULL, volume FROM spk WHERE volume <> 1.0""",
    "music_range": with_(_D, _BUILD)
    + """ SELECT spec_id, least((o_custkey % 60) * 0.5::DOUBLE, d) AS music_end, CASE WHEN o_orderkey % 2 = 0 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS volume
FROM (SELECT spec_id, SUM(length - transition) AS d FROM spk GROUP BY spec_id) JOIN orders ON o_orderkey = spec_id""",
    "layout_overlays": with_(_SECTIONS, _LAYOUTS)
    + """, faded AS (SELECT * REPLACE (CASE WHEN fade_in IS NULL OR timeline_id % 3 = 2 THEN NULL WHEN timeline_id % 3 = 1 THEN 0.8::DOUBLE ELSE fade_in END AS fade_in,
  CASE WHEN fade_out IS NULL OR timeline_id % 3 = 2 THEN NULL WHEN timeline_id % 3 = 1 THEN 0.8::DOUBLE ELSE fade_out END AS fade_out) FROM laidout),
crops AS (SELECT t, x AS crop_x, 0.0::DOUBLE AS crop_y, w AS crop_width, 1.0::DOUBLE AS crop_height FROM (VALUES (1, 0.25::DOUBLE, 0.5::DOUBLE)) v(t, x, w))
SELECT timeline_id, position, start, "end", fade_in, fade_out, 0 AS z_index, NULL::VARCHAR AS source_id, NULL::DOUBLE AS source_start, NULL::DOUBLE AS audio,
  CASE WHEN timeline_id % 3 = 2 THEN '#000000' ELSE '#1a1a2e' END AS background_color, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 1.0::DOUBLE AS width, 1.0::DOUBLE AS height, NULL::DOUBLE AS corner_radius,
  NULL::DOUBLE AS crop_x, NULL::DOUBLE AS crop_y, NULL::DOUBLE AS crop_width, NULL::DOUBLE AS crop_height FROM faded WHERE bg
UNION ALL SELECT timeline_id, position, start, "end", fade_in, fade_out, 1, 'screen', start, 0.0, NULL, sx, sy, sw, sh, CASE WHEN sr > 0 THEN sr END, NULL, NULL, NULL, NULL FROM faded WHERE sx IS NOT NULL
UNION ALL SELECT timeline_id, position, start, "end", fade_in, fade_out, 2, 'cam', start, 0.0, NULL, px, py, pw, ph,
  CASE WHEN pr > 0 THEN pr WHEN timeline_id % 3 = 1 THEN 0.3::DOUBLE WHEN timeline_id % 3 = 0 THEN 0.15::DOUBLE END, crop_x, crop_y, crop_width, crop_height
  FROM faded LEFT JOIN crops ON t = timeline_id % 3 WHERE px IS NOT NULL""",
    "layout_problems": with_(_SECTIONS) + """ SELECT timeline_id, section_id, 'end must be after start' AS problem FROM sections WHERE "end" <= start""",
    "layout_summary": with_(_SECTIONS)
    + """ SELECT timeline_id, COUNT(*) AS sections, array_to_string(list_sort(list(DISTINCT layout)), ', ') AS layouts, SUM("end" - start) AS seconds FROM sections WHERE timeline_id NOT IN (SELECT timeline_id FROM sections WHERE "end" <= start) GROUP BY timeline_id""",
    "render_size": with_(ASSETS, _CROP)
    + """ SELECT slug, CASE WHEN k % 50 = 0 THEN 640 WHEN s IS NULL THEN bw::BIGINT ELSE (floor(bw * (s / least(bw, bh)) / 2.0) * 2.0)::BIGINT END AS render_width,
  CASE WHEN k % 50 = 0 THEN 360 WHEN s IS NULL THEN bh::BIGINT ELSE (floor(bh * (s / least(bw, bh)) / 2.0) * 2.0)::BIGINT END AS render_height FROM base""",
    "aspect_preview": with_(ASSETS)
    + """, four AS (SELECT project_slug, slug, width::DOUBLE AS w, height::DOUBLE AS h, unnest(['16:9', '9:16', '1:1', '4:5']) AS aspect_ratio,
  unnest([16.0::DOUBLE / 9.0::DOUBLE, 9.0::DOUBLE / 16.0::DOUBLE, 1.0::DOUBLE, 4.0::DOUBLE / 5.0::DOUBLE]) AS r FROM assets),
cropped AS (SELECT *, w / h AS sr, CASE WHEN w / h > r THEN floor(h * r / 2.0) * 2.0 ELSE w END AS ow, CASE WHEN w / h > r THEN h ELSE floor(w / r / 2.0) * 2.0 END AS oh FROM four)
SELECT project_slug, slug, CASE WHEN abs(sr - 16.0 / 9.0) < 0.01 THEN '16:9' WHEN abs(sr - 9.0 / 16.0) < 0.01 THEN '9:16' WHEN abs(sr - 1) < 0.01 THEN '1:1' WHEN abs(sr - 0.8) < 0.01 THEN '4:5'
  WHEN abs(sr - 4.0 / 3.0) < 0.01 THEN '4:3' WHEN abs(sr - 0.75) < 0.01 THEN '3:4' WHEN abs(sr - 21.0 / 9.0) < 0.01 THEN '21:9' ELSE printf('%.2f:1', sr) END AS source_ratio,
  aspect_ratio, ow::BIGINT AS out_width, oh::BIGINT AS out_height, CASE WHEN abs(sr - r) < 0.01 THEN 'matches source — no crop'
  WHEN sr > r THEN 'crops ' || round((1.0 - ow / w) * 100)::BIGINT || '% from sides' ELSE 'crops ' || round((1.0 - oh / h) * 100)::BIGINT || '% from top/bottom' END AS note FROM cropped""",
    "encode_params": with_(ASSETS)
    + """ SELECT project_slug, slug, CASE WHEN fps IN (29.97, 23.976) THEN 1001 WHEN fps = 60.0 THEN 1 ELSE round(600.0 / fps)::BIGINT END AS frame_value,
  CASE WHEN fps = 29.97 THEN 30000 WHEN fps = 23.976 THEN 24000 WHEN fps = 60.0 THEN 60 ELSE 600 END AS frame_timescale,
  CASE WHEN codec = 'hevc' THEN CASE WHEN greatest(width, height) >= 3840 OR least(width, height) >= 2160 THEN 50000000 WHEN greatest(width, height) >= 1920 OR least(width, height) >= 1080 THEN 18000000 ELSE 6000000 END
    ELSE CASE WHEN greatest(width, height) >= 3840 OR least(width, height) >= 2160 THEN 45000000 WHEN greatest(width, height) >= 1920 OR least(width, height) >= 1080 THEN 10000000 ELSE 4000000 END END AS bitrate FROM assets""",
    "remap_stats": with_(WORDS, _D, _PLACED, _SINGLE)
    + """, ln AS (SELECT spec_id, SUM(len - pull) AS duration FROM pulled GROUP BY spec_id),
bf AS (SELECT spec_id, n FROM (SELECT spec_id, source_id FROM segments WHERE seg_index = 0) JOIN (SELECT source_slug, COUNT(*) AS n FROM words GROUP BY source_slug) ON source_slug = source_id),
af AS (SELECT spec_id, COUNT(*) AS n, list(word ORDER BY word_index)[:3] AS ws, arg_min(new_start, word_index) AS fs FROM single GROUP BY spec_id)
SELECT ln.spec_id, duration, COALESCE(bf.n, 0) AS words_before, COALESCE(af.n, 0) AS words_after, COALESCE(bf.n, 0) - COALESCE(af.n, 0) AS words_dropped,
  array_to_string(ws, ' ') AS first_words, round(fs * 1000) / 1000.0::DOUBLE AS first_start, COALESCE(bf.n, 0) > 0 AND COALESCE(af.n, 0) = 0 AS failed
FROM ln LEFT JOIN bf USING (spec_id) LEFT JOIN af USING (spec_id)""",
}
