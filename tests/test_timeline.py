import random

import pytest
from pyspark.sql import functions as F

from timeline_lake.plans import captions as C
from timeline_lake.plans import formats as M
from timeline_lake.plans import overlays as O
from timeline_lake.plans import timeline as L

SEGMENT = (
    "spec_id bigint, seg_index bigint, source_id string, start double, end double, speed double, transition_type string, "
    "transition_duration double, volume double, audio_from_prev boolean"
)
WORD = "project_slug string, source_slug string, word_index bigint, word string, start_time double, end_time double, confidence double"
OVERLAY = "spec_id bigint, ov_index bigint, source_id string, start double, end double, source_start double"


def segs(spark, *segments):
    rows = []
    for i, s in enumerate(segments):
        s = {"source": "a", "speed": None, "fade": None, "volume": None, "prev": None, **s}
        rows.append((1, i, s["source"], float(s["start"]), float(s["end"]), s["speed"], "crossfade" if s["fade"] else None, s["fade"], s["volume"], s["prev"]))
    return spark.createDataFrame(rows, SEGMENT)


def said(spark, source, *words):
    return spark.createDataFrame([("p", source, i, w, float(a), float(b), None) for i, (w, a, b) in enumerate(words)], WORD)


def single(spark, words, *segments):
    transcript = spark.createDataFrame([(1, "a")], "spec_id bigint, transcript string")
    got = L.remap_single(said(spark, "a", *words), segs(spark, *segments), transcript).orderBy("word_index").collect()
    return [(r.word, r.new_start, r.new_end) for r in got]


@pytest.mark.parametrize(
    "words,segments,expected",
    [
        ([("Hello", 5, 5.5), ("world", 5.5, 6)], [{"start": 5, "end": 6}], [("Hello", 0, 0.5), ("world", 0.5, 1)]),
        ([("first", 0, 0.5), ("second", 3, 3.5)], [{"start": 0, "end": 1}, {"start": 3, "end": 4}], [("first", 0, 0.5), ("second", 1, 1.5)]),
        ([("keep", 0, 0.5), ("drop", 1.5, 2), ("keep2", 3, 3.5)], [{"start": 0, "end": 1}, {"start": 3, "end": 4}], [("keep", 0, 0.5), ("keep2", 1, 1.5)]),
        ([("x", 0, 1), ("y", 1, 2)], [{"start": 0, "end": 2, "speed": 2.0}], [("x", 0, 0.5), ("y", 0.5, 1)]),
        ([("x", 0, 0.5)], [{"start": 0, "end": 1, "speed": 0.5}], [("x", 0, 1)]),
        ([("x", 0.8, 1.5)], [{"start": 0, "end": 1}], [("x", 0.8, 1.0)]),
    ],
)
def test_single_remap(spark, words, segments, expected):
    assert single(spark, words, *segments) == expected


def test_multi_remap_and_cross_cut(spark):
    words = said(spark, "main", ("in0", 6, 6.2), ("g1", 8.5, 8.7), ("g2", 8.9, 9), ("g3", 9.3, 9.5), ("in2", 11.2, 11.4))
    segments = segs(spark, {"source": "main", "start": 5, "end": 8}, {"source": "broll", "start": 0, "end": 5, "volume": 0.0}, {"source": "main", "start": 10, "end": 13})
    assert [r.cross_cut for r in L.with_cross_cuts(segments, rows=2).orderBy("seg_index").collect()] == [False, True, False]
    got = {r.word: r.new_start for r in L.remap_multi(words, segments, rows=2).collect()}
    assert set(got) == {"in0", "in2"} and got["in0"] == 1.0 and abs(got["in2"] - 4.2) < 1e-9


def test_overlay_remap(spark):
    words = said(spark, "cam", ("w1", 1, 1.5), ("w5", 5, 5.5), ("w12", 12, 12.5), ("w7", 10.5, 12))
    overlay = spark.createDataFrame([(1, 0, "cam", 0.0, 8.0, 3.0), (1, 1, "screen", 0.0, 8.0, None)], OVERLAY)
    got = L.remap_overlays(words, overlay, segs(spark, {"source": "screen", "start": 0, "end": 9})).collect()
    assert sorted((r.word, r.new_start, r.new_end) for r in got) == [("w5", 2.0, 2.5), ("w7", 7.5, 8.0)]


def walked_layout(rows):
    """The renderer's walk in whole seconds: (start, transition, bridged, track) per speaker."""
    t, shown, speakers, out, track = 0.0, [], 0, {}, 0
    for i, s in enumerate(rows):
        length = s["end"] - s["start"]
        prev = rows[i - 1] if i else None
        cut = i > 0 and (s["prev"] if s["prev"] is not None else s["volume"] == 0.0 and prev["source"] != s["source"])
        fade = min(s["fade"], length) if s["fade"] else 0.0
        if cut:
            shown.append((t - fade, t - fade + length))
            continue
        bridged = False
        pull = 0.0
        if speakers > 0 and s["fade"]:
            bridged = any(a <= t - fade and b >= t for a, b in shown)
            pull = 0.0 if bridged else fade
        track = track if bridged else speakers % 2
        out[i] = (t - pull, pull, bridged, track)
        t += length - pull
        speakers += 1
    return out


@pytest.mark.parametrize("rows,part", [(2, 1), (1 << 18, 3), (1 << 18, 512)])
def test_builder_timeline_equals_the_walk(spark, rows, part):
    rng = random.Random(5)
    frames, expected, bridged = [], {}, 0
    for spec in range(40):
        segments = []
        for _ in range(rng.randint(1, 12)):
            start = rng.randint(0, 5)
            segments.append({"source": rng.choice("ab"), "start": start, "end": start + rng.choice([1, 2, 9]), "fade": rng.choice([None, 0.5, 1.0, 2.0]), "volume": rng.choice([None, 0.0]), "prev": rng.choice([None, None, True, False])})
        frames += [(spec, i, s["source"], float(s["start"]), float(s["end"]), None, "crossfade" if s["fade"] else None, s["fade"], s["volume"], s["prev"]) for i, s in enumerate(segments)]
        for i, value in walked_layout(segments).items():
            expected[(spec, i)] = value
            bridged += value[2]
    layout = L.builder_timeline(spark.createDataFrame(frames, SEGMENT), rows, part)
    got = {(r.spec_id, r.seg_index): (r.comp_start, r.transition, r.bridged, r.track) for r in layout.filter("not cross_cut").collect()}
    assert bridged > 5 and got == expected
    audit = L.bridge_audit(layout, rows).collect()
    assert len(audit) == bridged and all(r.same_track and r.back_to_back and r.zero_transition for r in audit)


WINDOW = "spec_id bigint, ov_index bigint, overlay_start double, overlay_end double, fade_in double, fade_out double, opacity double"


def test_split_and_fades(spark):
    ranges = spark.createDataFrame([(1, 0, 0.0, 10.0)], "spec_id bigint, id bigint, start double, end double")
    windows = spark.createDataFrame([(1, 0, 2.0, 6.0, 1.0, 1.0, 1.0)], WINDOW)
    pieces = O.split_at_overlays(ranges, windows, ["id"])
    assert sorted((r.piece_start, r.piece_end) for r in pieces.collect()) == [(0, 2), (2, 3), (3, 5), (5, 6), (6, 10)]
    faded = O.fade_opacity(O.overlays_in_pieces(pieces, windows)).orderBy("piece_start").collect()
    assert [(r.opacity_start, r.opacity_end) for r in faded] == [(0.0, 1.0), (1.0, None), (1.0, 0.0)]


def test_keyframes(spark):
    frames = spark.createDataFrame(
        [("k", 1, 0.0, 2.0, None, None, None, None), ("k", 2, 100_000.0, None, 0.5, None, None, 90.0), ("lone", 3, 0.0, 1.0, None, None, None, None)],
        "track_id string, keyframe_id bigint, time double, scale double, opacity double, x double, y double, rotation double",
    )
    filled = O.fill_keyframes(frames)
    assert [(r.time, r.scale, r.opacity) for r in filled.orderBy("time").collect()] == [(0.0, 2.0, 1.0), (100_000.0, 2.0, 0.5)]
    points = spark.createDataFrame([("k", -1.0), ("k", 50_000.0), ("k", 100_000.0), ("k", 9e5)], "track_id string, time double")
    assert [r.opacity for r in O.sample_keyframes(points, filled).orderBy("time").collect()] == [1.0, 0.75, 0.5, 0.5]


def test_caption_groups(spark):
    words = [(f"w{i}", i * 0.5, i * 0.5 + 0.4) for i in range(4)] + [("late", 3.1, 3.4)]
    rows = [("k", i, w, a, b) for i, (w, a, b) in enumerate(words)]
    frame = spark.createDataFrame(rows, "id string, word_index bigint, word string, start_time double, end_time double")
    totals = spark.createDataFrame([("k", 3.3)], "id string, total double")
    for block in (2, 1 << 18):
        grouped = C.caption_groups(frame, ["id"], totals, 3, block)
        windows = C.caption_windows(grouped, ["id"], block).orderBy("start").collect()
        assert [(r.group_start, r.n_words, r.start, r.end) for r in windows] == [(0, 3, 0.0, 1.4), (3, 1, 1.5, 1.9), (4, 1, 3.1, 3.3)]


def test_caption_text(spark):
    frame = spark.createDataFrame([("don't,",), ("(what?)",)], "word string")
    from pyspark.sql import functions as F

    assert [r[0] for r in frame.select(C.caption_word("word", F.lit(True), F.lit(True))).collect()] == ["DON'T", "WHAT"]


def test_render_sizes(spark):
    rows = [(1920, 1080, None, "720p", None, None), (1080, 1920, None, "1080p", None, None), (1920, 1080, None, "4k", None, None), (3840, 2160, "9:16", None, None, None), (1, 1, None, None, 64, 36)]
    frame = spark.createDataFrame(rows, "width int, height int, aspect_ratio string, resolution string, custom_width bigint, custom_height bigint")
    assert [(r.render_width, r.render_height) for r in M.render_sizes(frame).collect()] == [(1280, 720), (1080, 1920), (3840, 2160), (1214, 2160), (64, 36)]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_short_specs_are_sent_once(spark):
    """Specs that fit a block: every window runs on the rows as they lie, and gives what blocks give."""
    rows = [(k, i, "a", 0.0, 1.0 + i, None, "crossfade" if i % 2 else None, 0.5, None, None) for k in range(5) for i in range(7)] + [(None, 0, "a", 0.0, 1.0, None, None, None, None, None)]
    segments = spark.createDataFrame(rows, SEGMENT)
    placed = L.segment_timeline(segments)
    assert exchanges(placed) == 1
    columns = ["spec_id", "seg_index", "comp_start"]
    assert sorted(map(str, placed.select(*columns).collect())) == sorted(map(str, L.segment_timeline(segments, 2).select(*columns).collect()))
    layout, blocked = (L.builder_timeline(segments, n).drop("source_start") for n in (1 << 18, 2))
    assert layout.count() == 35 and layout.exceptAll(blocked).isEmpty() and blocked.exceptAll(layout).isEmpty()


def test_bracket_scans_short_keys_once_each_way(spark):
    from timeline_lake.operators import joins as J

    marks = spark.createDataFrame([(k, t, i, f"{k}{i}") for k in ("a", None) for i, t in enumerate([1.0, 1.0, 3.0, None])], "k string, t double, id int, v string")
    points = spark.createDataFrame([(k, t) for k in ("a", None, "z") for t in (0.0, 1.0, 2.0, 3.0, 9.0, None)], "k string, t double")
    found = J.bracket(points, marks, ["k"], "t", ["v"], F.floor(F.col("t") / 2), tie="id")
    assert exchanges(found) == 1
    slow = J.bracket(points, marks, ["k"], "t", ["v"], F.floor(F.col("t") / 2), tie="id", rows=0)
    assert sorted(map(str, found.collect())) == sorted(map(str, slow.collect()))


def test_plan_of_segments_with_keyframes_without_a_time(spark):
    layout = L.builder_timeline(spark.createDataFrame([(1, i, "a", 0.0, 4.0, None, None, None, None, None) for i in range(3)], SEGMENT))
    keyed = spark.createDataFrame([(1, 1, t) for t in (0.0, 2.0, 4.0)] + [(1, 2, t) for t in (None, None, 1.0)], "spec_id bigint, seg_index bigint, time double")
    got = sorted((r.seg_index, r.kind, r.piece, r.start, r.end) for r in L.timeline_plan(layout, keyed).collect())
    assert got == [(0, "plain", 0, 0.0, 4.0), (1, "keyframed", 0, 4.0, 6.0), (1, "keyframed", 1, 6.0, 8.0), (2, "keyframed", 1, 8.0, 9.0), (2, "plain", 0, 8.0, 12.0)]


def test_single_remap_never_gathers_the_hits_of_short_specs(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, i, "a", float(s := rng.randint(0, 20)), s + rng.choice([0.0, 1.0, 7.0]), rng.choice([None, 2.0]), None, None, None, None) for k in range(6) for i in range(1 + k)]
    segments = spark.createDataFrame(rows, SEGMENT)
    words = spark.createDataFrame([("p", "a", i, f"w{i}", i * 0.5, i * 0.5 + rng.choice([0.0, 0.25, 0.75]), None) for i in range(60)], WORD)
    transcript = segments.filter("seg_index = 0").select("spec_id", F.lit("a").alias("transcript"))

    def both():
        mapped, stats = L.remap_single(words, segments, transcript), L.remap_stats(words, segments, transcript)
        return [sorted(map(str, df.select(sorted(df.columns)).collect())) for df in (mapped, stats)], mapped, stats

    short, *plans = both()
    assert not any("min_by" in df._jdf.queryExecution().executedPlan().toString() for df in plans)
    for listed in (3, 0):
        monkeypatch.setattr(L, "LISTED_SPANS", listed)
        assert both()[0] == short
    doubled = words.unionByName(words.withColumn("project_slug", F.lit("q")))
    assert sorted(map(str, (m := L.remap_single(doubled, segments, transcript)).select(sorted(m.columns)).collect())) == short[0]


def test_captions_make_their_words_once(spark):
    words = said(spark, "a", ("x", 0.0, 0.5), ("y", 1.0, 1.5)).unionByName(said(spark, "b", ("z", 0.0, 0.5)))
    segments = segs(spark, {"source": "a", "start": 0, "end": 2})
    overlays = spark.createDataFrame([(1, 0, "b", 0.0, 2.0, None), (1, 1, "a", 0.0, 2.0, None)], OVERLAY)
    met = words.withColumn("confidence", F.col("confidence") + F.lit(0.8125))
    captions = L.caption_words(met, overlays, segments)
    assert captions._jdf.queryExecution().analyzed().toString().count("+ 0.8125") == 1
    columns = ["part", "element", "word_index", "word", "new_start", "new_end"]
    multi = L.remap_multi(met, segments).withColumn("part", F.lit(0)).withColumnRenamed("seg_index", "element")
    over = L.remap_overlays(met, overlays, segments).withColumn("part", F.lit(1)).withColumnRenamed("ov_index", "element")
    got = sorted(map(str, captions.select(*columns).collect()))
    assert len(got) == 3 and got == sorted(map(str, multi.select(*columns).unionByName(over.select(*columns)).collect()))


def made(spark, seed, n=40):
    """Words of two recordings, segments and overlays that cut them anyhow; some lie in two bins of words."""
    rng = random.Random(seed)
    words = said(spark, "a", *[(f"a{i}", i * 3.0, i * 3.0 + rng.choice([0.0, 1.0, 2.5])) for i in range(n)]).unionByName(
        said(spark, "b", *[(f"b{i}", i * 2.0, i * 2.0 + 1.5) for i in range(n)])
    )
    rows = []
    for k in range(9):
        for i in range(1 + k % 5):
            start = rng.uniform(0, 100)
            rows.append((k, i, rng.choice("ab") if i else "a", start, start + rng.choice([0.0, 4.0, 30.0, 90.0]), rng.choice([None, 2.0]), None, None, rng.choice([None, 0.0]), None))
    overlays = [(k, i, rng.choice("ab"), rng.uniform(0, 9), 40.0, rng.choice([None, 50.0])) for k in range(9) for i in range(k % 3)]
    return words, spark.createDataFrame(rows, SEGMENT), spark.createDataFrame(overlays, OVERLAY)


def plain_hits(words, spans):
    """spans: key, source, start, end, comp_start, rate. Every word a span holds, by comparing all with all."""
    out = []
    for key, source, start, end, comp, rate in spans:
        for w in words:
            if w.source_slug == source and start <= w.start_time < end:
                a, b = comp + (w.start_time - start) / rate, comp + (min(w.end_time, end) - start) / rate
                if b > a:
                    out.append((*key, w.word_index, w.word, round(a, 6), round(b, 6)))
    return sorted(out)


def unwritten(df):
    raise AssertionError("a step was written")


def test_multi_remap_writes_no_spans(spark, monkeypatch):
    """Spans of segments meet the words without being written first; long ones are met as well."""
    words, segments, _ = made(spark, 1)
    segments = segments.unionByName(spark.createDataFrame([(50, 0, "b", 0.0, 70000.0, None, None, None, None, None)], SEGMENT))
    spans = [((s.spec_id, s.seg_index), s.source_id, s.start, s.end, s.comp_start, s.speed or 1.0) for s in L.speaker_timeline(segments).collect()]
    monkeypatch.setattr("timeline_lake.operators.joins.cut_lineage", unwritten)
    found = L.remap_multi(words, segments)
    got = sorted((r.spec_id, r.seg_index, r.word_index, r.word, round(r.new_start, 6), round(r.new_end, 6)) for r in found.collect())
    assert got == plain_hits(words.collect(), spans) and len(got) > 100


def test_caption_words_write_no_spans(spark, monkeypatch):
    words, segments, overlays = made(spark, 2)
    monkeypatch.setattr("timeline_lake.operators.joins.cut_lineage", unwritten)
    captions = L.caption_words(words, overlays, segments)
    got = sorted((r.part, r.spec_id, r.element, r.word_index, r.word) for r in captions.collect())
    monkeypatch.undo()
    multi, over = L.remap_multi(words, segments).collect(), L.remap_overlays(words, overlays, segments).collect()
    assert got == sorted([(0, r.spec_id, r.seg_index, r.word_index, r.word) for r in multi] + [(1, r.spec_id, r.ov_index, r.word_index, r.word) for r in over])
    assert {0, 1} == {r[0] for r in got}


def test_caption_text_from_lists(spark):
    """Lists give the texts that rows give: also of elements that touch two bins of words, and of elements that come twice."""
    words, segments, overlays = made(spark, 3)
    overlays = overlays.unionByName(overlays.limit(2)).unionByName(spark.createDataFrame([(2, 1, "b", 0.0, 3.0, 70.0)], OVERLAY))
    rows = L.caption_text(L.caption_words(words, overlays, segments))
    lists = L.caption_words(words, overlays, segments, listed=True)
    assert {r.whole for r in lists.select("whole").distinct().collect()} == {True, False}
    texts = L.caption_text(lists)
    got = sorted(map(str, texts.collect()))
    assert got == sorted(map(str, rows.collect())) and len(got) > 10


def test_single_remap_sends_free_parts(spark, monkeypatch):
    """What earlier segments hold is cut from a later one before it meets the words."""
    words, segments, _ = made(spark, 4)
    segments = segments.unionByName(spark.createDataFrame([(50, 0, "a", 10.0, 5000.0, None, None, None, None, None), (50, 1, "a", 0.0, 9000.0, 2.0, None, None, None, None)], SEGMENT))
    transcript = segments.filter("seg_index = 0").select("spec_id", F.lit("a").alias("transcript"))
    want = {}
    for s in sorted(L.segment_timeline(segments).collect(), key=lambda s: (s.spec_id, s.seg_index)):
        for w in words.filter("source_slug = 'a'").collect():
            if s.start <= w.start_time < s.end and (s.spec_id, w.word_index) not in want:
                rate = s.speed or 1.0
                want[s.spec_id, w.word_index] = (s.seg_index, round(s.comp_start + (w.start_time - s.start) / rate, 6), round(s.comp_start + (min(w.end_time, s.end) - s.start) / rate, 6))
    want = sorted((*k, *v) for k, v in want.items() if v[2] > v[1])
    monkeypatch.setattr("timeline_lake.operators.joins.cut_lineage", unwritten)
    found = L.remap_single(words, segments, transcript)
    got = sorted((r.spec_id, r.word_index, r.seg_index, round(r.new_start, 6), round(r.new_end, 6)) for r in found.collect())
    assert got == want and len(got) > 50
