"""Edit timelines: where segments land, where their words land, and how both are planned and audited.

`segments`: spec_id, seg_index (0, 1, 2, … within a spec), source_id, start, end, speed, transition_type,
transition_duration, volume, audio_from_prev. `words` as in `plans.transcripts`, with ``source_slug`` = source_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from timeline_lake.operators.blocks import (
    BLOCK,
    BLOCK_ROWS,
    block_of,
    block_window,
    core_rows,
    fits,
    halo,
    last_known,
    next_known,
    running,
    running_sums,
)
from timeline_lake.operators.joins import batches_in_intervals, points_in_intervals, usable
from timeline_lake.session import cut_lineage

SPEC = ["spec_id"]
STRETCH_ROWS = 512
LISTED_SPANS = 64
#: Bins of words. Segments last seconds, so that few lie in two bins and are sent twice.
WORD_BIN_SECONDS = 64.0
TICKS_PER_SECOND = 600  # fixed value: the time base edits are snapped to


def _length() -> Column:
    return (F.col("end") - F.col("start")) / F.coalesce("speed", F.lit(1.0))


def _crossfade() -> Column:
    """Requested crossfade in seconds; null without one."""
    return F.when(F.col("transition_type") == "crossfade", F.col("transition_duration"))


def _blocks(segments: DataFrame, rows: int) -> Column | None:
    """How specs are cut into blocks: not at all if none is longer than one. Segments that derive from these need no other cut."""
    return None if fits(segments, SPEC, rows) else block_of("seg_index", rows)


def segment_timeline(segments: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``length`` and ``comp_start``: each crossfade pulls its segment back over the one before."""
    return _placed(segments, _blocks(segments, rows))


def _placed(segments: DataFrame, block: Column | None) -> DataFrame:
    sized = segments.withColumn("length", _length())
    pull = F.when((F.col("seg_index") > 0) & _crossfade().isNotNull(), F.least(_crossfade(), "length")).otherwise(F.lit(0.0))
    pulled = sized.withColumn("pullback", pull)
    placed = running_sums(pulled, SPEC, "seg_index", {"_before": F.col("length") - F.col("pullback")}, block)
    return placed.withColumn("comp_start", F.col("_before") - F.col("pullback")).drop("_before")


def with_cross_cuts(segments: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``cross_cut``: the segment is only shown over the running speaker and takes no time of its own."""
    near = halo(segments, "seg_index", before=1, rows=rows)
    return core_rows(_cut(near, block_window(SPEC, "seg_index"))).drop(BLOCK)


def _cut(segments: DataFrame, along: WindowSpec) -> DataFrame:
    silent = (F.coalesce("volume", F.lit(1.0)) == 0) & (F.lag("source_id").over(along) != F.col("source_id"))
    return segments.withColumn("cross_cut", (F.col("seg_index") > 0) & F.coalesce("audio_from_prev", silent))


def _mapped(joined: DataFrame, comp_start: Column, origin: Column, limit: Column, speed: Column) -> DataFrame:
    new_start = comp_start + (F.col("start_time") - origin) / speed
    new_end = comp_start + (F.least("end_time", limit) - origin) / speed
    return joined.withColumn("new_start", new_start).withColumn("new_end", new_end)


def remap_single(words: DataFrame, segments: DataFrame, transcript_of: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Words of a spec's one transcript on the composition axis, whatever source its segments name.

    The first segment holding a word's start decides; if the word vanishes there it is not tried in later ones.
    ``transcript_of``: spec_id, transcript.
    """
    spoken = _transcript_words(words)
    short, long = _single_spans(spoken, segments, transcript_of, rows)
    found = [_first_hits(spoken, df, segments) for df in (short,) if df is not None] + [_chosen_hits(spoken, df) for df in (long,) if df is not None]
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _transcript_words(words: DataFrame) -> DataFrame:
    return words.select(F.col("source_slug").alias("transcript"), "word_index", "word", "start_time", "end_time", "confidence")


def _single_spans(spoken: DataFrame, segments: DataFrame, transcript_of: DataFrame, rows: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Spans of specs with LISTED_SPANS segments or fewer, each with the ``_earlier`` ones that overlap it, and those of the others.

    A word that lies in none of the earlier spans of its spec is decided where it is found, so its hits need not meet. Words that
    share an index count as one, and can only be told apart when all their hits meet: then all spans are of the second kind.
    """
    placed = segment_timeline(segments, rows).select(
        *SPEC, "seg_index", "start", "end", "comp_start", F.coalesce("speed", F.lit(1.0)).alias("rate")
    )
    spans = placed.join(transcript_of, SPEC)
    repeated = spoken.filter("transcript is not null").groupBy("transcript", "word_index").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    if not repeated.isEmpty():
        return None, spans
    sizes = segments.groupBy(*SPEC).agg(F.count(F.lit(1)).alias("_n"))
    over = sizes.filter(F.col("_n") > LISTED_SPANS)
    few = over.isEmpty()
    usual = (spans if few else spans.join(over, SPEC, "left_anti")).filter(usable("start", "end"))
    before = Window.partitionBy(*SPEC).orderBy("seg_index").rowsBetween(Window.unboundedPreceding, -1)
    listed = F.collect_list(F.struct("transcript", "start", "end")).over(before)
    met = F.filter("_all", lambda s: (s["transcript"] == F.col("transcript")) & (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    earlier = F.transform(met, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    short = usual.withColumn("_all", listed).withColumn("_earlier", earlier).drop("_all")
    return short, None if few else spans.join(over, SPEC, "left_semi")


def _is_first(start_time: Column) -> Column:
    return (F.size("_earlier") == 0) | ~F.exists("_earlier", lambda s: (s["start"] <= start_time) & (start_time < s["end"]))


def _free_parts() -> Column:
    """The parts of a span that lie in none of the ``_earlier`` ones."""
    def span(since: Column, until: Column) -> Column:
        return F.struct(since.alias("from"), until.alias("to"))

    def without(part: Column, earlier: Column) -> Column:
        sides = F.array(span(part["from"], F.least(part["to"], earlier["start"])), span(F.greatest(part["from"], earlier["end"]), part["to"]))
        return F.filter(sides, lambda p: p["from"] < p["to"])

    return F.aggregate("_earlier", F.array(span(F.col("start"), F.col("end"))), lambda parts, e: F.flatten(F.transform(parts, lambda p: without(p, e))))


def _first_hits(spoken: DataFrame, spans: DataFrame, segments: DataFrame) -> DataFrame:
    free = spans.select("*", F.inline(_free_parts())).drop("_earlier")
    among = segments.select(F.col("start").alias("from"), F.col("end").alias("to"))
    hits = points_in_intervals(spoken, free, ["transcript"], "start_time", "from", "to", WORD_BIN_SECONDS, among=among)
    mapped = _mapped(hits, F.col("comp_start"), F.col("start"), F.col("end"), F.col("rate"))
    return mapped.filter(F.col("new_end") > F.col("new_start")).select(
        *SPEC, "transcript", "word_index", "seg_index", "word", "new_start", "new_end", "confidence"
    )


def _chosen_hits(spoken: DataFrame, spans: DataFrame) -> DataFrame:
    hits = points_in_intervals(spoken, spans, ["transcript"], "start_time", "start", "end")
    mapped = _mapped(hits, F.col("comp_start"), F.col("start"), F.col("end"), F.col("rate"))
    first = F.min_by(F.struct("seg_index", "word", "new_start", "new_end", "confidence"), "seg_index")
    chosen = mapped.groupBy(*SPEC, "transcript", "word_index").agg(first.alias("_m"))
    return chosen.select(*SPEC, "transcript", "word_index", "_m.*").filter(F.col("new_end") > F.col("new_start"))


def speaker_timeline(segments: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Segments that take time (no cross-cuts) with ``comp_start`` for captions.

    Segment 0 is never a cross-cut, so it is always the first speaker and the only one that is not pulled back.
    """
    block = _blocks(segments, rows)
    if block is not None:
        return _placed(with_cross_cuts(segments, rows).filter(~F.col("cross_cut")), block)
    # Both windows run on rows that are sorted once.
    cut = _cut(segments.filter("seg_index is not null"), Window.partitionBy(*SPEC).orderBy("seg_index"))
    return _placed(cut.filter(~F.col("cross_cut")), None)


def _speaker_spans(segments: DataFrame, rows: int) -> DataFrame:
    return speaker_timeline(segments, rows).select(
        *SPEC, "seg_index", F.col("source_id").alias("source_slug"), "start", "end", "comp_start",
        F.coalesce("speed", F.lit(1.0)).alias("rate"),
    )


def _overlay_spans(overlays: DataFrame, segments: DataFrame) -> DataFrame:
    """Overlay sources that no segment of the spec uses. The overlay's speed is not applied."""
    used = segments.select(*SPEC, "source_id").distinct()
    return _source_spans(overlays.filter(F.col("source_id").isNotNull()).join(used, [*SPEC, "source_id"], "left_anti"))


def _source_spans(overlays: DataFrame) -> DataFrame:
    begin = F.coalesce("source_start", F.lit(0.0))
    return overlays.select(
        *SPEC, "ov_index", F.col("source_id").alias("source_slug"), begin.alias("start"),
        (begin + (F.col("end") - F.col("start"))).alias("end"), F.col("start").alias("comp_start"), F.lit(1.0).alias("rate"),
    )


def _words_in(words: DataFrame, spans: DataFrame, among: DataFrame, *element: str) -> DataFrame:
    """Words of each span's source on the composition axis; every span that holds a word emits it. ``among``: see the join."""
    spoken = words.select("source_slug", "word_index", "word", "start_time", "end_time", "confidence")
    hits = points_in_intervals(spoken, spans, ["source_slug"], "start_time", "start", "end", WORD_BIN_SECONDS, among=among)
    mapped = _mapped(hits, F.col("comp_start"), F.col("start"), F.col("end"), F.col("rate"))
    return mapped.filter(F.col("new_end") > F.col("new_start")).select(
        *SPEC, *element, "source_slug", "word_index", "word", "new_start", "new_end", "confidence"
    )


def remap_multi(words: DataFrame, segments: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Words of each segment's own source on the composition axis; every matching segment emits the word."""
    return _words_in(words, _speaker_spans(segments, rows), segments, "seg_index")


def remap_overlays(words: DataFrame, overlays: DataFrame, segments: DataFrame) -> DataFrame:
    """Words of overlay sources that no segment of the spec uses. The overlay's speed is not applied."""
    return _words_in(words, _overlay_spans(overlays, segments), _source_spans(overlays), "ov_index")


def caption_words(words: DataFrame, overlays: DataFrame, segments: DataFrame, rows: int = BLOCK_ROWS, listed: bool = False) -> DataFrame:
    """All caption words of a spec. Play order is (new_start); text order is (part, element, word_index).

    What :func:`remap_multi` and :func:`remap_overlays` give: the spans of both meet the words at once, so words are made and sent once.
    ``listed``: words as lists of (word_index, word) in text order, ``spoken``; where ``whole``, one has all words of its element.
    """
    spoken = _speaker_spans(segments, rows).withColumn("part", F.lit(0).cast("long")).withColumnRenamed("seg_index", "element")
    over = _overlay_spans(overlays, segments).withColumn("part", F.lit(1).cast("long")).withColumnRenamed("ov_index", "element")
    if listed:
        alone = F.count(F.lit(1)).over(Window.partitionBy(*SPEC, "element")) == 1
        return _word_lists_in(words, spoken.withColumn("alone", alone).unionByName(over.withColumn("alone", alone)), "part", "element")
    among = segments.select("start", "end").unionByName(_source_spans(overlays).select("start", "end"))
    return _words_in(words, spoken.unionByName(over), among, "part", "element")


def _word_lists_in(words: DataFrame, spans: DataFrame, *element: str) -> DataFrame:
    """The words of :func:`_words_in` as lists, ``spoken``, one for each bin of words a span touches; those that are ``whole`` come first."""
    said = words.select("source_slug", "word_index", "word", "start_time", "end_time")
    spans = cut_lineage(spans)
    hits = batches_in_intervals(said, spans, ["source_slug"], "start_time", "start", "end", "word_index", ["word", "end_time"], WORD_BIN_SECONDS, None, stored=True)

    def at(time: Column) -> Column:
        return F.col("comp_start") + (time - F.col("start")) / F.col("rate")

    left = F.filter("_batch", lambda w: at(F.least(w["end_time"], F.col("end"))) > at(w["start_time"]))
    spoken = F.transform(left, lambda w: F.struct(w["word_index"].alias("word_index"), w["word"].alias("word")))
    whole = (F.col("alone") & (F.col("_n_bins") == 1)).alias("whole")
    return hits.select(*SPEC, *element, "source_slug", whole, F.explode(F.array(spoken)).alias("spoken")).filter(F.size("spoken") > 0)


def caption_text(captions: DataFrame) -> DataFrame:
    """The running caption text, one row per segment or overlay that speaks, in order of (part, element).

    Words that come in lists (see :func:`caption_words`) are sent only where an element has several.
    """
    def text(spoken: Column) -> Column:
        return F.array_join(F.transform(spoken, lambda w: w["word"]), " ").alias("text")

    key = [*SPEC, "part", "element"]
    if "spoken" not in captions.columns:
        return captions.groupBy(*key).agg(text(F.array_sort(F.collect_list(F.struct("word_index", "word")))))
    pieces = captions.filter(~F.col("whole")).groupBy(*key).agg(text(F.array_sort(F.flatten(F.collect_list("spoken")))))
    return captions.filter("whole").select(*key, text(F.col("spoken"))).unionByName(pieces)


def to_ticks(seconds: Column) -> Column:
    return F.round(seconds * TICKS_PER_SECOND).cast("long")


def from_ticks(ticks: Column) -> Column:
    return ticks / F.lit(float(TICKS_PER_SECOND))


def on_axis(seconds: Column) -> Column:
    """The nearest instant of the renderer's axis."""
    return from_ticks(to_ticks(seconds))


def builder_timeline(segments: DataFrame, rows: int = BLOCK_ROWS, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """Where the renderer puts every segment, in 1/600 s.

    A crossfade is skipped when an earlier cross-cut covers the whole seam (``bridged``); the segment then follows
    its predecessor on the same track. Whether it is depends on where earlier segments landed, hence on earlier
    skips. That dependence ends at any speaker no cross-cut can reach even if all crossfades happen, since time only
    grows; specs are cut there. A stretch under one cross-cut is walked in parts of ``stretch_rows`` segments, all at once
    (see ``_bridged``).

    Columns: spec_id, seg_index, source_id, cross_cut, comp_start (for a cross-cut, the time it was met), length,
    transition, bridged, speaker_index, track, fade_in.
    """
    block = _blocks(segments, rows)
    # Blocks read their input twice; without them everything up to the layout is one pass over the segments, sent once.
    kept = cut_lineage if block is not None else lambda df: df
    length = to_ticks(F.col("end")) - to_ticks(F.col("start"))  # both ends lie on the axis
    rate = F.coalesce("speed", F.lit(1.0))
    laid = with_cross_cuts(segments, rows)
    laid = laid.select(
        *SPEC, "seg_index", "source_id", "start", "volume", "cross_cut",
        F.when(rate == 1.0, length).otherwise(to_ticks(from_ticks(length) / rate)).alias("_len"),
        _crossfade().alias("_fade"),
    )
    fade = to_ticks(F.least("_fade", from_ticks(F.col("_len"))))
    fades = (F.col("seg_index") > 0) & F.col("_fade").isNotNull()  # least() would pass over a missing fade
    laid = kept(laid.withColumn("_pull", F.when(fades, fade).otherwise(F.lit(0))))
    least_step = F.when(F.col("cross_cut"), F.lit(0)).otherwise(F.col("_len") - F.col("_pull"))
    pressed = running_sums(laid, SPEC, "seg_index", {"_p": least_step}, block)
    reach = F.when(F.col("cross_cut"), F.col("_p") + F.col("_len") - F.col("_pull"))
    reached = kept(running(pressed, SPEC, "seg_index", {"_reach": reach}, block, F.max))
    sure = ~F.col("cross_cut") & (F.col("_reach").isNull() | (F.col("_reach") < F.col("_p")))
    stretched = last_known(reached, SPEC, "seg_index", {"_stretch": F.when(sure, F.col("seg_index"))}, block).drop("_p", "_reach")
    # No stretch is longer than its spec.
    longest = segments.groupBy(*SPEC).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    decided = _bridged(stretched, stretch_rows, longest > stretch_rows).filter(F.col("spec_id").isNotNull() & F.col("seg_index").isNotNull())
    speaker = F.when(F.col("cross_cut"), F.lit(0)).otherwise(F.lit(1))
    joined = kept(decided.withColumn("_transition", F.when(F.col("cross_cut") | F.col("bridged"), F.lit(0)).otherwise(F.col("_pull"))))
    step = F.when(F.col("cross_cut"), F.lit(0)).otherwise(F.col("_len") - F.col("_transition"))
    timed = running_sums(joined, SPEC, "seg_index", {"_t": step, "speaker_index": speaker}, block)
    own_track = F.when(~F.col("cross_cut") & ~F.col("bridged"), F.pmod("speaker_index", F.lit(2)))
    tracked = last_known(timed, SPEC, "seg_index", {"_track": own_track}, block)
    layout = tracked.select(
        *SPEC,
        "seg_index",
        "source_id",
        F.col("start").alias("source_start"),
        "cross_cut",
        from_ticks(F.col("_t") - F.col("_transition")).alias("comp_start"),
        from_ticks(F.col("_len")).alias("length"),
        from_ticks(F.col("_transition")).alias("transition"),
        "bridged",
        F.when(~F.col("cross_cut"), F.col("speaker_index")).alias("speaker_index"),
        F.when(~F.col("cross_cut"), F.col("_track")).alias("track"),
        F.coalesce("volume", F.lit(1.0)).alias("volume"),
        F.coalesce("_fade", F.lit(0.0)).alias("fade_in"),
    )
    return cut_lineage(layout)  # the plans below read it several times


SPAN = "struct<a:bigint,b:bigint>"


def _bridged(stretched: DataFrame, part_rows: int, may_be_long: bool = True) -> DataFrame:
    """Every segment with its columns and ``bridged``. ``may_be_long``: whether a stretch may have several parts.

    Stretches of one part, nearly all, are decided by one walk. The parts of a longer one are walked by themselves, again
    and again, each with the cross-cuts and lengths that the parts before it had in the last round, until no part is given
    anything new. A part is final once those before it are, so there are at most as many rounds as a stretch has parts; but
    a part's own answers depend on earlier ones only by how far off a cut's end is, so three or four rounds are usual.
    """
    key = [*SPEC, "_stretch"]
    part = F.floor((F.col("seg_index") - F.col("_stretch")) / F.lit(part_rows)).cast("long")
    columns = ["seg_index", *[c for c in stretched.columns if c not in (*key, "seg_index")]]
    listed = F.array_sort(F.collect_list(F.struct(*columns)))

    def noted(walked: DataFrame) -> DataFrame:
        each = walked.select(*SPEC, F.explode(F.arrays_zip("_list", F.col("_walk.out").alias("_out"))).alias("_z"))
        return each.select(*SPEC, "_z._list.*", "_z._out.bridged")

    parts = stretched.groupBy(*key, part.alias("_part")).agg(listed.alias("_list"), F.max("_pull").alias("_reach"))
    nothing = F.struct(F.lit(None).cast("long").alias("best"), F.array().cast(f"array<{SPAN}>").alias("near"))
    first = parts.withColumn("_given", nothing).withColumn("_walk", _walk_part(F.col("_list"), F.col("_given"), F.col("_reach")))
    if not may_be_long:
        return noted(first)
    first = cut_lineage(first)
    long = first.filter("_part > 0").select(*key).distinct()
    if long.isEmpty():
        return noted(first)
    short = noted(first.join(long, key, "left_anti"))
    # A fade of any part may look back beyond the part before it, so all parts of a stretch reach equally far.
    widest = first.groupBy(*key).agg(F.max("_reach").alias("_reach"))
    rounds = cut_lineage(first.join(long, key, "left_semi").drop("_reach").join(widest, key).withColumn("_walk", _walk_part(F.col("_list"), F.col("_given"), F.col("_reach"))))
    while True:
        summary = F.struct("_part", F.col("_walk.t").alias("t"), F.col("_walk.best").alias("best"), F.col("_walk.near").alias("near"))
        each = rounds.groupBy(*key).agg(F.array_sort(F.collect_list(summary)).alias("_parts"), F.first("_reach").alias("_reach"))
        handed = each.select(*key, F.inline(_hand_on(F.col("_parts"), F.col("_reach"))))
        met = rounds.withColumnRenamed("_given", "_had").join(handed, [*key, "_part"])
        walk = F.when(F.col("_given").eqNullSafe(F.col("_had")), F.col("_walk")).otherwise(_walk_part(F.col("_list"), F.col("_given"), F.col("_reach")))
        rounds = cut_lineage(met.withColumn("_walk", walk).withColumn("_new", ~F.col("_given").eqNullSafe(F.col("_had"))).drop("_had"))
        if rounds.filter("_new").isEmpty():
            return short.unionByName(noted(rounds))
        rounds = rounds.drop("_new")


def _covers(spans: Column, since: Column, until: Column) -> Column:
    """Whether one of the spans shown holds [since, until]; ``spans``: best, near (see ``_walk_part``)."""
    return F.coalesce(spans["best"] >= until, F.lit(False)) | F.exists(spans["near"], lambda s: (s["a"] <= since) & (s["b"] >= until))


def _kept(best: Column, near: Column, now: Column, reach: Column) -> list[Column]:
    """best, near at the time ``now``: of spans that began before every fade to come only the latest end counts."""
    far = F.array_max(F.transform(F.filter(near, lambda s: s["a"] <= now - reach), lambda s: s["b"]))
    return [F.greatest(best, far).alias("best"), F.filter(near, lambda s: (s["a"] > now - reach) & (s["b"] >= now)).alias("near")]


def _walk_part(segments: Column, given: Column, reach: Column) -> Column:
    """Walk some segments in order, with the spans ``given`` by those before them; times count from the first one.

    Returns t (time taken), best and near (the part's own spans: the latest end of those that began ``reach`` or longer
    before ``t``, and the others), out (seg_index, bridged).
    """
    out = F.array().cast("array<struct<seg_index:bigint,bridged:boolean>>")
    zero = F.lit(0).cast("bigint")
    begin = F.struct(zero.alias("t"), F.lit(None).cast("bigint").alias("best"), F.array().cast(f"array<{SPAN}>").alias("near"), out.alias("out"))

    def step(state: Column, seg: Column) -> Column:
        now = state["t"]
        covered = _covers(state, now - seg["_pull"], now) | _covers(given, now - seg["_pull"], now)
        bridged = ~seg["cross_cut"] & (seg["_pull"] > 0) & covered
        progress = F.when(seg["cross_cut"], zero).otherwise(seg["_len"] - F.when(bridged, zero).otherwise(seg["_pull"]))
        span = F.struct((now - seg["_pull"]).alias("a"), (now - seg["_pull"] + seg["_len"]).alias("b"))
        shown = F.when(seg["cross_cut"], F.concat(state["near"], F.array(span))).otherwise(state["near"])
        note = F.struct(seg["seg_index"].cast("bigint").alias("seg_index"), bridged.alias("bridged"))
        return F.struct((now + progress).alias("t"), *_kept(state["best"], shown, now + progress, reach), F.concat(state["out"], F.array(note)).alias("out"))

    return F.aggregate(segments, begin, step)


def _hand_on(parts: Column, reach: Column) -> Column:
    """Array of (_part, _given): the spans of all earlier parts, on the clock of each part."""

    def later(best: Column, near: Column, by: Column) -> list[Column]:
        return [best - by, F.transform(near, lambda s: F.struct((s["a"] - by).alias("a"), (s["b"] - by).alias("b")))]

    none = F.array().cast(f"array<struct<_part:bigint,_given:struct<best:bigint,near:array<{SPAN}>>>>")
    begin = F.struct(F.lit(None).cast("bigint").alias("best"), F.array().cast(f"array<{SPAN}>").alias("near"), none.alias("out"))

    def step(state: Column, part: Column) -> Column:
        note = F.struct(part["_part"].alias("_part"), F.struct(state["best"].alias("best"), state["near"].alias("near")).alias("_given"))
        best, near = _kept(F.greatest(state["best"], part["best"]), F.concat(state["near"], part["near"]), part["t"], reach)
        moved = later(best, near, part["t"])
        return F.struct(moved[0].alias("best"), moved[1].alias("near"), F.concat(state["out"], F.array(note)).alias("out"))

    return F.aggregate(parts, begin, step)["out"]


def _speakers(layout: DataFrame) -> DataFrame:
    return layout.filter(~F.col("cross_cut"))


def bridge_audit(layout: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Check every bridged segment: same track as its predecessor, back to back, no transition."""
    near = halo(_speakers(layout), "speaker_index", before=1, rows=rows)
    order = block_window(SPEC, "speaker_index")
    near = near.withColumn("_end", F.lag(F.col("comp_start") + F.col("length")).over(order)).withColumn("_track", F.lag("track").over(order))
    return core_rows(near).filter("bridged").select(
        *SPEC,
        "seg_index",
        (F.col("track") == F.col("_track")).alias("same_track"),
        (F.col("comp_start") == F.col("_end")).alias("back_to_back"),
        (F.col("transition") == 0).alias("zero_transition"),
    )


def caption_drift(layout: DataFrame, segments: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Renderer start minus caption start: captions still pull back where the renderer skipped the crossfade."""
    captions = speaker_timeline(segments, rows).select(*SPEC, "seg_index", F.col("comp_start").alias("caption_start"))
    return _speakers(layout).join(captions, [*SPEC, "seg_index"]).select(
        *SPEC, "seg_index", (F.col("comp_start") - F.col("caption_start")).alias("drift")
    )


def cross_cut_overlays(layout: DataFrame, source_lengths: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Cross-cuts as full-frame overlays: shown from their fade-in before the seam, faded out by the next speaker's fade.

    ``source_lengths``: source_id, source_length. An overlay ends with its source; one with nothing left is dropped. A cut
    of a source that is not listed comes back without a span and with a ``problem``.
    """
    returning = F.when(~F.col("cross_cut"), F.col("fade_in"))
    followed = next_known(layout, SPEC, "seg_index", {"_next": returning}, _blocks(layout, rows))
    cuts = followed.filter("cross_cut").join(source_lengths, "source_id", "left")
    known = F.col("source_length").isNotNull()
    left = F.col("source_length") - on_axis(F.col("source_start"))
    shown = F.col("comp_start") - on_axis(F.least("fade_in", "length"))
    return (
        cuts.withColumn("shown_for", F.when(known, F.least("length", left)))
        .filter((F.col("shown_for") > 0) | ~known)
        .select(
            *SPEC, "seg_index", "source_id", F.when(known, shown).alias("overlay_start"), (shown + F.col("shown_for")).alias("overlay_end"),
            "fade_in", F.coalesce("_next", F.lit(0.0)).alias("fade_out"), F.when(~known, F.lit("unknown source")).alias("problem"),
        )
    )


def timeline_plan(layout: DataFrame, segment_keyframes: DataFrame | None = None, rows: int = BLOCK_ROWS) -> DataFrame:
    """Ordered instruction spans: a crossfade overlap, then the plain part up to the next overlap.

    ``segment_keyframes`` (spec_id, seg_index, time from the segment's start): the plain part of a segment that has two
    or more is cut into one span per pair of neighbouring keyframes.
    """
    near = halo(_speakers(layout), "speaker_index", after=1, rows=rows)
    outgoing = F.coalesce(F.lead("transition").over(block_window(SPEC, "speaker_index")), F.lit(0.0))
    placed = core_rows(near.withColumn("_out", outgoing)).drop(BLOCK)
    start, end = F.col("comp_start"), F.col("comp_start") + F.col("length")
    shown = ["seg_index", "kind", "piece", "start", "end"]
    fades = placed.filter(F.col("transition") > 0).select(
        *SPEC, "seg_index", F.lit("crossfade").alias("kind"), F.lit(0).cast("long").alias("piece"),
        start.alias("start"), (start + F.col("transition")).alias("end"),
    )
    plain = placed.select(
        *SPEC, "seg_index", "comp_start", F.lit("plain").alias("kind"), F.lit(0).cast("long").alias("piece"),
        (start + F.col("transition")).alias("start"), (end - F.col("_out")).alias("end"),
    ).filter(F.col("end") > F.col("start"))
    if segment_keyframes is None:
        return fades.unionByName(plain.select(*SPEC, *shown))
    # Keyframes belong to one segment of one document; they pass by in order, none are gathered.
    along = Window.partitionBy(*SPEC, "seg_index").orderBy("time")
    pairs = segment_keyframes.select(
        *SPEC, "seg_index", F.col("time").alias("_a"), F.lead("time").over(along).alias("_b"), (F.row_number().over(along) - 1).alias("_i")
    ).filter("_b is not null")
    pairs = pairs.withColumn("_least", F.min("_i").over(Window.partitionBy(*SPEC, "seg_index")))
    # One join: a segment without a pair, or without the pair of its first keyframe, is shown whole.
    kinds = F.when(F.col("_i").isNull(), F.array(F.lit("plain"))).when(
        (F.col("_i") == F.col("_least")) & (F.col("_i") > 0), F.array(F.lit("plain"), F.lit("keyframed"))
    ).otherwise(F.array(F.lit("keyframed")))
    joined = plain.drop("kind", "piece").join(pairs, [*SPEC, "seg_index"], "left").withColumn("kind", F.explode(kinds))
    keyed = F.col("kind") == "keyframed"
    cut = joined.select(
        *SPEC, "seg_index", "kind", F.when(keyed, F.col("_i")).otherwise(F.lit(0)).cast("long").alias("piece"),
        F.when(keyed, F.greatest("start", F.col("comp_start") + F.col("_a"))).otherwise(F.col("start")).alias("start"),
        F.when(keyed, F.least("end", F.col("comp_start") + F.col("_b"))).otherwise(F.col("end")).alias("end"),
    ).filter(F.col("end") > F.col("start"))
    return fades.unionByName(cut)


def audio_schedule(layout: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Volume ramps over transitions and volume settings after them. No row resets a volume to 1."""
    near = halo(_speakers(layout), "speaker_index", before=1, rows=rows)
    order = block_window(SPEC, "speaker_index")
    near = core_rows(near.withColumn("_volume", F.lag("volume").over(order)).withColumn("_track", F.lag("track").over(order)))
    start, until = F.col("comp_start"), F.col("comp_start") + F.col("transition")
    incoming = near.filter((F.col("transition") > 0) & (F.col("speaker_index") > 0))
    out = incoming.select(
        *SPEC, "seg_index", F.lit("ramp_out").alias("action"), F.col("_track").alias("track"), start.alias("start"),
        until.alias("end"), F.col("_volume").alias("from_volume"), F.lit(0.0).alias("to_volume"),
    )
    into = incoming.select(
        *SPEC, "seg_index", F.lit("ramp_in").alias("action"), "track", start.alias("start"), until.alias("end"),
        F.lit(0.0).alias("from_volume"), F.col("volume").alias("to_volume"),
    )
    fixed = near.filter(F.col("volume") != 1.0).select(
        *SPEC, "seg_index", F.lit("set").alias("action"), "track", until.alias("start"), F.lit(None).cast("double").alias("end"),
        F.lit(None).cast("double").alias("from_volume"), F.col("volume").alias("to_volume"),
    )
    return out.unionByName(into).unionByName(fixed)


def composition_lengths(layout: DataFrame) -> DataFrame:
    step = F.when(F.col("cross_cut"), F.lit(0.0)).otherwise(F.col("length") - F.col("transition"))
    return layout.groupBy(*SPEC).agg(F.sum(step).alias("duration"))


def music_range(lengths: DataFrame, music: DataFrame) -> DataFrame:
    """Background music per spec: as long as the shorter of music and composition, at 0.3 unless set.

    ``music``: spec_id, music_length, music_volume.
    """
    return lengths.join(music, SPEC).select(
        *SPEC, F.least("music_length", "duration").alias("music_end"), F.coalesce("music_volume", F.lit(0.3)).alias("volume")
    )


def remap_stats(words: DataFrame, segments: DataFrame, transcript_of: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Per spec: words before and after remapping, composition length, first three words; an error if none is left."""
    sized = segment_timeline(segments, rows)
    lengths = sized.groupBy(*SPEC).agg(F.sum(F.col("length") - F.col("pullback")).alias("duration"))
    total = words.groupBy(F.col("source_slug").alias("transcript")).agg(F.count(F.lit(1)).alias("before"))
    spoken = _transcript_words(words)
    short, long = _single_spans(spoken, segments, transcript_of, rows)
    found = [_counted_batches(spoken, df) for df in (short,) if df is not None] + [_counted_rows(_chosen_hits(spoken, df)) for df in (long,) if df is not None]
    after = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    joined = lengths.join(transcript_of, SPEC).join(total, "transcript", "left").join(after, SPEC, "left")
    before, left = F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0))
    return joined.select(
        *SPEC,
        "duration",
        before.alias("words_before"),
        left.alias("words_after"),
        (before - left).alias("words_dropped"),
        F.array_join(F.transform("_first", lambda w: w["word"]), " ").alias("first_words"),
        (F.round(F.get("_first", F.lit(0))["new_start"] * 1000) / F.lit(1000.0)).alias("first_start"),
        ((before > 0) & (left == 0)).alias("failed"),
    )


def _counted_rows(mapped: DataFrame) -> DataFrame:
    """Per spec: ``after`` (words) and ``_first``, the three of least index."""
    counted = mapped.groupBy(*SPEC).agg(F.count(F.lit(1)).alias("after"))
    # Rank filters are applied before the shuffle too, so at most three rows per task and spec travel.
    rank = F.row_number().over(Window.partitionBy(*SPEC).orderBy("word_index"))
    leading = mapped.withColumn("_rank", rank).filter(F.col("_rank") <= 3).groupBy(*SPEC).agg(
        F.array_sort(F.collect_list(F.struct("word_index", "word", "new_start"))).alias("_first")
    )
    return counted.join(leading, SPEC)


def _counted_batches(spoken: DataFrame, spans: DataFrame) -> DataFrame:
    """The same of spans with their ``_earlier`` ones: words stay in lists, of which a count and three words travel.

    A spec here has LISTED_SPANS segments at most, so its lists are few.
    """
    hits = batches_in_intervals(spoken, spans, ["transcript"], "start_time", "start", "end", "word_index", ["word", "end_time"])

    def at(time: Column) -> Column:
        return F.col("comp_start") + (time - F.col("start")) / F.col("rate")

    def left(w: Column) -> Column:
        return _is_first(w["start_time"]) & (at(F.least(w["end_time"], F.col("end"))) > at(w["start_time"]))

    kept = hits.select("*", F.filter("_batch", left).alias("_left")).filter(F.size("_left") > 0)
    some = F.transform(F.slice("_left", 1, 3), lambda w: F.struct(w["word_index"].alias("word_index"), w["word"].alias("word"), at(w["start_time"]).alias("new_start")))
    each = kept.select(*SPEC, F.size("_left").alias("_n"), some.alias("_some"))
    return each.groupBy(*SPEC).agg(
        F.sum("_n").alias("after"), F.slice(F.array_sort(F.flatten(F.collect_list("_some"))), 1, 3).alias("_first")
    )
