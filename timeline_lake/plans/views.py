"""The data model read from the driver's tables (`TESTDATA.md`).

Each function maps a given table onto one table of the model (words, segments, overlays, …). All times come from
integers or dyadic fractions, so running sums give the same double in any order of evaluation.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeline_lake.operators.blocks import KEY_HASHES, SLOT, fits, row_numbers, running_sums

WORD_KEYS = ["project_slug", "source_slug"]
TURNS_PER_BLOCK = 1 << 14
WORDS_PER_PART = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, read as it lies."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda t: t != "")


def _duration_ms(word: Column) -> Column:
    return F.lit(120) + F.lit(30) * F.length(word)


def _ends_sentence(word: Column) -> Column:
    """Whether the pattern ``[.!?]$`` is found: a mark is last, or followed only by one of the line ends words may hold."""
    return reduce(or_, [word.endswith(mark + end) for end in ("", "\u0085", "\u2028", "\u2029") for mark in ".!?"])


def _gap_ms(word: Column, position: Column, last: Column) -> Column:
    return (
        F.when(last, F.lit(2100))
        .when(_ends_sentence(word), F.lit(400) + F.lit(100) * F.pmod(position, F.lit(4)))
        .when(word.endswith(","), F.lit(250))
        .otherwise(F.lit(40))
    ).cast("long")


def _by_recording(turns: DataFrame, turns_per_block: int) -> DataFrame | None:
    """The turns dealt by their keys, each part of about WORDS_PER_PART words; None if a recording may have more turns than a block.

    The number of parts is fixed, since turns become many times as large when they are cut into words, and grows with the words, so
    that the words of a part are sorted in memory. Counts per hash of the key are never less than those of a key in it.
    """
    counted = turns.groupBy(F.pmod(F.xxhash64(*WORD_KEYS), F.lit(KEY_HASHES)).alias("_h")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.size("tokens")).alias("_w"))
    longest, total = counted.agg(F.max("_n"), F.sum("_w")).first()
    if (longest or 0) > turns_per_block:
        return None
    usual = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-(total or 0) // WORDS_PER_PART), min(usual, -(-(total or 0) * 16 // WORDS_PER_PART)))
    return turns.repartition(parts, *WORD_KEYS)


def _words_of_turns(turns: DataFrame, turns_per_block: int = TURNS_PER_BLOCK) -> DataFrame:
    """`turns`: project_slug, source_slug, turn, tokens. Times follow from word lengths and punctuation.

    Where no recording has more turns than a block, turns are sent once, by their keys, and their words lie there as well.
    """
    dealt = _by_recording(turns, turns_per_block)
    sized = (turns if dealt is None else dealt).withColumn("_n", F.size("tokens").cast("long"))
    block = None if dealt is not None else F.floor(F.col("turn") / F.lit(turns_per_block)).cast("long")
    cost = F.transform("tokens", lambda w, i: _duration_ms(w) + _gap_ms(w, i, i == F.col("_n") - 1))
    costed = sized.withColumn("_ms", F.aggregate(cost, F.lit(0).cast("long"), lambda a, x: a + x))
    timed = running_sums(costed, WORD_KEYS, "turn", {"_first": F.col("_n"), "_offset": F.col("_ms")}, block, keep_slot=True)
    words = timed.select(SLOT, *WORD_KEYS, "turn", "_first", "_n", "_offset", F.posexplode("tokens").alias("_pos", "word"))
    words = words.withColumn("word_index", F.col("_first") + F.col("_pos"))
    words = words.withColumn("_dur", _duration_ms(F.col("word")))
    words = words.withColumn(
        "_step", F.col("_dur") + _gap_ms(F.col("word"), F.col("_pos"), F.col("_pos") == F.col("_n") - 1)
    )
    # A turn is the text of one input row, so this window is bounded by a row; its words already lie together.
    inside = Window.partitionBy(*(WORD_KEYS if block is None else [SLOT]), "turn").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_offset") + F.coalesce(F.sum("_step").over(inside), F.lit(0))
    confidence = F.pmod(F.col("word_index") * 37 + F.length("word") * 11, F.lit(100)) / F.lit(100.0)
    return words.withColumn("_at", at).select(
        *WORD_KEYS,
        F.col("word_index").cast("long").alias("word_index"),
        "word",
        (F.col("_at") / F.lit(1000.0)).alias("start_time"),
        ((F.col("_at") + F.col("_dur")) / F.lit(1000.0)).alias("end_time"),
        F.when(F.pmod("word_index", F.lit(13)) != 0, confidence).alias("confidence"),
        "turn",
    )


def words(spark: SparkSession, folder: str) -> DataFrame:
    """Word-level transcripts: one conversation is one recording, its turns are spoken in order."""
    turns = table(spark, folder, "conversations").select(
        F.concat(F.lit("p"), F.pmod("conv_id", F.lit(5))).alias("project_slug"),
        F.concat(F.lit("c"), F.col("conv_id")).alias("source_slug"),
        "turn",
        _tokens(F.col("text")).alias("tokens"),
    )
    return _words_of_turns(turns)


def doc_words(spark: SparkSession, folder: str) -> DataFrame:
    """The same recipe on documents: one document is one recording, its lines are the turns."""
    lines = table(spark, folder, "documents").select(
        F.col("lang").alias("project_slug"),
        F.concat(F.lit("d"), F.col("doc_id")).alias("source_slug"),
        F.posexplode(F.split("text", "\n")).alias("turn", "line"),
    )
    return _words_of_turns(
        lines.select(*WORD_KEYS, F.col("turn").cast("long").alias("turn"), _tokens(F.col("line")).alias("tokens"))
    )


def longest_doc(spark: SparkSession, folder: str) -> int:
    """No document has more words than that: words are summed per hash of the document, which is never less than those of one in it."""
    counted = table(spark, folder, "documents").groupBy(F.pmod(F.xxhash64("lang", "doc_id"), F.lit(KEY_HASHES)).alias("_h"))
    return counted.agg(F.sum(F.size(_tokens(F.coalesce("text", F.lit(""))))).alias("_n")).agg(F.max("_n")).first()[0] or 0


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as scenes of an analysis: one scene per turn, in order."""
    return words(spark, folder).groupBy(*WORD_KEYS, F.col("turn").alias("scene_index")).agg(
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.count(F.lit(1)).alias("n_words"),
    )


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Edit segments: an order is a spec, its lines in shipping order are the segments."""
    line = table(spark, folder, "lineitem")
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag"]
    # Days as blocks are hardly longer than one row, so they are used only if some order is longer than a block may be.
    block = None if fits(line, ["l_orderkey"]) else F.to_date("l_shipdate")
    numbered = row_numbers(line.select("l_orderkey", *order), ["l_orderkey"], order, block, "seg_index")
    # Parts of 1/1024 s lie between the instants of the renderer's axis.
    start = F.col("l_quantity") - 1.0 + F.pmod(F.col("l_partkey"), F.lit(8)) / F.lit(1024.0)
    part, ln = F.col("l_partkey"), F.col("l_linenumber")
    return numbered.select(
        F.col("l_orderkey").alias("spec_id"),
        F.col("seg_index").cast("long").alias("seg_index"),
        F.concat(F.lit("c"), F.col("l_suppkey")).alias("source_id"),
        start.alias("start"),
        (start + 1.0 + F.pmod(part, F.lit(20)) + F.pmod(ln, F.lit(4)) / F.lit(1024.0)).alias("end"),
        F.when(F.pmod(part, F.lit(7)) == 0, F.lit(None).cast("double"))
        .when(F.pmod(ln, F.lit(3)) == 0, F.lit(1.0))
        .when(F.pmod(ln, F.lit(3)) == 1, F.lit(2.0))
        .otherwise(F.lit(0.5))
        .alias("speed"),
        F.when((F.col("l_returnflag") == "R") | (F.pmod(part, F.lit(5)) == 0), F.lit("crossfade")).alias("transition_type"),
        F.when(F.col("l_returnflag") == "R", F.lit(0.5))
        .when(F.pmod(part, F.lit(5)) == 0, F.lit(1.5))
        .alias("transition_duration"),
        F.when(F.col("l_discount") < 0.02, F.lit(0.0)).when(F.col("l_tax") > 0.06, F.lit(0.5)).alias("volume"),
        F.when(F.pmod(part, F.lit(11)) == 0, F.lit(True))
        .when(F.pmod(part, F.lit(13)) == 0, F.lit(False))
        .alias("audio_from_prev"),
    )


def overlays(spark: SparkSession, folder: str) -> DataFrame:
    """One to three overlays per spec, of all four kinds, some with invalid speed."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    laid = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), F.pmod(cust, F.lit(3)).cast("int"))).alias("i")
    )
    i = F.col("i")
    kind = F.pmod(key + i, F.lit(4))
    start = F.pmod(cust, F.lit(8)) + i * 1.5
    return laid.select(
        key.alias("spec_id"),
        i.cast("long").alias("ov_index"),
        F.when(kind <= 1, F.concat(F.lit("c"), F.floor(cust / F.lit(15)) + i)).alias("source_id"),
        start.cast("double").alias("start"),
        (start + 1.0 + F.pmod(key, F.lit(6)) * 0.5).alias("end"),
        (F.pmod(key, F.lit(5)) * 0.25).alias("x"),
        (F.pmod(cust, F.lit(4)) * 0.25).alias("y"),
        F.lit(0.5).alias("width"),
        F.when(F.pmod(key, F.lit(9)) == 0, F.lit(0.0)).otherwise(F.lit(0.25)).alias("height"),
        F.when(F.pmod(key, F.lit(3)) == 0, F.lit(0.5)).alias("opacity"),
        F.when(F.pmod(key, F.lit(4)) > 0, F.pmod(key, F.lit(5)).cast("double")).alias("source_start"),
        F.when(F.pmod(cust, F.lit(2)) == 0, F.lit(3) - i).cast("long").alias("z_index"),
        F.when((kind == 3) & (F.pmod(key, F.lit(3)) > 0), F.lit("#1a1a2e")).when(kind == 3, F.lit("#zz")).alias("background_color"),
        F.when((kind == 2) & (F.pmod(cust, F.lit(2)) == 0), F.concat(F.lit("Title "), cust)).alias("title"),
        F.when((kind == 2) & (F.pmod(cust, F.lit(2)) == 1), F.lit("/img/card.png")).alias("image_path"),
        F.when(F.pmod(key, F.lit(2)) == 0, F.lit(0.5)).alias("fade_in"),
        F.when(F.pmod(key, F.lit(3)) == 1, F.lit(0.25)).alias("fade_out"),
        F.when(F.pmod(key, F.lit(7)) == 0, F.lit(0.125))
        .when(F.pmod(key, F.lit(7)) == 1, F.lit(2.0))
        .when(F.pmod(key, F.lit(7)) == 2, F.lit(8.0))
        .alias("speed"),
    )


def _event_seconds() -> Column:
    return (F.unix_timestamp("ts") - F.lit(1704067200)).cast("long")


def keyframes(spark: SparkSession, folder: str) -> DataFrame:
    """Animation keyframes: a user is an overlay track, each event sets one channel at its second."""
    value = F.floor(F.col("value") * 4) / F.lit(4.0)

    def channel(kind: str) -> Column:
        return F.when(F.col("event_type") == kind, value)

    return table(spark, folder, "events").select(
        F.concat(F.lit("k"), F.col("user_id")).alias("track_id"),
        F.col("event_id").alias("keyframe_id"),
        (_event_seconds() * 1.0).alias("time"),
        channel("click").alias("scale"),
        channel("view").alias("opacity"),
        channel("purchase").alias("x"),
        channel("signup").alias("y"),
        channel("error").alias("rotation"),
    )


def assets(spark: SparkSession, folder: str) -> DataFrame:
    """Media files: one part is one asset."""
    key, size = F.col("p_partkey"), F.col("p_size")
    portrait = F.pmod(key, F.lit(3)) == 1
    long_side = F.when(F.col("p_type") == "LARGE", F.lit(3840)).when(F.col("p_type") == "SMALL", F.lit(1280)).otherwise(F.lit(1920))
    short_side = F.when(F.col("p_type") == "LARGE", F.lit(2160)).when(F.col("p_type") == "SMALL", F.lit(720)).when(
        F.col("p_type") == "PROMO", F.lit(1440)
    ).otherwise(F.lit(1080))
    return table(spark, folder, "part").select(
        F.concat(F.lit("p"), F.pmod(size, F.lit(5))).alias("project_slug"),
        F.concat(F.lit("a"), key).alias("slug"),
        F.concat(F.col("p_name"), F.lit(" "), key, F.lit(".MP4")).alias("filename"),
        F.concat(F.lit("/media/"), F.col("p_brand"), F.lit("/"), F.col("p_name"), F.lit(" "), key, F.lit(".MP4")).alias("file_path"),
        (key * 1000 + size).cast("long").alias("file_size_bytes"),
        (size * 1.5).alias("duration_seconds"),
        F.when(portrait, short_side).otherwise(long_side).cast("int").alias("width"),
        F.when(portrait, long_side).otherwise(short_side).cast("int").alias("height"),
        F.when(F.pmod(key, F.lit(4)) == 0, F.lit(29.97))
        .when(F.pmod(key, F.lit(4)) == 1, F.lit(23.976))
        .when(F.pmod(key, F.lit(4)) == 2, F.lit(60.0))
        .otherwise(F.lit(12.5))
        .alias("fps"),
        F.when(F.pmod(key, F.lit(2)) == 0, F.lit("hevc")).otherwise(F.lit("h264")).alias("codec"),
        (F.pmod(key, F.lit(5)) != 0).alias("has_audio"),
        F.concat(F.lit('["'), F.lower("p_type"), F.lit('","'), F.lower("p_brand"), F.lit('"]')).alias("tags_json"),
        F.timestamp_seconds(F.lit(1704067200) + F.pmod(key * 7919, F.lit(1000)) * 60).alias("created"),
    )


def projects(spark: SparkSession, folder: str) -> DataFrame:
    """Projects: one customer is one project."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        F.concat(F.lit("p"), key).alias("slug"),
        F.col("c_name").alias("name"),
        F.when(F.pmod(key, F.lit(10)) == 9, F.lit("archived")).otherwise(F.lit("active")).alias("status"),
        F.when(F.pmod(key, F.lit(4)) > 0, F.col("c_mktsegment")).alias("description"),
        F.timestamp_seconds(F.lit(1704067200) + key * 3600).alias("created"),
        F.timestamp_seconds(F.lit(1704067200) + key * 3600).alias("updated"),
    )


def renders(spark: SparkSession, folder: str) -> DataFrame:
    """Stored renders: one order is one render of its customer's project."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.concat(F.lit("p"), F.col("o_custkey")).alias("project_slug"),
        F.concat(F.lit("r"), key).alias("slug"),
        F.when(F.col("o_orderstatus") == "F", F.lit("completed")).when(F.col("o_orderstatus") == "O", F.lit("draft")).otherwise(F.lit("failed")).alias("status"),
        (F.pmod(key, F.lit(480)) / F.lit(8.0)).alias("duration_seconds"),
        F.concat(F.lit("/out/render "), key, F.lit(".mp4")).alias("output_path"),
        (F.pmod(key * 7919, F.lit(100000)) * 1024).cast("long").alias("file_size_bytes"),
        F.concat(F.lit('["c'), F.pmod(key, F.lit(100)), F.lit('","c'), F.pmod(key * 7, F.lit(100)), F.lit('"]')).alias("sources_json"),
        F.col("o_orderpriority").alias("notes_md"),
        F.col("o_orderdate").alias("created"),
    )


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    """Phase timings: a user's events of one day are one render, the event type is the phase."""
    return table(spark, folder, "events").select(
        F.concat(F.lit("u"), F.col("user_id"), F.lit("/d"), F.dayofmonth("ts")).alias("render_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.col("event_type").alias("phase"),
        (F.floor(F.col("value") * 4) / F.lit(4.0)).alias("seconds"),
    )


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Per-frame timings: a user is a render, each event is a frame."""
    return table(spark, folder, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("render_id"),
        F.col("event_id").alias("seq"),
        (_event_seconds() * 1.0).alias("recorded_at"),
        (F.floor(F.col("value") * 4) / F.lit(4.0)).alias("elapsed"),
    )


def usage_of(events: DataFrame) -> DataFrame:
    """Metered requests of events: tenths of a minute, every third user pays, user 1 makes a third of all requests.

    Some durations are missing, negative, zero or not a number.
    """
    user = F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit(1)).otherwise(F.col("user_id"))
    spoilt = F.pmod("event_id", F.lit(97))
    tenths = (F.floor(F.col("value") / 2.0) + 1) * 6.0
    return events.select(
        F.concat(F.lit("u"), user).alias("uid"),
        F.when(F.pmod(user, F.lit(3)) == 0, F.lit("pro")).otherwise(F.lit("free")).alias("tier"),
        F.col("event_id").alias("request_id"),
        "ts",
        F.when(spoilt == 2, -tenths).when(spoilt == 3, F.lit(0.0)).when(spoilt == 4, F.lit(float("nan"))).when(spoilt != 1, tenths).alias("duration_seconds"),
    )


def usage(spark: SparkSession, folder: str) -> DataFrame:
    return usage_of(table(spark, folder, "events"))


def specs(spark: SparkSession, folder: str) -> DataFrame:
    """Render specs as JSON documents, one per order: key, default_project, spec_json.

    Even keys are written in snake_case, odd ones in camelCase; every kind of mistake occurs in some documents.
    """
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    def member(name: str, value: Column, when: Column | None = None, quoted: bool = False) -> Column:
        shown = text('"', value, '"') if quoted else value.cast("string")
        piece = text(f'"{name}":', shown)
        return piece if when is None else F.when(when, piece)

    def document(*members: Column) -> Column:
        return text("{", F.concat_ws(",", *members), "}")

    def listed(count: Column, of) -> Column:
        numbers = F.filter(F.sequence(F.lit(0), F.greatest(count, F.lit(1)).cast("int") - 1), lambda i: i < count)
        return text("[", F.array_join(F.transform(numbers, of), ","), "]")

    def source(i: Column) -> Column:
        return document(
            member("id", text("s", F.when((F.pmod(k, F.lit(19)) == 0) & (i > 0), F.lit(0)).otherwise(i)), quoted=True),
            member("path", text("/media/", F.pmod(c + i, F.lit(1000)), ".mp4"), quoted=True),
            member("transcript_id", text("p", F.pmod(k, F.lit(5)), "/c", F.pmod(k + i, F.lit(140))), (F.pmod(k, F.lit(2)) == 0) & (i < 2), quoted=True),
        )

    def segment(i: Column) -> Column:
        start = i * 2.0 - F.when(F.pmod(k, F.lit(23)) == 0, F.lit(3.0)).otherwise(F.lit(0.0))
        return document(
            member("source_id", text("s", F.pmod(i, F.pmod(k, F.lit(3)) + 1 + F.when(F.pmod(k, F.lit(11)) == 0, 1).otherwise(0))), quoted=True),
            member("start", start),
            member("end", start + F.pmod(k + i, F.lit(5)) * 0.5),
            member("speed", F.when(F.pmod(k, F.lit(4)) == 1, F.lit(2.0)).otherwise(F.lit(0.125)), F.pmod(k + i, F.lit(4)) == 1),
            member("transition", text('{"type":"crossfade","duration":', F.pmod(k, F.lit(8)) * 0.25, "}"), F.pmod(i, F.lit(2)) == 1),
            member("volume", F.lit(0.5), F.pmod(i, F.lit(3)) == 2),
            member("audio_from_prev", F.lit(True), F.pmod(k, F.lit(31)) == 5),
            member("keyframes", F.lit('[{"time":0,"scale":1.5,"pan_x":0.25},{"time":1.0,"pan_y":-0.5}]'), F.pmod(k + i, F.lit(6)) == 0),
        )

    def overlay(i: Column) -> Column:
        kind = F.pmod(k + i, F.lit(5))
        return document(
            member("source_id", text("s", F.pmod(k, F.lit(4))), kind == 0, quoted=True),
            member("background_color", F.when(F.pmod(k, F.lit(3)) == 0, F.lit("#12345")).otherwise(F.lit("#1a1a2eff")), kind == 1, quoted=True),
            member("text", F.when(F.pmod(k, F.lit(2)) == 0, text('{"title":"T', c, '"}')).otherwise(F.lit('{"title":""}')), kind == 2),
            member("image_path", text("/img/", F.pmod(c, F.lit(50)), ".png"), kind == 3, quoted=True),
            member("start", i * 0.5), member("end", i * 0.5 + F.pmod(c, F.lit(6)) * 0.5),
            member("x", F.pmod(k, F.lit(6)) * 0.25), member("y", F.lit(0.0)), member("width", F.lit(0.5)),
            member("height", F.pmod(c, F.lit(4)) * 0.5),
            member("speed", F.when(F.pmod(k, F.lit(3)) == 0, F.lit(8.0)).otherwise(F.lit(2.0)), F.pmod(c, F.lit(3)) == 0),
            member("keyframes", F.lit('[{"time":0,"scale":2.0},{"time":0.5,"opacity":0.5,"rotation":90}]'), F.pmod(k, F.lit(10)) == 0),
        )

    caption = document(
        member("preset", F.when(F.pmod(k, F.lit(9)) == 0, F.lit("nope")).otherwise(F.lit("minimal")), F.pmod(k, F.lit(6)) != 3, quoted=True),
        member("transcript_id", text("c", F.pmod(k, F.lit(140))), F.pmod(k, F.lit(5)) == 1, quoted=True),
        member("font_size", F.lit(6.5), F.pmod(k, F.lit(4)) == 0),
        member("all_caps", F.lit(True)),
    )
    body = document(
        member("sources", listed(F.pmod(k, F.lit(3)) + 1, source)),
        member("segments", listed(F.pmod(k, F.lit(4)), segment), F.pmod(k, F.lit(37)) != 1),
        member("overlays", listed(F.pmod(c, F.lit(3)), overlay), F.pmod(c, F.lit(3)) > 0),
        member("captions", caption, F.pmod(k, F.lit(3)) == 0),
        member("audio", text('{"music_path":"/music/', F.pmod(c, F.lit(30)), '.mp3","music_volume":0.25}'), F.pmod(k, F.lit(4)) == 1),
        member("quality", F.lit('{"codec":"hevc"}'), F.pmod(k, F.lit(7)) == 2),
        member("aspect_ratio", F.lit("9:16"), F.pmod(k, F.lit(5)) == 2, quoted=True),
        member("resolution", F.when(F.pmod(k, F.lit(3)) == 1, F.lit('{"width":640,"height":360}')).otherwise(F.lit('"720p"')), F.pmod(k, F.lit(5)) > 2),
        member("fps", F.lit(30), F.pmod(k, F.lit(2)) == 0),
        member("output_path", text("/out/", F.pmod(c, F.lit(20)), "/r", k, ".mp4"), F.pmod(k, F.lit(29)) != 3, quoted=True),
    )
    camel = body
    for name in ("source_id", "transcript_id", "audio_from_prev", "pan_x", "pan_y", "background_color", "image_path", "font_size", "all_caps", "music_path", "music_volume", "aspect_ratio", "output_path"):
        head, *tail = name.split("_")
        camel = F.replace(camel, F.lit(f'"{name}":'), F.lit(f'"{head}{"".join(t.title() for t in tail)}":'))
    return table(spark, folder, "orders").select(
        k.alias("spec_id"), text("p", F.pmod(c, F.lit(5))).alias("default_project"),
        F.when(F.pmod(k, F.lit(2)) == 0, body).otherwise(camel).alias("spec_json"),
    )
