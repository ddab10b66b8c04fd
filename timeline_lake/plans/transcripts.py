"""Transcript analytics: utterances, gaps, word flags, silence removal, repair and stitching.

`words`: project_slug, source_slug, word_index (0, 1, 2, … within a source), word, start_time, end_time, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeline_lake.functions.numbers import round_half_away
from timeline_lake.session import cut_lineage
from timeline_lake.operators.blocks import (
    BLOCK,
    BLOCK_ROWS,
    block_of,
    block_window,
    core_rows,
    halo,
    last_known,
    next_known,
    running_sums,
)
from timeline_lake.operators.scans import values_before

KEYS = ["project_slug", "source_slug"]

# Limits and the short-word list the results depend on.
GAP_SECONDS = 0.4
SUSPICIOUS_GAP_SECONDS = 2.0
LOW_CONFIDENCE = 0.5
COMMON_SHORT_WORDS = (
    "i", "a", "an", "is", "it", "be", "to", "in", "of", "on", "at", "by", "we", "he", "me",
    "my", "no", "so", "up", "us", "or", "if", "as", "do", "go", "oh", "ok", "hi", "yo", "ah",
    "um", "uh",
)
NORMAL_WORD = "^[a-zA-Z]+(-[a-zA-Z]+)*('[a-zA-Z]+)?$"
CHUNK_SECONDS = 55.0
CHUNK_STEP_SECONDS = 50.0


def with_gap_before(words: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``gap``, the silence since the previous word (null for the first); keeps ``_block``."""
    seen = halo(words, "word_index", before=1, rows=rows)
    previous_end = F.lag("end_time").over(block_window(KEYS, "word_index"))
    return core_rows(seen.withColumn("prev_end", previous_end)).withColumn("gap", F.col("start_time") - F.col("prev_end"))


def utterances(words: DataFrame, rows: int = BLOCK_ROWS, longest: int | None = None) -> DataFrame:
    """Runs of words without a silence of 0.4 s or more: first_index, last_index, n_words, exact start and end, text.

    ``longest``: no recording has more words than that. Where that is no more than a block, utterances are made where the words of
    their recording lie, and lie there in order, recording by recording.

    Pieces of utterances are formed inside blocks. Only the first and last piece of a block can belong to an
    utterance that crosses a border, so only those meet in one per-source window, where each learns where its
    utterance began; then pieces with the same beginning are joined.
    """
    spoken = _whole_utterances(words) if longest is not None and longest <= rows else _joined_utterances(words, rows)
    return spoken.withColumn("n_words", F.size("words").cast("long")).withColumn("text", F.array_join("words", " "))


def _whole_utterances(words: DataFrame) -> DataFrame:
    """:func:`utterances` of recordings that fit a row each: their words in order are cut into slices where a silence ends.

    What later steps read more than once is put in a list of one and taken out, so that it is not worked out anew for every use.
    """
    word = F.struct("word_index", "word", "start_time", "end_time")
    said = words.filter("word_index is not null").groupBy(*KEYS).agg(F.collect_list(word).alias("_said"))
    listed = said.select(*KEYS, F.explode(F.array(F.array_sort("_said"))).alias("_all"))

    def at(place: Column, field: str) -> Column:
        return F.get("_all", place)[field]

    def breaks(i: Column) -> Column:
        return (i == 0) | F.coalesce(at(i, "start_time") - at(i - 1, "end_time") >= GAP_SECONDS, F.lit(True))

    broken = listed.select("*", F.explode(F.array(F.filter(F.sequence(F.lit(0), F.size("_all") - 1), breaks))).alias("_at"))
    # A run is named by the index of its first word, so breaks at one index are one break.
    fresh = F.filter("_at", lambda i, k: (k == 0) | (at(i, "word_index") != at(F.get("_at", k - 1), "word_index")))
    parted = broken.select(*KEYS, "_all", F.explode(F.array(fresh)).alias("_at"))

    def cut(start: Column, k: Column) -> Column:
        return F.slice("_all", start + 1, F.coalesce(F.get("_at", k + 1), F.size("_all")) - start)

    run = parted.select(*KEYS, F.explode(F.transform("_at", cut)).alias("_run"))
    first, last = F.get("_run", F.lit(0)), F.get("_run", F.size("_run") - 1)
    return run.select(
        *KEYS, first["word_index"].alias("first_index"), last["word_index"].alias("last_index"), first["start_time"].alias("start"),
        last["end_time"].alias("end"), F.transform("_run", lambda w: w["word"]).alias("words"),
    )


def _joined_utterances(words: DataFrame, rows: int) -> DataFrame:
    broken = with_gap_before(words, rows).withColumn(
        "_break", F.when(F.col("gap").isNull() | (F.col("gap") >= GAP_SECONDS), F.col("word_index"))
    )
    run = broken.withColumn("_run", F.last("_break", ignorenulls=True).over(block_window(KEYS, "word_index")))
    pieces = run.groupBy(*KEYS, BLOCK, "_run").agg(
        F.min("word_index").alias("_from"),
        F.max("word_index").alias("_to"),
        F.min_by("start_time", "word_index").alias("_start"),
        F.max_by("end_time", "word_index").alias("_end"),
        F.transform(F.array_sort(F.collect_list(F.struct("word_index", "word"))), lambda w: w["word"]).alias("_words"),
    )
    whole = Window.partitionBy(*KEYS, BLOCK)
    at_border = F.col("_run").isNull() | (F.col("_to") == F.max("_to").over(whole))
    bordering = pieces.withColumn("_home", F.when(at_border, F.lit(-1)).otherwise(F.col(BLOCK)))
    owner = Window.partitionBy(*KEYS, "_home").orderBy("_from").rowsBetween(Window.unboundedPreceding, 0)
    owned = bordering.withColumn("first_index", F.last("_run", ignorenulls=True).over(owner))
    return owned.groupBy(*KEYS, "first_index").agg(
        F.max("_to").alias("last_index"),
        F.min_by("_start", "_from").alias("start"),
        F.max_by("_end", "_from").alias("end"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_from", "_words"))), lambda p: p["_words"])).alias("words"),
    )


def compact_utterances(words: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Utterances as reported: times to 0.1 s."""
    return utterances(words, rows).select(
        *KEYS,
        F.col("first_index").alias("word_index"),
        round_half_away("start", 1).alias("start"),
        round_half_away("end", 1).alias("end"),
        "text",
    )


def gaps(words: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per silence that splits utterances, at the index of the word after it."""
    return (
        with_gap_before(words, rows)
        .filter(F.col("gap") >= GAP_SECONDS)
        .select(*KEYS, "word_index", round_half_away("gap", 1).alias("gap"))
    )


def compact_entries(words: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Utterances and gaps alternating, one JSON object per row, in order of (word_index, entry)."""
    spoken = compact_utterances(words, rows).select(
        *KEYS, "word_index", F.lit(1).cast("long").alias("entry"), F.to_json(F.struct("end", "start", "text")).alias("json")
    )
    silent = gaps(words, rows).select(*KEYS, "word_index", F.lit(0).cast("long").alias("entry"), F.to_json(F.struct("gap")).alias("json"))
    return silent.unionByName(spoken)


def silence_segments(
    words: DataFrame, durations: DataFrame, padding: float = 0.15, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Spans to keep when silences are cut: padded utterances, merged where they touch.

    An end is rounded to 0.01 when it opens a span and left as it is when it extends one, and the next utterance is
    tested against that value. Whether utterance ``i`` opens a span is therefore a function of one bit, whether
    ``i - 1`` did: constant (almost always), the same bit, or its opposite. The bit is found as the last constant,
    flipped once per "opposite" since then, which needs running counts but no pass in sequence.
    ``durations``: project_slug, source_slug, duration_seconds.
    """
    spoken = with_gap_before(words, rows).filter(F.col("gap").isNull() | (F.col("gap") >= GAP_SECONDS)).select(
        *KEYS, "word_index", "start_time", "prev_end"
    )
    total = F.col("duration_seconds")
    begun = (
        spoken.join(durations, KEYS)
        .withColumn("_s", F.greatest(F.lit(0.0), round_half_away("start_time", 1) - F.lit(padding)))
        .withColumn(
            "_e", F.when(F.col("prev_end").isNotNull(), F.least(total, round_half_away("prev_end", 1) + F.lit(padding)))
        )
    )
    past_rounded = F.col("_s") > round_half_away("_e", 2)
    past_exact = F.col("_s") > F.col("_e")
    opens = cut_lineage(begun).withColumn(
        "_fixed", F.when(F.col("_e").isNull(), F.lit(True)).when(past_rounded == past_exact, past_rounded)
    ).withColumn("_flip", F.when(F.col("_fixed").isNull() & ~past_rounded & past_exact, 1).otherwise(0))
    block = block_of("word_index", rows)
    counted = _count_flips(opens, block)
    opened = F.col("_base") != (F.pmod(F.col("_flips") - F.col("_flips_then"), F.lit(2)) == 1)
    marked = cut_lineage(counted.select(*KEYS, "word_index", "_s", "prev_end", "duration_seconds", opened.alias("opens")))
    started = last_known(
        marked, KEYS, "word_index", {"span": F.when(F.col("opens"), F.col("word_index"))}, block
    )
    # An utterance's end is the previous word's end at the next utterance, or the transcript's last word's end.
    ends = words.groupBy(*KEYS).agg(F.max_by("end_time", "word_index").alias("_last_end"))
    followed = next_known(cut_lineage(started), KEYS, "word_index", {"_next_prev_end": F.col("prev_end")}, block)
    closed = followed.join(ends, KEYS).withColumn("_stop_raw", F.coalesce(F.col("_next_prev_end"), F.col("_last_end")))
    stop = F.least(total, round_half_away("_stop_raw", 1) + F.lit(padding))
    final = closed.withColumn("_stop", F.when(F.col("opens"), round_half_away(stop, 2)).otherwise(stop))
    return final.groupBy(*KEYS, "span").agg(
        F.min_by(round_half_away("_s", 2), "word_index").alias("start"), F.max_by("_stop", "word_index").alias("end")
    )


def _count_flips(opens: DataFrame, block: Column) -> DataFrame:
    """Per row: the last fixed bit at or before it, and the flip counts now and then."""
    summed = cut_lineage(
        running_sums(opens, KEYS, "word_index", {"_before": F.col("_flip")}, block).withColumn(
            "_flips", F.col("_before") + F.col("_flip")
        )
    )
    fixed = F.when(F.col("_fixed").isNotNull(), F.struct(F.col("_fixed").alias("bit"), F.col("_flips").alias("n")))
    known = last_known(summed, KEYS, "word_index", {"_at": fixed}, block)
    return known.withColumn("_base", F.col("_at.bit")).withColumn("_flips_then", F.col("_at.n"))


def silence_summary(words: DataFrame, durations: DataFrame, gap_threshold: float = 0.4, rows: int = BLOCK_ROWS) -> DataFrame:
    """Silences at or above the threshold, counted on their rounded length. The threshold does not change the spans."""
    counted = gaps(words, rows).filter(F.col("gap") >= gap_threshold).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("gaps_removed"), F.sum(F.round(F.col("gap") * 10).cast("long")).alias("_tenths")
    )
    return durations.join(counted, KEYS, "left").select(
        *KEYS,
        F.coalesce("gaps_removed", F.lit(0)).alias("gaps_removed"),
        (F.coalesce("_tenths", F.lit(0)) / F.lit(10.0)).alias("time_saved_seconds"),
        round_half_away("duration_seconds", 2).alias("original_duration_seconds"),
    )


def _neighbourhood(words: DataFrame, reach: int, rows: int) -> DataFrame:
    return halo(words, "word_index", before=reach, after=reach, rows=rows)


def word_reason(normalize: bool = False) -> Column:
    """First matching reason to doubt a word; expects ``_gap_before`` and ``_gap_after``.

    ``normalize`` tests the word without leading and trailing punctuation, so that "hello," is not flagged.
    """
    word = F.regexp_replace("word", "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", "") if normalize else F.col("word")
    short = (F.length(word) <= 2) & word.rlike("^[a-zA-Z]+$") & ~F.lower(word).isin(*COMMON_SHORT_WORDS)
    percent = F.floor(F.col("confidence") * 100).cast("long")
    return (
        F.when(short, F.lit("unusually short word"))
        .when(~word.rlike(NORMAL_WORD), F.lit("unusual character pattern"))
        .when(
            (F.col("_gap_before") > SUSPICIOUS_GAP_SECONDS) | (F.col("_gap_after") > SUSPICIOUS_GAP_SECONDS),
            F.lit("adjacent to long silence gap"),
        )
        .when(F.col("confidence") < LOW_CONFIDENCE, F.concat(F.lit("low confidence ("), percent, F.lit("%)")))
    )


def word_flags(words: DataFrame, normalize: bool = False, context: bool = True, rows: int = BLOCK_ROWS) -> DataFrame:
    """Doubtful words with the reason and, if asked, three words of context on each side."""
    reach = 3 if context else 1
    near = _neighbourhood(words, reach, rows)
    order = block_window(KEYS, "word_index")
    near = near.withColumn(
        "_gap_before", F.coalesce(F.col("start_time") - F.lag("end_time").over(order), F.lit(0.0))
    ).withColumn("_gap_after", F.coalesce(F.lead("start_time").over(order) - F.col("end_time"), F.lit(0.0)))
    shown = [*KEYS, "word_index", "word", round_half_away("start_time", 1).alias("start"), round_half_away("end_time", 1).alias("end"), "reason"]
    if context:
        near = near.withColumn(
            "context",
            F.concat_ws(
                " ",
                *[F.lag("word", k).over(order) for k in (3, 2, 1)],
                F.concat(F.lit("["), F.col("word"), F.lit("]")),
                *[F.lead("word", k).over(order) for k in (1, 2, 3)],
            ),
        )
        shown.append("context")
    return core_rows(near).withColumn("reason", word_reason(normalize)).filter(F.col("reason").isNotNull()).select(*shown)


def repair_end_times(words: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Mend ends that lie at or before their start, or more than 0.5 s after the next start."""
    near = halo(words, "word_index", after=1, rows=rows)
    near = near.withColumn("_next", F.lead("start_time").over(block_window(KEYS, "word_index")))
    start, end, following = F.col("start_time"), F.col("end_time"), F.col("_next")
    mended = (
        F.when(end <= start, F.greatest(F.coalesce(following, start + 0.3), start + 0.01))
        .when(end > following + 0.5, following)
        .otherwise(end)
    )
    return core_rows(near).withColumn("end_time", mended).drop(BLOCK, "_next")


def stitch_chunks(chunk_words: DataFrame, chunks: DataFrame) -> DataFrame:
    """Join overlapping chunk transcripts into one word list on the recording's axis.

    ``chunk_words``: keys, chunk_index, word_index (within the chunk), word, start_time, end_time, confidence.
    ``chunks``: keys, chunk_index, offset, duration. A word is dropped when it starts more than 1 s after its chunk, or
    before the end of the last word accepted from earlier chunks.
    """
    single = chunks.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_chunks"))
    length = F.when(F.col("duration") > 0, F.col("duration")).otherwise(F.lit(CHUNK_SECONDS))
    joined = chunk_words.join(chunks, [*KEYS, "chunk_index"]).join(single, KEYS)
    alone = joined.filter(F.col("_chunks") == 1).select(
        *KEYS, "chunk_index", "word_index", "word", "start_time", "end_time", "confidence"
    )
    kept = joined.filter((F.col("_chunks") > 1) & (F.col("start_time") <= length + 1.0))
    clamped = F.least(F.col("end_time"), length)
    safe_end = F.when(clamped > F.col("start_time"), clamped).otherwise(F.col("start_time") + 0.3)
    placed = kept.select(
        *KEYS,
        "chunk_index",
        "word_index",
        "word",
        (F.col("start_time") + F.col("offset")).alias("start_time"),
        (safe_end + F.col("offset")).alias("end_time"),
        "confidence",
    )
    cutoffs = _stitch_cutoffs(placed)
    accepted = placed.join(cutoffs, [*KEYS, "chunk_index"]).filter(
        (F.col("chunk_index") == 0) | F.col("cutoff").isNull() | (F.col("start_time") >= F.col("cutoff"))
    )
    return accepted.drop("cutoff").unionByName(alone)


def _stitch_cutoffs(placed: DataFrame) -> DataFrame:
    """Per chunk, the end of the last word accepted before it.

    In a chunk only the last word with ``start >= cutoff`` matters; words that a later word of the chunk starts after
    are never it, so a chunk (at most a minute of speech) is a step function of the cutoff with a few pieces. The first
    chunk takes every word, whatever the cutoff is.
    """
    later = Window.partitionBy(*KEYS, "chunk_index").orderBy(F.desc("word_index")).rowsBetween(Window.unboundedPreceding, -1)
    records = placed.withColumn("_later", F.max("start_time").over(later))
    is_record = F.col("_later").isNull() | (F.col("start_time") > F.col("_later"))
    upto = F.when(F.col("chunk_index") == 0, F.lit(float("inf"))).otherwise(F.col("start_time"))
    record = F.struct("word_index", upto.alias("upto"), F.col("end_time").alias("to"))
    last_first = F.sort_array(F.collect_list(F.when(is_record, record)), asc=False)
    steps = records.groupBy(*KEYS, "chunk_index").agg(F.transform(last_first, lambda r: F.struct(r["upto"], r["to"])).alias("_steps"))
    return values_before(cut_lineage(steps), KEYS, "chunk_index", "_steps").withColumnRenamed("_before", "cutoff")


def transcript_rollup(words: DataFrame) -> DataFrame:
    """Word count, duration (end of the last word) and how the recording would have been transcribed."""
    last = F.max_by(F.greatest("end_time", "start_time"), "word_index")
    rolled = words.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("word_count"), last.alias("duration_seconds"))
    chunks = F.ceil(F.col("duration_seconds") / CHUNK_STEP_SECONDS)
    mode = F.when(F.col("duration_seconds") <= CHUNK_SECONDS, F.lit("sync")).otherwise(
        F.concat(F.lit("chunked-sync ("), chunks, F.lit(" chunks)"))
    )
    return rolled.withColumn("mode", mode)


def transcript_text(words: DataFrame, words_per_part: int = BLOCK_ROWS) -> DataFrame:
    """The running text in parts of a fixed number of words, in order of ``part``; no task holds a whole recording."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_index", "word"))), lambda w: w["word"]), " ")
    return words.groupBy(*KEYS, block_of("word_index", words_per_part).alias("part")).agg(text.alias("full_text"))
