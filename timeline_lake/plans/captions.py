"""Captions on the composition axis: groups of words, their windows, exclusions, highlights and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeline_lake.functions._columns import ColumnOrName, col
from timeline_lake.operators.blocks import BLOCK, BLOCK_ROWS, block_of, block_window, core_rows, halo, last_known, next_known, row_numbers
from timeline_lake.operators.joins import overlapping_intervals
from timeline_lake.session import cut_lineage

BREAK_SECONDS = 1.0  # fixed value: a longer pause starts a new caption


def caption_groups(words: DataFrame, keys: list[str], totals: DataFrame, size: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``position`` and ``group_start`` (the position of the group's first word) to the words that can be shown.

    Groups break at pauses over 1 s and after ``size`` words. ``words``: keys, word_index, word, start_time, end_time in
    play order. ``totals``: keys, total.
    """
    start, end = F.col("start_time"), F.col("end_time")
    valid = words.join(totals, keys).filter((start >= 0) & (end > start) & (start < F.col("total")))
    placed = cut_lineage(row_numbers(valid, keys, ["word_index"], block_of("word_index", rows), "position"))
    near = halo(placed, "position", before=1, rows=rows)
    pause = start - F.lag("end_time").over(block_window(keys, "position"))
    broken = core_rows(near.withColumn("_pause", pause)).drop(BLOCK)
    fresh = F.when(F.col("_pause").isNull() | (F.col("_pause") > BREAK_SECONDS), F.col("position"))
    islands = last_known(broken, keys, "position", {"_island": fresh}, block_of("position", rows))
    inside = F.col("position") - F.col("_island")
    return islands.withColumn("group_start", F.col("position") - F.pmod(inside, F.lit(size))).drop("_pause", "_island")


def caption_windows(grouped: DataFrame, keys: list[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per group that is visible: until its last word ends, the composition ends or the next group starts.

    The next group counts even when it is itself dropped.
    """
    spans = grouped.groupBy(*keys, "group_start").agg(
        F.min_by("start_time", "position").alias("start"),
        F.max_by("end_time", "position").alias("_last"),
        F.first("total").alias("total"),
        F.count(F.lit(1)).alias("n_words"),
    )
    followed = next_known(spans, keys, "group_start", {"_next": F.col("start")}, block_of("group_start", rows))
    # least() passes over a missing next group.
    ended = followed.withColumn("end", F.least("_last", "total", "_next"))
    return ended.filter(F.col("end") > F.col("start")).select(*keys, "group_start", "start", "end", "n_words")


def exclude_zones(windows: DataFrame, zones: DataFrame, keys: list[str]) -> DataFrame:
    """Drop groups that overlap a zone (keys, zone_start, zone_end) where text or an image is already shown."""
    hit = overlapping_intervals(windows, zones, keys, ("start", "end"), ("zone_start", "zone_end"))
    return windows.join(hit.select(*keys, "group_start").distinct(), [*keys, "group_start"], "left_anti")


def caption_highlights(grouped: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Per shown word the time it is highlighted: its own, inside its group's window, at least 0.01 s."""
    shown = grouped.join(windows.select(*keys, "group_start", "start", "end"), [*keys, "group_start"])
    lit_from = F.greatest("start_time", "start")
    return shown.select(
        *keys, "group_start", "position", "word", lit_from.alias("lit_from"),
        F.greatest(F.least("end_time", "end"), lit_from + 0.01).alias("lit_until"),
    )


def caption_word(word: ColumnOrName, all_caps: ColumnOrName, strip: ColumnOrName) -> Column:
    """A word as shown: punctuation other than apostrophes removed and letters raised, if the style says so."""
    plain = F.when(col(strip), F.regexp_replace(col(word), "[^\\P{P}'’]", "")).otherwise(col(word))
    return F.when(col(all_caps), F.upper(plain)).otherwise(plain)


def caption_lines(grouped: DataFrame, keys: list[str], all_caps: bool, strip: bool) -> DataFrame:
    """The text of each group; a group has at most ``size`` words."""
    shown = caption_word("word", F.lit(all_caps), F.lit(strip))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", shown.alias("shown")))), lambda w: w["shown"]), " ")
    return grouped.groupBy(*keys, "group_start").agg(text.alias("text"))
