"""Overlays on a composition: windows, splits at their borders, fades and keyframe animation.

`overlays`: spec_id, ov_index, source_id, start, end, x, y, width, height, opacity, source_start, z_index, fade_in,
fade_out, speed, … `keyframes`: track_id, time and the channels scale, opacity, x, y, rotation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeline_lake.functions.numbers import clamp, even_floor, lerp
from timeline_lake.operators.joins import bracket, overlapping_intervals, points_in_intervals
from timeline_lake.plans.timeline import from_ticks, on_axis, to_ticks
from timeline_lake.session import cut_lineage
from timeline_lake.operators.blocks import fits, last_known, next_known

SPEC = ["spec_id"]
# Playback limits, and what a channel is before its first keyframe.
SPEED_RANGE = (0.25, 4.0)
CHANNEL_DEFAULTS = {"scale": 1.0, "opacity": 1.0, "x": 0.0, "y": 0.0, "rotation": 0.0}
TRACK_BLOCK_SECONDS = 86400.0
SPLIT_BLOCK_SECONDS = 3600.0


def overlay_windows(overlays: DataFrame, source_lengths: DataFrame, width: int, height: int) -> DataFrame:
    """Overlays as placed: target rectangle in pixels, speed clamped, window cut when the source runs out, times on the
    renderer's axis.

    Stacking order within a spec is (z, ov_index). ``source_lengths``: source_id, source_length.
    """
    length = from_ticks(to_ticks(F.col("end")) - to_ticks(F.col("start")))
    speed = clamp(F.coalesce("speed", F.lit(1.0)), *SPEED_RANGE)
    known = overlays.join(source_lengths, "source_id", "left")
    left = F.col("source_length") - on_axis(F.coalesce("source_start", F.lit(0.0)))
    begin = on_axis(F.col("start"))
    short = F.col("source_id").isNotNull() & (length * speed > left)
    shown = F.when(short, on_axis(left / speed)).otherwise(length)
    return known.select(
        *SPEC,
        "ov_index",
        "source_id",
        F.coalesce("z_index", F.lit(0)).alias("z"),
        begin.alias("overlay_start"),
        (begin + shown).alias("overlay_end"),
        F.when(F.col("source_id").isNotNull(), speed).alias("rate"),
        F.when(F.col("source_id").isNotNull(), shown * speed).alias("source_used"),
        (F.col("x") * width).alias("left"),
        (F.col("y") * height).alias("top"),
        (F.col("width") * width).alias("target_width"),
        (F.col("height") * height).alias("target_height"),
        F.coalesce("opacity", F.lit(1.0)).alias("opacity"),
        F.coalesce("fade_in", F.lit(0.0)).alias("fade_in"),
        F.coalesce("fade_out", F.lit(0.0)).alias("fade_out"),
    )


TOP = (1 << 31) - 1  # cross-cuts lie above all overlays


def with_cross_cuts(windows: DataFrame, cuts: DataFrame, width: int, height: int) -> DataFrame:
    """Windows of overlays and, above them, of cross-cuts as full frames; ``ov_index`` is then the segment's index."""
    span = F.col("overlay_end") - F.col("overlay_start")
    frames = cuts.filter(F.col("overlay_start").isNotNull()).select(
        *SPEC, F.col("seg_index").alias("ov_index"), "source_id", F.lit(TOP).alias("z"), "overlay_start", "overlay_end", F.lit(1.0).alias("rate"), span.alias("source_used"),
        F.lit(0.0).alias("left"), F.lit(0.0).alias("top"), F.lit(float(width)).alias("target_width"), F.lit(float(height)).alias("target_height"),
        F.lit(1.0).alias("opacity"), "fade_in", "fade_out",
    )
    return windows.withColumn("cross_cut", F.lit(False)).unionByName(frames.withColumn("cross_cut", F.lit(True)))


def split_at_overlays(ranges: DataFrame, windows: DataFrame, ids: list[str]) -> DataFrame:
    """Cut ranges (spec_id, ids, start, end) wherever an overlay starts, ends, is faded in or begins to fade out.

    Only instants strictly inside a range cut it. Pieces are found by looking ahead to the next cut per (range, hour),
    so a range with very many cuts is still spread over tasks.
    """
    start, end = F.col("overlay_start"), F.col("overlay_end")
    instants = F.array_compact(
        F.array(
            start,
            end,
            F.when(F.col("fade_in") > 0, start + F.col("fade_in")),
            F.when(F.col("fade_out") > 0, end - F.col("fade_out")),
        )
    )
    cuts = windows.select(*SPEC, F.explode(instants).alias("cut")).distinct()
    keys = [*SPEC, *ids]
    ranges = cut_lineage(ranges)
    inner = points_in_intervals(cuts, ranges, SPEC, "cut", "start", "end", stored=True).filter(F.col("cut") > F.col("start"))
    points = ranges.filter(F.col("end") > F.col("start")).select(*keys, F.col("start").alias("piece_start"), "end").unionByName(
        inner.select(*keys, F.col("cut").alias("piece_start"), "end")
    )
    points = cut_lineage(points)
    block = None if fits(points, keys) else F.floor(F.col("piece_start") / SPLIT_BLOCK_SECONDS).cast("long")
    followed = next_known(points, keys, "piece_start", {"_next": F.col("piece_start")}, block)
    return followed.select(*keys, "piece_start", F.coalesce("_next", "end").alias("piece_end"))


def overlays_in_pieces(pieces: DataFrame, windows: DataFrame) -> DataFrame:
    """Pieces with every overlay visible in them."""
    return overlapping_intervals(pieces, windows, SPEC, ("piece_start", "piece_end"), ("overlay_start", "overlay_end"), stored=(False, True))


def opacity_at(time: Column) -> Column:
    """Opacity of an overlay at an instant, from its base opacity and fade ramps."""
    start, end, fade_in, fade_out = (F.col(c) for c in ("overlay_start", "overlay_end", "fade_in", "fade_out"))

    def ramp(share: Column) -> Column:
        return F.col("opacity") * clamp(share, 0.0, 1.0)

    return (
        F.when((fade_in > 0) & (time < start + fade_in), ramp((time - start) / fade_in))
        .when((fade_out > 0) & (time > end - fade_out), ramp((end - time) / fade_out))
        .otherwise(F.col("opacity"))
    )


def fade_opacity(visible: DataFrame) -> DataFrame:
    """Add the opacity at both ends of the piece; the end is null where it does not change noticeably."""
    at_start, at_end = opacity_at(F.col("piece_start")), opacity_at(F.col("piece_end"))
    ramped = F.when(F.abs(at_start - at_end) > 0.001, at_end)
    return visible.withColumn("opacity_start", at_start).withColumn("opacity_end", ramped)


def _track_block(time: str) -> Column:
    return F.floor(F.col(time) / TRACK_BLOCK_SECONDS).cast("long")


def fill_keyframes(keyframes: DataFrame) -> DataFrame:
    """Tracks with two or more keyframes, every channel filled from the keyframe before; rotation in radians."""
    counted = keyframes.groupBy("track_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2)
    animated = keyframes.join(counted.select("track_id"), "track_id", "left_semi")
    order = "_order"
    ordered = animated.withColumn(order, F.struct("time", "keyframe_id"))
    filled = last_known(ordered, ["track_id"], order, {f"_{c}": F.col(c) for c in CHANNEL_DEFAULTS}, _track_block("time"))
    values = {c: F.coalesce(F.col(f"_{c}"), F.lit(d)) for c, d in CHANNEL_DEFAULTS.items()}
    radians = values.pop("rotation") * F.lit(3.141592653589793) / F.lit(180.0)
    return filled.select("track_id", "keyframe_id", "time", *[v.alias(c) for c, v in values.items()], radians.alias("rotation"))


def sample_keyframes(points: DataFrame, filled: DataFrame) -> DataFrame:
    """Channel values at arbitrary instants (track_id, time, …): linear between neighbours, held outside."""
    channels = list(CHANNEL_DEFAULTS)
    filled = cut_lineage(filled)
    known = points.join(filled.select("track_id").distinct(), "track_id", "left_semi")
    near = bracket(known, filled, ["track_id"], "time", channels, _track_block("time"), tie="keyframe_id")
    a, b = F.col("before"), F.col("after")
    span = b["time"] - a["time"]
    share = F.when(span > 0, (F.col("time") - a["time"]) / span).otherwise(F.lit(0.0))

    def value(channel: str) -> Column:
        between = lerp(a[channel], b[channel], share)
        return F.when(a.isNull(), b[channel]).when(b.isNull(), a[channel]).otherwise(between)

    return near.select(*points.columns, *[value(c).alias(c) for c in channels])


def cover_transform(scale: Column, pan_x: Column, pan_y: Column, size: tuple[Column, Column], out: tuple[int, int]) -> tuple[Column, ...]:
    """Scale and offsets that let a source of ``size`` cover the output, zoomed and panned."""
    width, height = size
    total = F.greatest(F.lit(float(out[0])) / width, F.lit(float(out[1])) / height) * scale

    def offset(length: Column, limit: int, pan: Column) -> Column:
        scaled = length * total
        room = F.greatest(F.lit(0.0), (scaled - float(limit)) / 2.0) + limit / 2.0
        return (F.lit(float(limit)) - scaled) / 2.0 + pan * room

    return total, offset(width, out[0], pan_x), offset(height, out[1], pan_y)


def segment_transforms(keyframes: DataFrame, out: tuple[int, int]) -> DataFrame:
    """Segment keyframes (spec_id, seg_index, time, scale, pan_x, pan_y, width, height) as matrix terms.

    Missing channels take the default, not the keyframe before.
    """
    default = {"scale": 1.0, "pan_x": 0.0, "pan_y": 0.0}
    scale, pan_x, pan_y = (F.coalesce(F.col(c), F.lit(d)) for c, d in default.items())
    a, tx, ty = cover_transform(scale, pan_x, pan_y, (F.col("width"), F.col("height")), out)
    return keyframes.select("spec_id", "seg_index", "time", a.alias("a"), tx.alias("tx"), ty.alias("ty"))


def segment_transform_at(points: DataFrame, transforms: DataFrame, block_seconds: float = SPLIT_BLOCK_SECONDS) -> DataFrame:
    """Matrix terms at instants (spec_id, seg_index, time), linear between a segment's keyframes, held outside."""
    keys = ["spec_id", "seg_index"]
    block = F.floor(F.col("time") / block_seconds).cast("long")
    near = bracket(points, transforms, keys, "time", ["a", "tx", "ty"], block)
    left, right = F.col("before"), F.col("after")
    span = right["time"] - left["time"]
    share = F.when(span > 0, (F.col("time") - left["time"]) / span).otherwise(F.lit(0.0))

    def value(term: str) -> Column:
        return F.coalesce(lerp(left[term], right[term], share), left[term], right[term]).alias(term)

    return near.filter(left.isNotNull() | right.isNotNull()).select(*keys, "time", value("a"), value("tx"), value("ty"))


def crop_to_ratio(width: Column, height: Column, ratio: Column) -> tuple[Column, Column]:
    """Largest even-sided crop of a frame with the given width / height ratio."""
    wide = width / height > ratio
    return (
        F.when(wide, even_floor(height * ratio)).otherwise(width),
        F.when(wide, height).otherwise(even_floor(width / ratio)),
    )
