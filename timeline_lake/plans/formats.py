"""Frame sizes, aspect previews, encoder settings and screen layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeline_lake.functions.numbers import even_floor
from timeline_lake.operators.blocks import row_numbers
from timeline_lake.plans.overlays import crop_to_ratio

# Aspect ratios, labels, resolution presets, frame-rate fractions and bitrates.
TARGET_RATIOS = [("16:9", 16.0 / 9.0), ("9:16", 9.0 / 16.0), ("1:1", 1.0), ("4:5", 4.0 / 5.0)]
KNOWN_RATIOS = [*TARGET_RATIOS, ("4:3", 4.0 / 3.0), ("3:4", 3.0 / 4.0), ("21:9", 21.0 / 9.0)]
SHORT_SIDES = {"720p": 720.0, "1080p": 1080.0, "4k": 2160.0}
NTSC_RATES = [(23.976, 24000), (29.97, 30000), (59.94, 60000)]
BITRATES = {
    "hevc": (50_000_000, 18_000_000, 6_000_000),
    "h264": (45_000_000, 10_000_000, 4_000_000),
}

# Fixed values: (aspect family, layout, background?, screen box, speaker box); a box is x, y, width, height, radius.
FULL = (0.0, 0.0, 1.0, 1.0, 0.0)
LAYOUTS = [
    ("landscape", "pip_small", False, FULL, (0.02, 0.72, 0.22, 0.25, 0.15)),
    ("landscape", "pip_medium", False, FULL, (0.02, 0.55, 0.35, 0.40, 0.12)),
    ("landscape", "split", True, (0.38, 0.04, 0.58, 0.92, 0.04), (0.04, 0.15, 0.30, 0.70, 0.08)),
    ("landscape", "speaker_focus", True, (0.58, 0.55, 0.38, 0.40, 0.04), (0.10, 0.08, 0.55, 0.84, 0.06)),
    ("landscape", "screen_only", False, FULL, None),
    ("landscape", "speaker_only", False, None, FULL),
    ("portrait", "pip_small", False, FULL, (0.30, 0.78, 0.40, 0.18, 0.15)),
    ("portrait", "pip_medium", False, FULL, (0.20, 0.65, 0.60, 0.30, 0.12)),
    ("portrait", "split", True, (0.04, 0.02, 0.92, 0.52, 0.04), (0.10, 0.58, 0.80, 0.38, 0.06)),
    ("portrait", "speaker_focus", True, (0.15, 0.60, 0.70, 0.35, 0.04), (0.05, 0.04, 0.90, 0.52, 0.04)),
    ("portrait", "screen_only", False, FULL, None),
    ("portrait", "speaker_only", False, None, FULL),
    ("square", "pip_small", False, FULL, (0.02, 0.72, 0.26, 0.26, 0.15)),
    ("square", "pip_medium", False, FULL, (0.02, 0.55, 0.40, 0.40, 0.12)),
    ("square", "split", True, (0.38, 0.04, 0.58, 0.92, 0.04), (0.04, 0.15, 0.30, 0.70, 0.08)),
    ("square", "speaker_focus", True, (0.58, 0.55, 0.38, 0.40, 0.04), (0.10, 0.08, 0.55, 0.84, 0.06)),
    ("square", "screen_only", False, FULL, None),
    ("square", "speaker_only", False, None, FULL),
]
LAYOUT_STYLE = {"radius": 0.15, "background": "#1a1a2e", "transition": 0.4}


def scale_to(width: Column, height: Column, resolution: Column) -> tuple[Column, Column]:
    """Scale so that the short side meets the preset; no preset keeps the size."""
    short = F.lit(None).cast("double")
    for name, side in SHORT_SIDES.items():
        short = F.when(resolution == name, F.lit(side)).otherwise(short)
    factor = short / F.least(width, height)

    def scaled(side: Column) -> Column:
        return F.when(factor.isNull(), side).otherwise(even_floor(side * factor))

    return scaled(width), scaled(height)


def render_sizes(requests: DataFrame) -> DataFrame:
    """Output size from source width and height, aspect_ratio and resolution (each may be null).

    A crop keeps the source's own pixels; a custom resolution (custom_width, custom_height) overrides everything.
    """
    ratio = F.lit(None).cast("double")
    for name, value in TARGET_RATIOS:
        ratio = F.when(F.col("aspect_ratio") == name, F.lit(value)).otherwise(ratio)
    width, height = F.col("width").cast("double"), F.col("height").cast("double")
    cropped = crop_to_ratio(width, height, ratio)
    base_w = F.when(ratio.isNull(), width).otherwise(cropped[0])
    base_h = F.when(ratio.isNull(), height).otherwise(cropped[1])
    scaled = scale_to(base_w, base_h, F.col("resolution"))
    return requests.withColumn("render_width", F.coalesce("custom_width", scaled[0].cast("long"))).withColumn(
        "render_height", F.coalesce("custom_height", scaled[1].cast("long"))
    )


def ratio_label(ratio: Column) -> Column:
    """Name of a known aspect ratio, else two decimals."""
    label = F.format_string("%.2f:1", ratio)
    for name, value in reversed(KNOWN_RATIOS):
        label = F.when(F.abs(ratio - value) < 0.01, F.lit(name)).otherwise(label)
    return label


def aspect_preview(assets: DataFrame) -> DataFrame:
    """Four rows per asset: size after cropping to each target ratio and what the crop costs."""
    targets = F.array(*[F.struct(F.lit(n).alias("aspect_ratio"), F.lit(r).alias("ratio")) for n, r in TARGET_RATIOS])
    width, height = F.col("width").cast("double"), F.col("height").cast("double")
    laid = assets.select("project_slug", "slug", width.alias("_w"), height.alias("_h"), F.explode(targets).alias("_t"))
    source, ratio = F.col("_w") / F.col("_h"), F.col("_t.ratio")
    out_w, out_h = crop_to_ratio(F.col("_w"), F.col("_h"), ratio)

    def lost(part: Column, whole: str) -> Column:
        return F.round((1.0 - part / F.col(whole)) * 100).cast("long")

    note = (
        F.when(F.abs(source - ratio) < 0.01, F.lit("matches source — no crop"))
        .when(source > ratio, F.concat(F.lit("crops "), lost(out_w, "_w"), F.lit("% from sides")))
        .otherwise(F.concat(F.lit("crops "), lost(out_h, "_h"), F.lit("% from top/bottom")))
    )
    return laid.select(
        "project_slug", "slug", ratio_label(source).alias("source_ratio"), F.col("_t.aspect_ratio").alias("aspect_ratio"),
        out_w.cast("long").alias("out_width"), out_h.cast("long").alias("out_height"), note.alias("note"),
    )


def encode_params(assets: DataFrame) -> DataFrame:
    """Frame duration as a fraction and the default bitrate for codec and frame size."""
    fps = F.col("fps")
    whole = F.round(fps)
    value = F.when((F.abs(fps - whole) < 0.01) & (whole > 0), F.lit(1)).otherwise(F.round(F.lit(600.0) / fps))
    scale = F.when((F.abs(fps - whole) < 0.01) & (whole > 0), whole).otherwise(F.lit(600.0))
    for rate, timescale in reversed(NTSC_RATES):
        near = F.abs(fps - rate) < 0.05
        value = F.when(near, F.lit(1001)).otherwise(value)
        scale = F.when(near, F.lit(timescale)).otherwise(scale)
    long_side, short_side = F.greatest("width", "height"), F.least("width", "height")
    huge = (long_side >= 3840) | (short_side >= 2160)
    full = (long_side >= 1920) | (short_side >= 1080)
    bitrate = F.lit(None).cast("long")
    for codec, (top, middle, low) in BITRATES.items():
        tier = F.when(huge, F.lit(top)).when(full, F.lit(middle)).otherwise(F.lit(low)).cast("long")
        bitrate = F.when(F.col("codec") == codec, tier).otherwise(bitrate)
    return assets.select(
        "project_slug", "slug", value.cast("long").alias("frame_value"), scale.cast("long").alias("frame_timescale"), bitrate.alias("bitrate")
    )


def layout_table(spark: SparkSession) -> DataFrame:
    """The 18 layout presets as rows."""
    box = "struct<x:double,y:double,width:double,height:double,radius:double>"
    return spark.createDataFrame(LAYOUTS, f"family string, layout string, background boolean, screen {box}, speaker {box}")


def aspect_family(ratio: Column) -> Column:
    return F.when(ratio == "9:16", F.lit("portrait")).when(ratio.isin("1:1", "4:5"), F.lit("square")).otherwise(F.lit("landscape"))


def layout_problems(sections: DataFrame) -> DataFrame:
    """Sections with an unknown layout, a missing time, or an end at or before the start."""
    names = sorted({name for _, name, *_ in LAYOUTS})
    problem = (
        F.when(F.col("layout").isNull(), F.lit("missing layout"))
        .when(~F.col("layout").isin(names), F.concat(F.lit("unknown layout "), "layout"))
        .when(F.col("start").isNull(), F.lit("missing start"))
        .when(F.col("end").isNull(), F.lit("missing end"))
        .when(F.col("end") <= F.col("start"), F.lit("end must be after start"))
    )
    return sections.withColumn("problem", problem)


def _sound_timelines(sections: DataFrame, keys: list[str]) -> DataFrame:
    """Sections of the timelines that have no section with a problem."""
    judged = layout_problems(sections)
    broken = judged.filter(F.col("problem").isNotNull()).select(*keys).distinct()
    return judged.join(broken, keys, "left_anti").drop("problem")


STYLE = "struct<corner_radius:double,background:string,transition_duration:double,speaker_crop:struct<x:double,y:double,width:double,height:double>>"


def layout_overlays(sections: DataFrame, keys: list[str], block: Column) -> DataFrame:
    """Named layout sections (keys, section_id, layout, start, end, aspect_ratio, screen, speaker) as one to three overlays.

    A timeline is laid out only if all its sections are sound. Sections are ordered by start; the first does not fade in
    and the last does not fade out. Screen and speaker run along with the timeline (``source_start``) and are silent. A
    ``style`` column (see ``STYLE``) replaces defaults where it says something: the radius of speakers whose layout has none,
    the background, the fades (none of 0 s) and the part of the speaker's picture that is shown. ``block`` cuts a timeline by
    start time, so that none has to fit in one task.
    """
    styled = sections if "style" in sections.columns else sections.withColumn("style", F.lit(None).cast(STYLE))
    said = F.col("style.speaker_crop")
    whole = {"x": F.lit(0.0), "y": F.lit(0.0), "width": F.lit(1.0), "height": F.lit(1.0)}
    styled = styled.withColumns(
        {
            "_radius": F.coalesce("style.corner_radius", F.lit(LAYOUT_STYLE["radius"])),
            "_colour": F.coalesce("style.background", F.lit(LAYOUT_STYLE["background"])),
            "_fade": F.coalesce("style.transition_duration", F.lit(LAYOUT_STYLE["transition"])),
            # A crop that says only some of its sides keeps the picture's own others.
            **{f"_crop_{c}": F.when(said.isNotNull(), F.coalesce(said[c], v)) for c, v in whole.items()},
        }
    ).drop("style")
    sound = _sound_timelines(styled, keys)
    placed = row_numbers(sound, keys, ["start", "section_id"], block, "position")
    counts = sound.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    presets = layout_table(sections.sparkSession)
    presets = presets.select("family", "layout", "background", F.col("screen").alias("_screen"), F.col("speaker").alias("_speaker"))
    laid = placed.withColumn("family", aspect_family(F.col("aspect_ratio"))).join(F.broadcast(presets), ["family", "layout"]).join(counts, keys)
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def positive(value: Column) -> Column:
        return F.when(value > 0, value)

    def box_of(name: str) -> dict[str, Column]:
        return {c: F.col(f"{name}.{c}") for c in ("x", "y", "width", "height")}

    def overlay(show: Column, layer: int, source: Column, colour: Column, box: dict[str, Column], radius: Column, crop: dict[str, Column] | None = None) -> Column:
        runs = source.isNotNull()
        row = F.struct(
            F.lit(layer).cast("long").alias("z_index"),
            source.alias("source_id"),
            F.when(runs, F.col("start")).alias("source_start"),
            F.when(runs, F.lit(0.0)).alias("audio"),
            colour.alias("background_color"),
            *[box[c].alias(c) for c in ("x", "y", "width", "height")],
            positive(radius).alias("corner_radius"),
            *[(crop[c] if crop else number).alias(f"crop_{c}") for c in ("x", "y", "width", "height")],
        )
        return F.when(show, row)

    shown = {c: F.col(f"_crop_{c}") for c in whole}
    radius, colour = F.col("_radius"), F.col("_colour")
    rows = F.array_compact(
        F.array(
            overlay(F.col("background"), 0, text, colour, whole, number),
            overlay(F.col("_screen").isNotNull(), 1, F.col("screen"), text, box_of("_screen"), F.col("_screen.radius")),
            overlay(F.col("_speaker").isNotNull(), 2, F.col("speaker"), text, box_of("_speaker"), F.coalesce(positive(F.col("_speaker.radius")), radius), shown),
        )
    )
    fade = positive(F.col("_fade"))
    return laid.select(
        *keys,
        "position",
        "start",
        "end",
        F.when(F.col("position") > 0, fade).alias("fade_in"),
        F.when(F.col("position") < F.col("_n") - 1, fade).alias("fade_out"),
        F.inline(rows),
    )


def layout_summary(sections: DataFrame, keys: list[str]) -> DataFrame:
    """Section count, the distinct layouts in order, and total seconds, of timelines without a bad section.

    At most six layout names exist.
    """
    return _sound_timelines(sections, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sections"),
        F.array_join(F.array_sort(F.collect_set("layout")), ", ").alias("layouts"),
        F.sum(F.col("end") - F.col("start")).alias("seconds"),
    )
