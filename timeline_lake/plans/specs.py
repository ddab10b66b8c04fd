"""Render specifications: nested JSON documents read, flattened, checked and merged as tables.

A spec is one document in one row. What concerns a single document is worked out inside its row with array functions;
joins are used only where another table is asked (files, transcripts, presets, an override).
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeline_lake.functions.text import split_compound_id
from timeline_lake.session import cut_lineage

# The document's fields. Keys may be written in snake_case or camelCase.
SPEC_DDL = (
    "sources array<struct<id:string,path:string,transcript_id:string>>,"
    "segments array<struct<source_id:string,start:double,end:double,speed:double,"
    "transform:struct<scale:double,pan_x:double,pan_y:double>,keyframes:array<struct<time:double,scale:double,pan_x:double,pan_y:double>>,"
    "transition:struct<type:string,duration:double>,volume:double,audio_from_prev:boolean>>,"
    "captions struct<preset:string,transcript_id:string,font_family:string,font_size:double,font_weight:string,color:string,"
    "highlight_color:string,position:double,all_caps:boolean,shadow:boolean,words_per_group:int,punctuation:boolean>,"
    "audio struct<music_path:string,music_volume:double,normalize_audio:boolean,ducking_enabled:boolean,ducking_level:double>,"
    "quality struct<codec:string,bitrate:int,quality:double>,"
    "overlays array<struct<source_id:string,start:double,end:double,x:double,y:double,width:double,height:double,opacity:double,"
    "source_start:double,z_index:int,audio:double,corner_radius:double,crop:struct<x:double,y:double,width:double,height:double>,"
    "background_color:string,text:struct<title:string,body:string,title_color:string,body_color:string,title_font_size:double,"
    "body_font_size:double,title_font_weight:string,body_font_weight:string,font_family:string,alignment:string,padding:double>,"
    "image_path:string,fade_in:double,fade_out:double,keyframes:array<struct<time:double,scale:double,opacity:double,x:double,y:double,"
    "rotation:double>>,speed:double>>,"
    "aspect_ratio string, resolution string, fps double, lut struct<path:string,strength:double>, output_path string"
)
MERGED_PARTS = ("captions", "audio", "quality")
RESOLUTIONS = ("720p", "1080p", "4k")
# What these fields may say.
CHOICES = {
    "aspect_ratio": ("16:9", "9:16", "1:1", "4:5"),
    "quality.codec": ("h264", "hevc"),
}
TRANSITIONS = ("crossfade",)
HEX_COLOUR = "^#?([0-9a-fA-F]{6}|[0-9a-fA-F]{8})$"


@cache
def spec_schema() -> T.StructType:
    return T.StructType.fromDDL(SPEC_DDL)


def _camel(name: str) -> str:
    return re.sub("_([a-z])", lambda m: m.group(1).upper(), name)


def _both_spellings(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_both_spellings(kind.elementType))
    if not isinstance(kind, T.StructType):
        return kind
    fields = []
    for field in kind.fields:
        for name in dict.fromkeys((field.name, _camel(field.name))):
            fields.append(T.StructField(name, _both_spellings(field.dataType)))
    return T.StructType(fields)


def _settle(value: Column, kind: T.DataType) -> Column:
    """Bring a value read with both spellings to the snake_case schema."""
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _settle(v, kind.elementType)) if _nested(kind.elementType) else value
    if not isinstance(kind, T.StructType):
        return value
    fields = []
    for field in kind.fields:
        names = dict.fromkeys((field.name, _camel(field.name)))
        fields.append(_settle(F.coalesce(*[value[n] for n in names]), field.dataType).alias(field.name))
    return F.when(value.isNotNull(), F.struct(*fields))


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row. A plain projection would be merged into its consumers, and the
    document parsed again for every field they take; a one-element explode is a border the optimizer keeps."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def parse_specs(documents: DataFrame, text: str = "spec_json") -> DataFrame:
    """Add ``spec`` (typed) and ``problem``: null, or the first thing that keeps the document from being decoded.

    Checked in this order: the document is a JSON object; required fields, outside in; the values of enumerations; and
    that no other field has a value of the wrong type. A document is parsed once; only one that the parser could not read
    whole, or that seems to have another value where a text belongs, is looked at again.
    """
    kind = T.StructType([*_both_spellings(spec_schema()).fields, T.StructField("_corrupt_record", T.StringType())])
    value = F.from_json(text, kind, {"columnNameOfCorruptRecord": "_corrupt_record"})
    raw = _once(documents, "_raw", value)
    parsed = _once(raw, "spec", _settle(F.col("_raw"), spec_schema()))
    spoilt = F.col("_raw._corrupt_record").isNotNull()
    whole = F.col(text).rlike("^[ \\t\\r\\n]*\\{") & (~spoilt | F.try_parse_json(text).isNotNull())

    def absent(of: Column, *fields: str) -> Column:
        found = of.isNull()
        for f in fields:
            found = found | of[f].isNull()
        return found

    def lacks(array: str, *fields: str) -> Column:
        return F.exists(F.col(f"spec.{array}"), lambda e: absent(e, *fields))

    def part_lacks(array: str, part: str, *fields: str) -> Column:
        """A part that is there lacks a field it must have."""
        return F.exists(F.col(f"spec.{array}"), lambda e: e[part].isNotNull() & absent(e[part], *fields))

    def frame_lacks(array: str) -> Column:
        return F.exists(F.col(f"spec.{array}"), lambda e: F.coalesce(F.exists(e["keyframes"], lambda k: absent(k, "time")), F.lit(False)))

    resolution = F.col("spec.resolution")
    size = F.from_json(resolution, "width bigint, height bigint")
    sized = resolution.startswith("{") & size["width"].isNotNull() & size["height"].isNotNull()
    other = F.exists("spec.segments", lambda e: e["transition"].isNotNull() & ~e["transition"]["type"].isin(*TRANSITIONS))
    problem = (
        F.when(~F.coalesce(whole, F.lit(False)), F.lit("not a JSON object"))
        .when(F.col("spec.sources").isNull(), F.lit("sources"))
        .when(F.col("spec.segments").isNull(), F.lit("segments"))
        .when(F.col("spec.output_path").isNull(), F.lit("output_path"))
        .when(lacks("sources", "id", "path"), F.lit("sources.id, path"))
        .when(lacks("segments", "source_id", "start", "end"), F.lit("segments.source_id, start, end"))
        .when(lacks("overlays", "start", "end", "x", "y", "width", "height"), F.lit("overlays.start, end, x, y, width, height"))
        .when(part_lacks("segments", "transition", "type", "duration"), F.lit("segments.transition.type, duration"))
        .when(frame_lacks("segments"), F.lit("segments.keyframes.time"))
        .when(frame_lacks("overlays"), F.lit("overlays.keyframes.time"))
        .when(part_lacks("overlays", "crop", "x", "y", "width", "height"), F.lit("overlays.crop.x, y, width, height"))
        .when(F.col("spec.lut").isNotNull() & F.col("spec.lut.path").isNull(), F.lit("lut.path"))
        .when(other, F.lit("segments.transition.type"))
    )
    for name, allowed in CHOICES.items():
        problem = problem.when(~F.col(f"spec.{name}").isin(*allowed), F.lit(name))
    problem = problem.when(resolution.isNotNull() & ~resolution.isin(*RESOLUTIONS) & ~F.coalesce(sized, F.lit(False)), F.lit("resolution"))
    problem = problem.when(spoilt | (F.col(text).rlike(_unquoted()) & _no_text(text)), F.lit("a value of the wrong type"))
    return parsed.withColumn("problem", problem).drop("_raw")


def _text_names(kind: T.DataType) -> set[str]:
    """Names of the fields, in both spellings, that hold texts. None of them is the name of another kind of field."""
    if isinstance(kind, T.ArrayType):
        return _text_names(kind.elementType)
    if not isinstance(kind, T.StructType):
        return set()
    own = {n for f in kind.fields if isinstance(f.dataType, T.StringType) for n in (f.name, _camel(f.name))}
    return own.union(*(_text_names(f.dataType) for f in kind.fields))


@cache
def _unquoted() -> str:
    """Such a name with something after it that is neither a quote nor null; ``resolution`` may be an object."""
    by_letter: dict[str, list[str]] = {}
    for name in sorted(_text_names(spec_schema()) - {"resolution"}):
        by_letter.setdefault(name[0], []).append(name[1:])
    # One letter rules out most names at once.
    names = "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in by_letter.items())
    return f'"(?:{names})"\\s*+:\\s*+[^"n]|"resolution"\\s*+:\\s*+[^"n{{]'


def _as_variants(kind: T.DataType) -> T.DataType | None:
    """The part of a schema that holds texts, with variants in their place."""
    if isinstance(kind, T.StringType):
        return T.VariantType()
    if isinstance(kind, T.ArrayType):
        inner = _as_variants(kind.elementType)
        return T.ArrayType(inner) if inner else None
    if isinstance(kind, T.StructType):
        fields = [T.StructField(f.name, inner) for f in kind.fields if (inner := _as_variants(f.dataType))]
        return T.StructType(fields) if fields else None
    return None


def _no_text(text: str) -> Column:
    """Whether a value that should be a text is something else, which a parser told to read a text would turn into one."""

    def wrong(value: Column, kind: T.DataType, name: str = "") -> Column:
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.exists(value, lambda e: wrong(e, kind.elementType)), F.lit(False))
        if isinstance(kind, T.StructType):
            found = F.lit(False)
            for field in kind.fields:
                found = found | wrong(value[field.name], field.dataType, field.name)
            return found
        shape = F.schema_of_variant(value)
        return ~F.coalesce(shape.isin("STRING", "VOID") | (F.lit(name == "resolution") & shape.startswith("OBJECT")), F.lit(True))

    kind = _as_variants(_both_spellings(spec_schema()))
    return wrong(F.from_json(text, kind), kind)


def good_specs(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("problem").isNull()).drop("problem")


def resolution_size(resolution: Column) -> Column:
    """Struct (preset, width, height): a preset name or an explicit {width, height}."""
    size = F.from_json(resolution, "width bigint, height bigint")
    return F.struct(
        F.when(resolution.isin(*RESOLUTIONS), resolution).alias("preset"),
        F.when(resolution.startswith("{"), size["width"]).alias("width"),
        F.when(resolution.startswith("{"), size["height"]).alias("height"),
    )


def explode_part(specs: DataFrame, part: str, keys: list[str]) -> DataFrame:
    """Rows of one list of the document (sources, segments, overlays) with their position."""
    rows = specs.select(*keys, F.posexplode(f"spec.{part}").alias("position", "_e"))
    return rows.select(*keys, F.col("position").cast("long").alias("position"), "_e.*")


def explode_keyframes(specs: DataFrame, part: str, keys: list[str]) -> DataFrame:
    """Keyframes of a document's segments or overlays, with both positions."""
    rows = explode_part(specs, part, keys).select(*keys, F.col("position").alias("element"), F.posexplode("keyframes").alias("position", "_k"))
    return rows.select(*keys, "element", F.col("position").cast("long").alias("position"), "_k.*")


def overlay_kind(overlay: Column) -> Column:
    return (
        F.when(overlay["source_id"].isNotNull(), F.lit("video"))
        .when(overlay["image_path"].isNotNull(), F.lit("image"))
        .when(overlay["text"].isNotNull(), F.lit("text"))
        .otherwise(F.lit("color"))
    )


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


# The texts of issues, here and in the functions below.
def _segment_issues(spec: Column) -> Column:
    ids = F.transform(spec["sources"], lambda s: s["id"])

    def of(segment: Column, i: Column) -> Column:
        start, end, speed, transition = segment["start"], segment["end"], segment["speed"], segment["transition"]
        length = transition["duration"]
        return F.array_compact(
            F.array(
                F.when(~F.array_contains(ids, segment["source_id"]), _say("Segment ", i, ": references unknown source '", segment["source_id"], "'")),
                F.when(end <= start, _say("Segment ", i, ": end (", end, "s) must be after start (", start, "s)")),
                F.when((speed < 0.25) | (speed > 4.0), _say("Segment ", i, ": speed ", speed, "x out of range (0.25-4.0)")),
                F.when(length <= 0, _say("Segment ", i, ": transition duration must be positive")),
                F.when(length > (end - start) / 2, _say("Segment ", i, ": transition duration (", length, "s) exceeds half segment duration")),
            )
        )

    return F.flatten(F.transform(spec["segments"], of))


def _overlay_issues(spec: Column) -> Column:
    ids = F.transform(spec["sources"], lambda s: s["id"])
    total = F.aggregate(
        spec["segments"], F.lit(0.0), lambda a, s: a + (s["end"] - s["start"]) / F.coalesce(s["speed"], F.lit(1.0))
    )

    def of(o: Column, i: Column) -> Column:
        kind, colour, speed = overlay_kind(o), o["background_color"], o["speed"]
        empty = lambda c: F.coalesce(c, F.lit("")) == ""

        def outside(c: Column) -> Column:
            return (c < 0) | (c > 1)

        def no_size(c: Column) -> Column:
            return (c <= 0) | (c > 1)

        return F.array_compact(
            F.array(
                F.when((kind == "video") & ~F.array_contains(ids, o["source_id"]), _say("Overlay ", i, ": references unknown source '", o["source_id"], "'")),
                F.when((kind == "color") & ~F.trim(colour).rlike(HEX_COLOUR), _say("Overlay ", i, ": invalid backgroundColor '", colour, "'")),
                F.when((kind == "color") & colour.isNull(), _say("Overlay ", i, ": color overlay requires backgroundColor")),
                F.when((kind == "image") & (o["image_path"] == ""), _say("Overlay ", i, ": image overlay requires imagePath")),
                F.when((kind == "text") & empty(o["text"]["title"]) & empty(o["text"]["body"]), _say("Overlay ", i, ": text overlay requires at least title or body")),
                F.when(o["end"] <= o["start"], _say("Overlay ", i, ": end must be after start")),
                F.when(
                    o["end"] > total + 0.1,
                    _say("Overlay ", i, ": end (", o["end"], "s) exceeds composition duration (~", F.round(total * 100) / F.lit(100.0), "s)"),
                ),
                F.when(outside(o["x"]) | outside(o["y"]), _say("Overlay ", i, ": x/y out of range [0, 1]")),
                F.when(no_size(o["width"]) | no_size(o["height"]), _say("Overlay ", i, ": width/height out of range (0, 1]")),
                F.when(
                    speed.isNotNull() & (kind != "video"),
                    _say("Warning: overlay ", i, " has speed=", speed, " but is not a video overlay — speed only applies to video overlays"),
                ),
                F.when((speed < 0.25) | (speed > 4.0), _say("Overlay ", i, ": speed ", speed, "x out of range (0.25-4.0)")),
            )
        )

    return F.flatten(F.transform(F.coalesce(spec["overlays"], F.expr("array()").cast(spec_schema()["overlays"].dataType)), of))


def _document_issues(spec: Column) -> Column:
    ids = F.transform(spec["sources"], lambda s: s["id"])
    repeated = F.filter(
        F.transform(ids, lambda v, i: F.when(F.array_contains(F.slice(ids, F.lit(1), i), v), _say("Duplicate source ID: ", v))), lambda m: m.isNotNull()
    )
    used = F.transform(spec["segments"], lambda s: s["source_id"])
    any_transcript = F.exists(spec["sources"], lambda s: s["transcript_id"].isNotNull())
    captions = spec["captions"]
    uncaptioned = F.filter(
        F.transform(
            spec["sources"],
            lambda s: F.when(
                any_transcript & captions.isNotNull() & s["transcript_id"].isNull() & F.array_contains(used, s["id"]),
                _say("Warning: source '", s["id"], "' has no transcriptId — segments from this source won't have captions"),
            ),
        ),
        lambda m: m.isNotNull(),
    )
    single = F.array_compact(
        F.array(
            F.when(F.size(spec["segments"]) == 0, F.lit("No segments defined — nothing to render.")),
            F.when(captions.isNotNull() & ~any_transcript & captions["transcript_id"].isNull(), F.lit("Captions requested but no transcriptId specified")),
        )
    )
    return F.concat(single, repeated, uncaptioned)


def validate_specs(specs: DataFrame, keys: list[str], media: DataFrame, transcripts: DataFrame, files: DataFrame, folders: DataFrame) -> DataFrame:
    """One row per issue of each spec: (keys, issue). A spec without rows is valid; warnings count as issues.

    ``media``: path, duration. ``transcripts``: project_slug, source_slug. ``files``: path (images, music).
    ``folders``: folder (writable output folders). ``specs`` also carries default_project for bare transcript ids.
    """
    spec = F.col("spec")
    nothing = F.lit(None).cast("string")

    def ask(kind: str | None, key: Column, issue: Column, segment: Column | None = None, entry: Column | None = None, place: Column | None = None) -> Column:
        """What to look up; without a kind, an issue that needs no looking up. ``segment``: its number and ends."""
        ends = [segment[c] if segment is not None else F.lit(None).cast("double") for c in ("start", "end")]
        numbers = [F.lit(None).cast("int") if n is None else n.cast("int") for n in (place, entry)]
        return F.struct(
            F.lit(kind).cast("string").alias("kind"), key.alias("key"), issue.alias("issue"), numbers[0].alias("place"), ends[0].alias("start"), ends[1].alias("end"),
            numbers[1].alias("entry"),
        )

    known = F.transform(_document_issues(spec), lambda m: ask(None, nothing, m))
    known = F.concat(known, *[F.transform(issues, lambda m: ask(None, nothing, m)) for issues in (_segment_issues(spec), _overlay_issues(spec))])
    sources = F.transform(spec["sources"], lambda s: ask("media", s["path"], _say("Source file not found: ", s["path"])))
    entries = F.transform(spec["sources"], lambda s, i: F.struct(s["id"].alias("id"), s["path"].alias("path"), i.alias("entry")))

    def lengths(segment: Column, i: Column) -> Column:
        return F.transform(F.filter(entries, lambda e: e["id"] == segment["source_id"]), lambda e: ask("media", e["path"], nothing, segment, e["entry"], i))

    segments = F.flatten(F.transform(spec["segments"], lengths))

    def transcript(name: Column, issue: Column) -> Column:
        parts = split_compound_id(name)
        return ask("transcript", _two(F.coalesce(parts["project"], F.col("default_project")), F.coalesce(parts["source"], name)), issue)

    own = F.filter(spec["sources"], lambda s: s["transcript_id"].isNotNull())
    single = spec["captions"]["transcript_id"]
    spoken = F.transform(own, lambda s: transcript(s["transcript_id"], _say("Source '", s["id"], "': transcript '", s["transcript_id"], "' not found")))
    images = F.filter(
        F.transform(spec["overlays"], lambda o, i: F.when(
            o["source_id"].isNull() & (o["image_path"] != ""),
            ask("file", o["image_path"], _say("Overlay ", i, ": image file not found or not readable: ", o["image_path"])),
        )),
        lambda a: a.isNotNull(),
    )
    music, target = spec["audio"]["music_path"], F.regexp_extract(spec["output_path"], "^(.*)/[^/]*$", 1)
    others = F.array_compact(
        F.array(
            F.when((F.size(own) == 0) & single.isNotNull(), transcript(single, _say("Caption transcript not found: ", single))),
            F.when(music.isNotNull(), ask("file", music, _say("Music file not found: ", music))),
            ask("folder", target, _say("Output directory does not exist: ", target)),
        )
    )
    every = F.concat(known, sources, segments, spoken, F.coalesce(images, F.slice(others, 1, 0)), others)
    asked = cut_lineage(specs.select(*keys, F.inline(every)))
    # All that is asked of other tables in one list: kind and key.
    there = (
        media.select(F.lit("media").alias("kind"), F.col("path").alias("key"), F.col("duration").cast("double").alias("duration"))
        .unionByName(transcripts.select(F.lit("transcript").alias("kind"), _two(F.col("project_slug"), F.col("source_slug")).alias("key")), allowMissingColumns=True)
        .unionByName(files.select(F.lit("file").alias("kind"), F.col("path").alias("key")), allowMissingColumns=True)
        .unionByName(folders.select(F.lit("folder").alias("kind"), F.col("folder").alias("key")), allowMissingColumns=True)
        .groupBy("kind", "key").agg(F.max("duration").alias("duration"))
        .filter("kind <> 'media' or duration is not null").withColumn("_there", F.lit(True))
    )
    answered = asked.filter("kind is not null").join(there, ["kind", "key"], "left")
    missing = answered.filter("issue is not null and _there is null").select(*keys, "issue")
    # A source id used twice stands for its last entry that could be read.
    timed = answered.filter("issue is null and _there").groupBy(*keys, "place", "start", "end").agg(F.max_by("duration", "entry").alias("duration"))
    i, start, end, duration = (F.col(c) for c in ("place", "start", "end", "duration"))
    beyond = timed.select(
        *keys,
        F.explode(
            F.array_compact(
                F.array(
                    F.when(start < 0, _say("Segment ", i, ": start (", start, "s) is negative")),
                    F.when(end > duration + 0.1, _say("Segment ", i, ": end (", end, "s) exceeds source duration (", duration, "s)")),
                )
            )
        ).alias("issue"),
    )
    return asked.filter("kind is null").select(*keys, "issue").unionByName(missing).unionByName(beyond)


def _two(project: Column, source: Column) -> Column:
    """A compound key as one text; null if one part is."""
    return F.concat(project, F.lit("\u0000"), source)


def _merge_struct(base: Column, override: Column, kind: T.StructType) -> Column:
    fields = [F.coalesce(override[f.name], base[f.name]).alias(f.name) for f in kind.fields]
    return F.when(override.isNull(), base).when(base.isNull(), override).otherwise(F.struct(*fields))


def merge_specs(base: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Apply partial specs: lists and single values are replaced, captions, audio and quality merged field by field."""
    # Parsed specs are many times as large as the table they come from, by which Spark would choose to broadcast them.
    joined = base.select(*keys, F.col("spec").alias("_b")).join(overrides.select(*keys, F.col("spec").alias("_o")).hint("merge"), keys, "left")
    old, new = F.col("_b"), F.col("_o")
    fields = []
    for field in spec_schema().fields:
        if field.name in MERGED_PARTS:
            value = _merge_struct(old[field.name], new[field.name], field.dataType)
        else:
            value = F.coalesce(new[field.name], old[field.name])
        fields.append(value.alias(field.name))
    return joined.select(*keys, F.struct(*fields).alias("spec"))


def resolve_presets(specs: DataFrame, presets: DataFrame, keys: list[str]) -> DataFrame:
    """Caption settings with the named preset's values under the explicit ones; ``problem`` for an unknown preset."""
    kind = spec_schema()["captions"].dataType
    read = _once(presets, "_raw", F.from_json("config_json", _both_spellings(kind)))
    styles = read.select(F.col("name").alias("_preset"), _settle(F.col("_raw"), kind).alias("_style"))
    asked = specs.withColumn("_preset", F.col("spec.captions.preset"))
    joined = asked.join(styles, "_preset", "left")
    own = F.col("spec.captions")
    settled = F.when(F.col("_preset").isNull(), own).otherwise(_merge_struct(F.col("_style"), own, kind))
    unknown = F.col("_preset").isNotNull() & F.col("_style").isNull()
    return joined.select(
        *keys, F.when(~unknown, settled).alias("captions"), F.when(unknown, _say("preset '", F.col("_preset"), "' not found")).alias("problem")
    )


def rerender_path(path: Column) -> Column:
    """`dir/stem_rerender.ext` for `dir/stem.ext`."""
    return F.regexp_replace(path, "^(.*/)?([^/]*?)(\\.([^./]*))?$", "$1$2_rerender.$4")


def source_edges(renders: DataFrame) -> DataFrame:
    """Render → source edges from the stored list of sources."""
    return renders.select("project_slug", "slug", F.explode(F.from_json("sources_json", "array<string>")).alias("source_slug"))


def source_use(edges: DataFrame) -> DataFrame:
    """In how many renders, and how often, each source is used."""
    return edges.groupBy("source_slug").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("project_slug", "slug").alias("renders"))
