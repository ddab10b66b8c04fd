"""Declared schemas of the warehouse tables and readers for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "projects": "slug string, name string, status string, description string, tags_json string, created timestamp, updated timestamp",
    "assets": "project_slug string, slug string, filename string, file_path string, file_size_bytes bigint, duration_seconds double, "
    "width int, height int, fps double, codec string, has_audio int, tags_json string, created timestamp",
    "transcripts": "project_slug string, source_slug string, source_path string, duration_seconds double, word_count int, language string, "
    "mode string, full_text string, created timestamp",
    "transcript_words": "project_slug string, source_slug string, word_index bigint, word string, start_time double, end_time double, confidence double",
    "analyses": "project_slug string, source_slug string, source_path string, status string, sample_fps double, frame_count int, scene_count int, "
    "duration_seconds double, frames_dir string, created timestamp",
    "scenes": "project_slug string, source_slug string, scene_index bigint, start_time double, end_time double, description string, "
    "tags_json string, scene_type string",
    "renders": "project_slug string, slug string, status string, duration_seconds double, output_path string, file_size_bytes bigint, "
    "sources_json string, spec_json string, notes_md string, created timestamp",
    "presets": "name string, type string, description string, config_json string, created timestamp, updated timestamp",
}
LISTS = {"tags_json": "tags", "sources_json": "sources"}


def column_type(table: str, column: str) -> str:
    return dict(c.split() for c in SCHEMAS[table].split(", "))[column]


def decode(raw: DataFrame) -> DataFrame:
    """JSON list columns as arrays (null when malformed), 0/1 flags as booleans (missing counts as true)."""
    out = raw
    for column, name in LISTS.items():
        if column in raw.columns:
            out = out.withColumn(name, F.from_json(column, "array<string>")).drop(column)
    if "has_audio" in raw.columns:
        out = out.withColumn("has_audio", F.coalesce(F.col("has_audio") != 0, F.lit(True)))
    return out


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A warehouse table from parquet, without schema inference."""
    return decode(spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}"))


def write_table(df: DataFrame, folder: str, name: str, files_by: list[str]) -> None:
    """Write a table version, range-partitioned and sorted by its leading keys so that lookups skip row groups."""
    df.repartitionByRange(*files_by).sortWithinPartitions(*files_by).write.mode("error").parquet(f"{folder}/{name}")


def sample_instants(assets: DataFrame, sample_fps: float) -> DataFrame:
    """The instants 0, 1/fps, … before the end at which frames are taken, with index and time to 0.1 s."""
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("duration_seconds") * sample_fps).cast("int"), F.lit(1)) - 1)
    laid = assets.select("project_slug", "slug", "duration_seconds", F.explode(steps).alias("_i"))
    at = F.col("_i") / F.lit(sample_fps)
    return laid.filter(at < F.col("duration_seconds")).select(
        "project_slug", "slug", F.col("_i").cast("long").alias("frame_index"), (F.round(at * 10) / F.lit(10.0)).alias("time"),
        F.format_string("frame_%04d.jpg", "_i").alias("filename"),
    )


def speech_chunks(assets: DataFrame, chunk: float = 55.0, overlap: float = 5.0, least: float = 2.0) -> DataFrame:
    """Overlapping chunks of long audio: a last chunk shorter than ``least`` is left out unless it is the only one."""
    step = chunk - overlap
    duration = F.col("duration_seconds")
    count = F.when(duration <= chunk, F.lit(1)).otherwise(F.ceil(duration / step).cast("int"))
    laid = assets.filter(duration > 0).select("project_slug", "slug", "duration_seconds", F.explode(F.sequence(F.lit(0), count - 1)).alias("_i"))
    offset = F.col("_i") * F.lit(step)
    kept = laid.filter((F.col("_i") == 0) | (duration - offset >= least))
    return kept.select("project_slug", "slug", F.col("_i").cast("long").alias("chunk_index"), offset.alias("offset"), F.least(F.lit(chunk), duration - offset).alias("length"))
