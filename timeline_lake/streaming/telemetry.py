"""Render telemetry as a stream: facts without repeats, rejects set aside, counts per time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeline_lake.plans.telemetry import PAYLOAD, render_facts
from timeline_lake.streaming.runs import json_stream


def payload_lines(spark: SparkSession, folder: str, files_per_batch: int = 1000, archive: str | None = None) -> DataFrame:
    """Payloads, one JSON object per line, from files as they arrive: ``payload``, and ``json`` as the line if it is broken.

    At most ``files_per_batch`` files make a micro-batch; with ``archive`` finished files are moved there, so that the
    folder that is listed stays small.
    """
    lines = json_stream(spark, folder, PAYLOAD, files_per_batch, archive)
    fields = [c.split(" ")[0] for c in PAYLOAD.split(", ")]
    broken = F.col("_corrupt_record")
    return lines.select(F.when(broken.isNull(), F.struct(*fields)).alias("payload"), broken.alias("json"))


def unique_facts(payloads: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Good payloads, one per render id; a repeat is recognised while it is no later than ``delay``."""
    good = render_facts(payloads).filter(~F.col("bad")).drop("bad", "json")
    return good.withWatermark("finished_at", delay).dropDuplicatesWithinWatermark(["render_id"])


def rejects(payloads: DataFrame) -> DataFrame:
    """Payloads that are no facts: why, the broken line or the payload that lacks an id or a time."""
    reason = F.when(F.col("json").isNotNull() & F.col("project").isNull(), F.lit("broken line")).otherwise(F.lit("no id or time"))
    return render_facts(payloads).filter("bad").select(reason.alias("reason"), F.coalesce("json", F.to_json(F.struct("project", "slug", "codec", "fps"))).alias("json"))


def windowed_counts(facts: DataFrame, length: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Renders, seconds and mean rate per window, project and codec; emitted once the watermark has passed the window."""
    span = F.window("finished_at", length, slide) if slide else F.window("finished_at", length)
    return (
        facts.withWatermark("finished_at", delay)
        .groupBy(span.alias("window"), "project", "codec")
        .agg(F.count(F.lit(1)).alias("renders"), F.sum("output_duration_seconds").alias("seconds"), F.avg("fps").alias("mean_fps"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "project", "codec", "renders", "seconds", "mean_fps")
    )
