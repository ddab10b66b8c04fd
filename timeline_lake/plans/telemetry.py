"""Render telemetry and metered usage in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeline_lake.operators.blocks import running_sums
from timeline_lake.session import cut_lineage

FREE_MINUTES = 90.0  # fixed value
PAYLOAD = (
    "render_id string, project string, slug string, status string, finished_at string, timing map<string,double>, "
    "output_duration_seconds double, file_size_bytes bigint, resolution string, codec string, fps double, source_count bigint, "
    "segment_count bigint, captions_applied boolean"
)
DURATION_BINS = 4.0  # blocks per second of frame time when ranking frames


def phase_profile(records: DataFrame) -> DataFrame:
    """Seconds per phase of a render (its last record counts), and its share of the render's wall time in whole percent.

    ``records``: render_id, seq, phase, seconds. Wall time is the sum of all records.
    """
    wall = records.groupBy("render_id").agg(F.sum("seconds").alias("wall_seconds"))
    last = records.groupBy("render_id", "phase").agg(F.max_by("seconds", "seq").alias("seconds"))
    share = F.when(F.col("wall_seconds") > 0, F.floor(F.col("seconds") / F.col("wall_seconds") * 100)).otherwise(F.lit(0))
    return last.join(wall, "render_id").select("render_id", "phase", "seconds", share.cast("long").alias("percent"))


def frame_stats(frames: DataFrame) -> DataFrame:
    """Per render: frame count, mean, upper median, p95, min, max, wall time and effective rate.

    The ranks are exact. Equal frame times are counted first and ranks found on running counts per range of times, so a
    render with very many frames is neither sorted nor collected in one task.
    """
    keys = ["render_id"]
    counts = frames.groupBy(*keys, "elapsed").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sums(counts, keys, "elapsed", {"_before": F.col("_n")}, F.floor(F.col("elapsed") * DURATION_BINS).cast("long"))
    totals = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("elapsed").alias("_sum"),
        F.min("elapsed").alias("min"),
        F.max("elapsed").alias("max"),
        (F.max_by("recorded_at", "seq") - F.min_by("recorded_at", "seq")).alias("wall"),
    )
    placed = ranked.join(totals.select(*keys, "n"), keys)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.col("elapsed")))

    n = F.col("n")
    middle, high = F.floor(n / F.lit(2)), F.least(F.floor(n * F.lit(0.95)), n - 1)
    ranks = placed.groupBy(*keys).agg(at(middle).alias("p50"), at(high).alias("p95"))
    rate = F.when(F.col("wall") > 0, F.col("n") / F.col("wall")).otherwise(F.lit(0.0))
    return totals.join(ranks, keys).select(
        *keys, "n", (F.col("_sum") / F.col("n")).alias("mean"), "p50", "p95", "min", "max", "wall", rate.alias("fps")
    )


def render_facts(payloads: DataFrame) -> DataFrame:
    """Telemetry payloads (json) as fact rows; ``bad`` marks those without a render id or finish time.

    Payloads that a JSON reader has parsed (see ``payload_lines``) come as ``payload``, with ``json`` only for broken lines.
    """
    parsed = payloads.withColumn("_p", F.col("payload") if "payload" in payloads.columns else F.from_json("json", PAYLOAD))
    finished = F.col("_p.finished_at").try_cast("timestamp")
    names = ["render_id", "project", "slug", "status", "output_duration_seconds", "file_size_bytes", "resolution", "codec", "fps",
             "source_count", "segment_count", "captions_applied", "timing"]
    bad = F.col("_p").isNull() | F.col("_p.render_id").isNull() | finished.isNull()
    return parsed.select("json", *[F.col(f"_p.{n}").alias(n) for n in names], finished.alias("finished_at"), bad.alias("bad"))


def timing_rows(facts: DataFrame) -> DataFrame:
    return facts.filter(~F.col("bad")).select("render_id", F.explode("timing").alias("measure", "seconds"))


def metered(requests: DataFrame) -> DataFrame:
    """Requests with ``minutes`` as given and ``ms``, whole milliseconds; null for a duration that is missing, not finite or not positive."""
    seconds = F.col("duration_seconds")
    valid = seconds.isNotNull() & ~F.isnan(seconds) & (seconds > 0) & (seconds < float("inf"))
    # Beyond any limit one length is as good as another, and a request costs at least one unit.
    whole = F.greatest(F.round(F.least(seconds, F.lit(1e12)) * 1000).cast("long"), F.lit(1).cast("long"))
    return requests.select(
        "uid", F.coalesce("tier", F.lit("free")).alias("tier"), "request_id", "ts", (seconds / 60.0).alias("minutes"), F.when(valid, whole).alias("ms")
    )


def quota_decisions(requests: DataFrame, limit: float = FREE_MINUTES, used: DataFrame | None = None, block_seconds: int = 3600) -> DataFrame:
    """Accept or reject each metered request: uid, request_id, accepted, minutes, reason.

    Requests without a usable duration are rejected (``missing_duration``), whoever asks. Paying users are accepted
    otherwise. A free user's request is accepted while the time accepted so far plus its own stays within the limit; a
    rejected one (``quota_exceeded``) costs nothing, so this is not a running sum. Time is counted in milliseconds.

    It takes a few distributed passes. With R left, requests over R are lost for good and those up to R/2 fit for as long
    as the small ones taken in this pass sum to no more than R/2. A pass therefore ends, per user, at the first request
    where the small ones pass R/2 or a larger one still fits: all before it are decided, it is accepted, and less than
    R/2 is left. So there are at most log2(limit in ms) = 23 passes, over ever fewer requests, and no user's requests
    have to fit in one task. ``requests``: uid, tier, request_id, ts, duration_seconds; ``used`` (uid, used_ms): what
    was accepted before.
    """
    timed = metered(requests)
    columns = ["uid", "request_id", "accepted", "minutes", "reason"]
    none = F.lit(None).cast("string")

    def decided(rows: DataFrame, accepted: bool, reason: Column) -> DataFrame:
        return rows.select("uid", "request_id", F.lit(accepted).alias("accepted"), "minutes", reason.alias("reason"))

    parts = [
        decided(timed.filter("ms is null"), False, F.lit("missing_duration")),
        decided(timed.filter("ms is not null and tier <> 'free'"), True, none),
    ]
    left = F.lit(round(limit * 60_000)).cast("long")
    free = timed.filter("ms is not null and tier = 'free'")
    if used is not None:
        free = free.join(used.select("uid", "used_ms"), "uid", "left")
        left = left - F.coalesce("used_ms", F.lit(0))
    rest = cut_lineage(free.select("uid", "request_id", "ts", "minutes", "ms", left.alias("left")))
    while not rest.isEmpty():
        parts.append(decided(rest.filter("ms > left"), False, F.lit("quota_exceeded")))
        able = rest.filter("ms <= left").withColumn("_order", F.struct("ts", "request_id"))
        is_small = F.col("ms") * 2 <= F.col("left")
        block = F.floor(F.unix_timestamp("ts") / block_seconds).cast("long")
        summed = running_sums(able, ["uid"], "_order", {"_taken": F.when(is_small, F.col("ms")).otherwise(F.lit(0))}, block)
        spent = F.col("_taken") + F.col("ms")
        marked = summed.withColumn("_turn", F.when(is_small, spent * 2 > F.col("left")).otherwise(spent <= F.col("left")))
        ends = marked.filter("_turn").groupBy("uid").agg(F.min("_order").alias("_end"), F.min_by(spent, "_order").alias("_spent"))
        after = F.coalesce(F.col("_order") > F.col("_end"), F.lit(False))
        passed = cut_lineage(
            marked.join(ends, "uid", "left").select(
                "uid", "request_id", "ts", "minutes", "ms", F.when(after, F.col("left") - F.col("_spent")).alias("left"),
                (is_small | F.coalesce(F.col("_order") == F.col("_end"), F.lit(False))).alias("accepted"),
            )
        )
        parts.append(
            passed.filter("left is null").select("uid", "request_id", "accepted", "minutes", F.when(~F.col("accepted"), F.lit("quota_exceeded")).alias("reason"))
        )
        rest = passed.filter("left is not null").drop("accepted")
    result = parts[0]
    for more in parts[1:]:
        result = result.unionByName(more)
    return result.select(*columns)


def usage_rollup(decisions: DataFrame, requests: DataFrame) -> DataFrame:
    """Per user: minutes used (added up in milliseconds), last accepted request, rejected count."""
    timed = decisions.join(requests.select("uid", "request_id", "ts"), ["uid", "request_id"])
    took = F.col("accepted")
    return timed.groupBy("uid").agg(
        (F.sum(F.when(took, F.round(F.col("minutes") * 60_000).cast("long")).otherwise(F.lit(0))) / 60_000.0).alias("minutes_used"),
        F.max(F.when(took, F.col("ts"))).alias("last_use"),
        F.count_if(~took).alias("rejected"),
    )
