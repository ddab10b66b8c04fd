import random

import pytest
from pyspark.sql import functions as F

from timeline_lake.plans import search as S
from timeline_lake.plans import telemetry as Y
from timeline_lake.plans import transcripts as T
from timeline_lake.streaming import runs, search, transcripts, usage

WORD = "project_slug string, source_slug string, word_index bigint, word string, start_time double, end_time double, confidence double"
REQUEST = "uid string, tier string, request_id bigint, ts timestamp, duration_seconds double"


def test_quota_state_lives_on_in_the_checkpoint(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"u{rng.randint(0, 4)}", rng.choice(["free", "free", "pro", None]), i, i, rng.choice([60.0, 600.0, 1500.0, 0.0, None, float("nan")])) for i in range(300)]
    frame = spark.createDataFrame(rows, "uid string, tier string, request_id bigint, at bigint, duration_seconds double").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    columns = [c.split()[0] for c in REQUEST.split(", ")]
    frame = frame.select(*columns)

    def go(source):
        stream = runs.file_stream(spark, f"{tmp_path}/in/*", REQUEST, files_per_batch=1)
        runs.run_to_table(usage.decisions(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")

    # Three runs of the query, each with more files: state comes from the checkpoint only.
    for a, b in ((0, 90), (90, 200), (200, 300)):
        cuts = sorted({a, b, *(rng.randint(a, b) for _ in range(2))})
        for low, high in zip(cuts, cuts[1:]):
            frame.filter((F.col("request_id") >= low) & (F.col("request_id") < high)).coalesce(1).write.parquet(f"{tmp_path}/in/{low:03}")
        go(a)
    got = {(r.uid, r.request_id): (r.accepted, r.reason) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.uid, r.request_id): (r.accepted, r.reason) for r in Y.quota_decisions(frame).collect()}
    assert got == want and len({v for v in got.values()}) == 3


def spoken(spark, rng, n, pause):
    rows, t = [], 946_684_800.0
    for i in range(n):
        t += rng.choice([0.1, 0.2, 0.399, 0.4, 0.9]) if pause else 0.1
        rows.append(("p", f"s{i % 2}", i // 2, f"w{i}", t, t + 0.05, 1.0))
    return spark.createDataFrame(rows, WORD)


@pytest.mark.parametrize("pause", [True, False])
def test_utterances_in_parts_equal_the_batch_form(spark, tmp_path, pause):
    words = spoken(spark, random.Random(8), 240, pause)
    timed = words.withColumn("spoken_from", F.timestamp_micros(F.round(F.col("start_time") * 1e6).cast("long"))).withColumn(
        "spoken_until", F.timestamp_micros(F.round(F.col("end_time") * 1e6).cast("long"))
    )
    closing = timed.limit(1).withColumn("source_slug", F.lit("end")).withColumn("spoken_from", F.col("spoken_from") + F.expr("interval 1 day"))
    for at in range(0, 120, 30):  # words of a batch arrive in any order
        timed.filter((F.col("word_index") >= at) & (F.col("word_index") < at + 30)).orderBy(F.rand(1)).coalesce(1).write.parquet(f"{tmp_path}/in/{at:03}")
    closing.write.parquet(f"{tmp_path}/in/999")
    schema = ", ".join(f"{n} {k}" for n, k in timed.dtypes)
    stream = transcripts.utterance_parts(runs.file_stream(spark, f"{tmp_path}/in/*", schema, files_per_batch=1), "2 seconds", part_words=7)
    runs.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    parts = spark.read.schema(transcripts.PART).parquet(f"{tmp_path}/out")
    assert parts.agg(F.max("n_words")).first()[0] <= 7
    got = sorted((r.source_slug, r.first_index, r.n_words, r.text) for r in transcripts.joined_parts(parts).collect())
    # The batch form compares seconds; here pauses are compared in whole microseconds.
    rounded = words.withColumn("start_time", F.round(F.col("start_time") - 946_684_800.0, 6)).withColumn("end_time", F.round(F.col("end_time") - 946_684_800.0, 6))
    want = sorted((r.source_slug, r.first_index, r.n_words, r.text) for r in T.utterances(rounded).collect())
    if not pause:
        assert len(want) == 2 and parts.count() > 30
    assert got == want and sum(n for *_, n, _ in got) == 240


DOCUMENT = "project_slug string, source_slug string, full_text string, changed_at bigint"


def test_the_followed_index_holds_each_document_in_one_row(spark, tmp_path):
    def arrive(name, *rows):
        spark.createDataFrame([(p, s, t, at) for p, s, t, at in rows], DOCUMENT).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def follow(folder):
        search.follow(runs.file_stream(spark, f"{tmp_path}/in/*", DOCUMENT), folder, f"{tmp_path}/checkpoint", stemmed=False)

    def same(folder, now):
        want = S.postings(S.tokens(spark.createDataFrame(now, "project_slug string, source_slug string, full_text string"), stemmed=False))
        got = search.current_index(spark, folder)
        assert got.select(want.columns).schema.simpleString() == want.schema.simpleString()
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))

    first = f"{tmp_path}/index"
    arrive("0", ("en", "a", "the cat the Hat", 0), ("en", "a", "older", -1), ("en", "b", "gone soon", 0), ("en", "c", " .,; ", 0), ("fr", "a", "Été été 12 x1", 0), ("en", "d", None, 0))
    follow(first)
    same(first, [("en", "a", "the cat the Hat"), ("en", "b", "gone soon"), ("fr", "a", "Été été 12 x1")])
    assert spark.read.parquet(f"{first}/postings").count() == 4  # documents with a text, not their seven postings
    arrive("1", ("en", "b", None, 1), ("fr", "a", "changed", 1), ("en", "d", "the new one", 1))
    follow(first)
    now = [("en", "a", "the cat the Hat"), ("fr", "a", "changed"), ("en", "d", "the new one")]
    same(first, now)
    search.compact(spark, first, f"{tmp_path}/folded")
    same(f"{tmp_path}/folded", now)
    arrive("2", ("en", "a", "cat", 2))
    follow(f"{tmp_path}/folded")
    same(f"{tmp_path}/folded", [("en", "a", "cat"), *now[1:]])
