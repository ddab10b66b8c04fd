import random

import pytest
from pyspark.sql import functions as F

from timeline_lake.plans import retakes as R
from timeline_lake.plans import transcripts as T

WORD = "project_slug string, source_slug string, word_index bigint, word string, start_time double, end_time double, confidence double"


def words_frame(spark, words, project="p", source="s"):
    return spark.createDataFrame([(project, source, i, *w, *([None] * (4 - len(w) - 0) if len(w) == 3 else [])) for i, w in enumerate(words)], WORD)


def random_words(rng, n, gaps=(0.04, 0.25, 0.4, 0.5, 0.7, 2.5)):
    out, at = [], 0.0
    for _ in range(n):
        start = round(at, 3)
        end = round(start + rng.choice([0.2, 0.35, 0.5]), 3)
        out.append((rng.choice(["alpha", "beta", "zx", "go", "it's", "C3", "hello,"]), start, end, rng.choice([None, 0.3, 0.49, 0.9])))
        at = end + rng.choice(gaps)
    return out


def spoken_runs(words):
    runs = [[0]]
    for i in range(1, len(words)):
        if words[i][1] - words[i - 1][2] >= 0.4:
            runs.append([])
        runs[-1].append(i)
    return runs


def tenth(x):
    return int(x * 10 + 0.5) / 10


@pytest.mark.parametrize("rows", [3, 7, 1 << 18])
def test_utterances_do_not_depend_on_blocks(spark, rows):
    words = random_words(random.Random(1), 60)
    got = T.utterances(words_frame(spark, words), rows).orderBy("first_index").collect()
    runs = spoken_runs(words)
    assert [(r.first_index, r.last_index, r.start, r.end, r.text) for r in got] == [
        (run[0], run[-1], words[run[0]][1], words[run[-1]][2], " ".join(words[i][0] for i in run)) for run in runs
    ]


def test_utterance_longer_than_many_blocks(spark):
    words = [("w", i * 0.3, i * 0.3 + 0.2, None) for i in range(20)] + [("x", 9.0, 9.1, None)]
    got = T.utterances(words_frame(spark, words), 3).orderBy("first_index").collect()
    assert [(r.first_index, r.n_words) for r in got] == [(0, 20), (20, 1)]


def test_gap_row_and_compact_json(spark):
    words = words_frame(spark, [("a", 0.0, 0.5, None), ("b", 0.5, 1.0, None), ("c", 1.5, 1.7, None)])
    assert [(r.word_index, r.gap) for r in T.gaps(words).collect()] == [(2, 0.5)]
    entries = T.compact_entries(words).orderBy("word_index", "entry").collect()
    assert [r.json for r in entries] == ['{"end":1.0,"start":0.0,"text":"a b"}', '{"gap":0.5}', '{"end":1.7,"start":1.5,"text":"c"}']


def folded_spans(words, duration, padding):
    spans = []
    for run in spoken_runs(words):
        start = max(0.0, tenth(words[run[0]][1]) - padding)
        end = min(duration, tenth(words[run[-1]][2]) + padding)
        if spans and start <= spans[-1][1]:
            spans[-1][1] = end
        else:
            spans.append([int(start * 100 + 0.5) / 100, int(end * 100 + 0.5) / 100])
    return [tuple(s) for s in spans]


@pytest.mark.parametrize("padding,rows", [(0.15, 5), (0.2, 5), (0.3, 1 << 18)])
def test_silence_spans_equal_the_walk_even_where_they_touch(spark, padding, rows):
    rng = random.Random(7)
    frames, expected = [], {}
    for s in range(25):
        words = random_words(rng, 30, gaps=(0.1, 0.4, 0.5, 0.6))
        frames += [("p", f"s{s}", i, *w) for i, w in enumerate(words)]
        expected[f"s{s}"] = folded_spans(words, words[-1][2], padding)
    df = spark.createDataFrame(frames, WORD)
    durations = df.groupBy(*T.KEYS).agg(F.max_by("end_time", "word_index").alias("duration_seconds"))
    got = {}
    for r in T.silence_segments(df, durations, padding, rows).orderBy("source_slug", "span").collect():
        got.setdefault(r.source_slug, []).append((r.start, r.end))
    assert got == expected


def test_word_flags(spark):
    words = [("zx", 0.0, 0.2, 0.9), ("go", 0.3, 0.4, 0.9), ("hello,", 0.5, 0.7, 0.9), ("calm", 2.8, 3.0, 0.9), ("unsure", 3.1, 3.2, 0.49), ("fine", 3.3, 3.4, None)]
    flags = {r.word: r for r in T.word_flags(words_frame(spark, words), rows=3).collect()}
    assert {w: r.reason for w, r in flags.items()} == {
        "zx": "unusually short word", "hello,": "unusual character pattern", "calm": "adjacent to long silence gap", "unsure": "low confidence (49%)",
    }
    assert flags["hello,"].context == "zx go [hello,] calm unsure fine"
    assert "hello," in {r.word for r in T.word_flags(words_frame(spark, words), normalize=True).filter("reason like 'adjacent%'").collect()}


def test_end_time_repair(spark):
    words = [("a", 1.0, 0.0, None), ("b", 2.0, 5.0, None), ("c", 4.0, 4.3, None), ("d", 6.0, 6.0, None)]
    got = T.repair_end_times(words_frame(spark, words), rows=2).orderBy("word_index").collect()
    assert [r.end_time for r in got] == [2.0, 4.0, 4.3, 6.3]


def stitched(chunks):
    accepted, cutoff = [], 0.0
    for index, (offset, duration, words) in enumerate(chunks):
        length = duration if duration > 0 else 55.0
        for word, start, end in words:
            if start > length + 1.0:
                continue
            clamped = min(end, length)
            safe = clamped if clamped > start else start + 0.3
            if index > 0 and start + offset < cutoff:
                continue
            accepted.append((word, start + offset, safe + offset))
        if accepted:
            cutoff = accepted[-1][2]
    return accepted


def test_stitching_equals_the_walk(spark):
    rng = random.Random(3)
    word_rows, chunk_rows, expected = [], [], {}
    for s in range(30):
        chunks = []
        for c in range(rng.randint(2, 6)):
            words = sorted(((f"w{c}.{k}", round(rng.uniform(0, 58), 2)) for k in range(rng.randint(0, 8))), key=lambda w: w[1] if rng.random() < 0.9 else 0)
            words = [(w, t, round(t + rng.choice([-1, 0.3, 2, 40]), 2)) for w, t in words]
            chunks.append((c * 50.0, rng.choice([0.0, 20.0, 55.0]), words))
        expected[f"s{s}"] = stitched(chunks)
        for c, (offset, duration, words) in enumerate(chunks):
            chunk_rows.append(("p", f"s{s}", c, offset, duration))
            word_rows += [("p", f"s{s}", c, i, w, a, b, None) for i, (w, a, b) in enumerate(words)]
    words = spark.createDataFrame(word_rows, "project_slug string, source_slug string, chunk_index bigint, word_index bigint, word string, start_time double, end_time double, confidence double")
    chunks = spark.createDataFrame(chunk_rows, "project_slug string, source_slug string, chunk_index bigint, offset double, duration double")
    got = {s: [] for s in expected}
    for r in T.stitch_chunks(words, chunks).orderBy("source_slug", "chunk_index", "word_index").collect():
        got[r.source_slug].append((r.word, r.start_time, r.end_time))
    assert got == expected


def greedy(texts):
    sets = [t.lower().split() for t in texts]
    flagged, marks = set(), []
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            a, b = sets[i], sets[j]
            if j in flagged or min(len(a), len(b)) < 3 or min(len(a), len(b)) / max(len(a), len(b)) < 0.5:
                continue
            if len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.7:
                marks.append((i, j))
                flagged.add(j)
                break
    return marks


@pytest.mark.parametrize("reach,walked", [(1, 0), (4, 0), (16, R.WALKED)])
def test_retakes_equal_the_nested_loop(spark, reach, walked):
    rng = random.Random(11)
    base = [[rng.choice("red green blue black white brown grey pink".split()) for _ in range(rng.randint(2, 6))] for _ in range(5)]
    texts = []
    for _ in range(40):
        take = list(rng.choice(base))
        if rng.random() < 0.4:
            take[rng.randrange(len(take))] = rng.choice(["red", "other", "Blue"])
        texts.append(" ".join(take))
    rows, at, first = [], 0.0, []
    for text in texts:
        first.append(len(rows))
        for word in text.split():
            rows.append((word, at, at + 0.2, None))
            at += 0.25
        at += 1.0
    place = {f: n for n, f in enumerate(first)}
    got = R.retake_flags(words_frame(spark, rows), rows=8, reach=reach, walked=walked).collect()
    assert sorted((place[r.i], place[r.j]) for r in got) == greedy(texts)


def test_three_equal_takes(spark):
    rows = [(w, k * 5 + n * 0.3, k * 5 + n * 0.3 + 0.2, None) for k in range(3) for n, w in enumerate(["one", "two", "three"])]
    got = R.retake_flags(words_frame(spark, rows)).orderBy("j").collect()
    assert [(r.i, r.j, r.reason) for r in got] == [
        (0, 3, "near-duplicate of earlier utterance (100% match) — possible retake"), (3, 6, "near-duplicate of earlier utterance (100% match) — possible retake"),
    ]


def test_many_openings_that_contest_the_same_takes():
    """2,000 openings, each with a word of its own, and 2,000 equal takes: marked one to one without passing marked ones."""
    import time

    import pandas as pd

    common = [f"common{i}" for i in range(12)]
    tokens = [[*common, f"own{i:05}"] for i in range(2000)] + [list(common)] * 2000
    # Openings differ in their own word only, so they are alike too; each marks the next one, the last opening the first take.
    rows = pd.DataFrame({"project_slug": "p", "source_slug": "s", "i": range(4000), "n_words": [len(t) for t in tokens], "tokens": tokens, "telling": [t[:4] for t in tokens]})
    began = time.time()
    marks = R._walked(rows, exclusive=True)
    assert [(a, b) for a, b in zip(marks["i"], marks["j"])] == [(i, i + 1) for i in range(3999)]
    far = [[f"a{i % 2}{w}" for w in range(5)] + [f"b{i}{w}" for w in range(2)] for i in range(2)]
    openings = [[*(f"c{w}" for w in range(7)), f"x{i % 2}1", f"x{i % 2}2", f"x{i % 2}3"] for i in range(2000)]
    takes = [[f"c{w}" for w in range(7)]] * 2000
    # Openings of the two kinds share 7 of 13 words, an opening and a take 7 of 10.
    order = [t for pair in zip(openings[:2], far) for t in pair][:2] + openings[2:] + takes
    rows = pd.DataFrame({"project_slug": "p", "source_slug": "s", "i": range(len(order)), "n_words": [len(t) for t in order], "tokens": order, "telling": [t[:4] for t in order]})
    marks = R._walked(rows, exclusive=True)
    assert len(set(marks["j"])) == len(marks) > 3900 and time.time() - began < 20


def turned(spark, rows):
    return spark.createDataFrame(rows, "project_slug string, source_slug string, turn bigint, tokens array<string>")


def test_short_recordings_are_sent_once_and_walked_where_they_lie(spark, monkeypatch):
    from timeline_lake.plans import views as V

    monkeypatch.setattr(V, "WORDS_PER_PART", 256)
    rng = random.Random(4)
    said = [[rng.choice(["well,", "this", "is", "one", "take.", "and", "another"]) for _ in range(rng.randint(0, 9))] for _ in range(40)]
    rows = [(p, s, i, rng.choice(said)) for p, s in (("p", "a"), ("p", "b"), ("q", "a"), (None, "c")) for i in range(25)]
    words = V._words_of_turns(turned(spark, rows))
    blocked = V._words_of_turns(turned(spark, rows), 7)
    assert sorted(map(str, words.collect())) == sorted(map(str, blocked.collect()))
    for find in (R.nearest_alike, R.retake_flags):
        short = find(words, longest=5_000)
        # Only the turns are sent; words, utterances and marks stay where they are.
        assert short._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        found = sorted(map(str, short.collect()))
        assert found and found == sorted(map(str, find(blocked).collect()))
    # A recording that may be too long for one task is not walked unseen.
    assert R._sure_to_be_short(30, 10) and not R._sure_to_be_short(31, 10) and not R._sure_to_be_short(None, 10)


def test_whole_utterances_equal_joined_ones(spark):
    """Also with ends that are missing, words that share an index, and recordings without a key."""
    from timeline_lake.plans import transcripts as T

    rng = random.Random(5)
    rows = []
    for p, s in (("p", "a"), ("p", "b"), ("q", "a"), (None, "a"), ("p", None)):
        at = 0.0
        for i in range(rng.randint(1, 30)):
            end = at + 0.25
            rows.append((p, s, i, f"w{rng.randint(0, 5)}", at, None if rng.random() < 0.1 else end, None))
            at = end + rng.choice([0.0, 0.125, 0.5])
    rows += [("z", "z", 0, "one", 0.0, 0.25, None), ("z", "z", 5, "x", 1.0, 1.25, None), ("z", "z", 5, "x", 1.0, 1.25, None), ("z", "z", 6, "y", 1.25, 1.5, None)]
    words = spark.createDataFrame(rows, "project_slug string, source_slug string, word_index bigint, word string, start_time double, end_time double, confidence double")
    whole = T.utterances(words, longest=30)
    assert "Window" not in whole._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, whole.collect())) == sorted(map(str, T.utterances(words).collect()))
    # Recordings longer than a block are joined from pieces as before.
    assert "Window" in T.utterances(words, 8, longest=30)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("find", [R.nearest_alike, R.retake_flags])
def test_many_recordings_are_walked_at_a_time(spark, find):
    """One pass over a task's utterances, not a call for each recording; batches end anywhere in a recording."""
    rng = random.Random(6)
    rows = []
    for r in range(30):
        at, n = 0.0, 0
        for _ in range(rng.choice([1, 3, 20])):
            for word in rng.choice(["aa bb cc", "aa bb cc dd", "dd ee ff gg", f"u{rng.random()} v w", "one two"]).split():
                rows.append((f"p{r % 3}", f"s{r}", n, word, at, at + 0.2, None))
                at, n = at + 0.25, n + 1
            at += 1.0
    words = spark.createDataFrame(rows, "project_slug string, source_slug string, word_index bigint, word string, start_time double, end_time double, confidence double")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted(map(str, find(words).collect()))
    try:
        for size in ("1", "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found = find(words, longest=len(rows))
            assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(str, found.collect())) == want and len(want) > 20
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    # Too long for a block: a call for each recording, as before.
    assert sorted(map(str, find(words, rows=8, longest=len(rows)).collect())) == want
