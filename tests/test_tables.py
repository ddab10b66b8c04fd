import datetime
import random

import pytest
from pyspark.sql import functions as F

from timeline_lake.functions import text as X
from timeline_lake.functions.stemming import stem
from timeline_lake.operators import keyed as K
from timeline_lake.plans import search as S
from timeline_lake.plans import specs as E
from timeline_lake.plans import telemetry as Y
from timeline_lake.sources import documents as D
from timeline_lake.sources import presets as P
from timeline_lake.sources import tables as B

T0 = datetime.datetime(2024, 1, 1)
T1 = datetime.datetime(2024, 6, 1)


def column(spark, values, expression):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(expression).collect()]


def test_slugs(spark):
    given = ["Hi! How's it going?", "Café Résumé", "A  B__C", "", "!!!hello!!!", "C0048.MP4"]
    assert column(spark, given, X.slugify("v")) == ["hi-how-s-it-going", "cafe-resume", "a-b-c", "untitled", "hello", "c0048-mp4"]
    assert column(spark, ["/Users/w/April 16th Video/C0048.MP4"], X.project_slug_of("v")) == ["april-16th-video"]
    assert column(spark, ["/Users/w/April 16th Video/C0048.MP4"], X.source_slug_of("v")) == ["c0048"]
    assert column(spark, ["a/b/c", "a", "a/", "/x/y"], X.split_compound_id("v")) == [("a", "b/c"), None, None, ("x", "y")]


def test_unique_slugs(spark):
    taken = spark.createDataFrame([("p", s) for s in ("my-slug", "my-slug-2", "my-slug-3", "full")] + [("p", f"full-{i}") for i in range(2, 101)], "project string, slug string")
    asked = spark.createDataFrame([("p", "my-slug", 1), ("p", "my-slug", 2), ("p", "new", 3), ("p", "full", 4)], "project string, base string, n bigint")
    got = {r.n: r.slug for r in K.unique_slugs(asked, taken, ["project"], ["n"], F.lit(0)).collect()}
    assert (got[1], got[2], got[3]) == ("my-slug-4", "my-slug-5", "new")
    assert got[4].startswith("full-") and len(got[4]) == len("full-") + 8


def test_unique_slugs_across_bases_and_null_scopes(spark):
    none = spark.createDataFrame([], "project string, slug string")
    asked = spark.createDataFrame([("p", "x", 1), ("p", "x", 2), ("p", "x-2", 3), (None, "x", 4), (None, "x", 5)], "project string, base string, n bigint")
    got = {r.n: r.slug for r in K.unique_slugs(asked, none, ["project"], ["n"], F.lit(0)).collect()}
    assert got == {1: "x", 2: "x-3", 3: "x-2", 4: "x", 5: "x-2"}


def test_many_requests_for_one_base_stay_apart(spark):
    many = spark.range(100_000).select(F.lit("p").alias("project"), F.lit("x").alias("base"), "id")
    first = K.unique_slugs(many, spark.createDataFrame([], "project string, slug string"), ["project"], ["id"], F.floor(F.col("id") / 10_000)).cache()
    assert first.select("slug").distinct().count() == 100_000
    # Asked again, every hashed name is taken.
    again = K.unique_slugs(many, first.select("project", "slug"), ["project"], ["id"], F.floor(F.col("id") / 10_000))
    assert again.unionByName(first).select("slug").distinct().count() == 200_000


def test_get_or_create_keeps_every_name(spark):
    table = spark.createDataFrame([("x", "X", "active")], "slug string, name string, status string")
    names = spark.createDataFrame([(n,) for n in ("X", "x!", "x 2", "", "b", "日本", None, "X")], "name string")
    after, answers = K.get_or_create(table, names, {"status": F.lit("active")})
    rows = after.collect()
    assert len(rows) == 7 and len({r.slug for r in rows}) == 7
    assert {r.name: (r.slug, r.created_now) for r in answers.collect()}["X"] == ("x", False)


def test_batch_order_counts(spark):
    schema = "slug string, name string, created timestamp"
    table = spark.createDataFrame([("a", "old", T0)], schema)
    later = [T0 + datetime.timedelta(days=d) for d in (1, 2)]
    batch = spark.createDataFrame([("a", "second", later[1], 2), ("a", "zfirst", later[0], 1), ("b", "zfirst", later[0], 1), ("b", "second", later[1], 2)], schema + ", nth int")
    assert {r.slug: (r.name, r.created) for r in K.upsert(table, batch, ["slug"], order="nth").collect()} == {"a": ("second", T0), "b": ("second", later[0])}
    _, inserted = K.insert_or_ignore(table, batch, ["slug"], order="nth")
    assert [(r.slug, r.name) for r in inserted.collect()] == [("b", "zfirst")]


def test_block_operators_keep_null_keys(spark):
    from timeline_lake.operators import blocks as B

    rows = spark.createDataFrame([(None, 1, 5), (None, 2, 7), ("k", 1, 1)], "k string, at int, v int")
    for block in (F.lit(None).cast("long"), F.floor(F.col("at") / 2)):
        got = {(r.k, r.at): r.s for r in B.running_sums(rows, ["k"], "at", {"s": F.col("v")}, block).collect()}
        assert got == {(None, 1): 0, (None, 2): 5, ("k", 1): 0}
        assert {(r.k, r.at): r.n for r in B.row_numbers(rows, ["k"], ["at"], block, "n").collect()} == {(None, 1): 0, (None, 2): 1, ("k", 1): 0}
        assert {(r.k, r.at): r.l for r in B.last_known(rows, ["k"], "at", {"l": F.col("v")}, block, include_current=False).collect()} == {(None, 1): None, (None, 2): 5, ("k", 1): None}
        assert {(r.k, r.at): r.l for r in B.next_known(rows, ["k"], "at", {"l": F.col("v")}, block).collect()} == {(None, 1): 7, (None, 2): None, ("k", 1): None}


def test_next_known_takes_linear_time_in_a_block(spark):
    from timeline_lake.operators import blocks as B

    n = 300_000
    rows = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("at"), F.when(F.col("id") % 1000 == 0, F.col("id")).alias("v"))
    following = (F.floor(F.col("at") / 1000) + 1) * 1000
    for with_own in (False, True):
        found = B.next_known(rows, ["k"], "at", {"l": F.col("v")}, F.lit(0), include_current=with_own)
        want = F.coalesce(F.col("v") if with_own else F.lit(None), F.when(following < n, following))
        assert found.count() == n and found.filter(~F.col("l").eqNullSafe(want)).isEmpty()


def test_interval_joins_of_very_different_lengths(spark):
    from timeline_lake.operators import joins as J

    rng = random.Random(5)
    spans = [("a", i, s, s + rng.choice([0.5, 3.0, 40.0, 3000.0, 1e5, 1e9])) for i, s in enumerate(rng.uniform(-100, 5000) for _ in range(60))]
    points = [("a", i, rng.uniform(-200, 9000)) for i in range(80)]
    left = spark.createDataFrame(spans, "k string, i int, s double, e double")
    right = left.select("k", F.col("i").alias("j"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    dots = spark.createDataFrame(points, "k string, p int, t double")
    inside = sorted((r.p, r.i) for r in J.points_in_intervals(dots, left, ["k"], "t", "s", "e").collect())
    assert inside == sorted((p, i) for _, p, t in points for _, i, s, e in spans if s <= t < e)
    pairs = sorted((r.i, r.j) for r in J.overlapping_intervals(left, right, ["k"], ("s", "e"), ("s2", "e2")).collect())
    assert pairs == sorted((i, j) for _, i, s, e in spans for _, j, s2, e2 in spans if max(s, s2) < min(e, e2))
    assert J.with_bins(left, "s", "e", 16.0).count() <= 60 * (J.COPIES + 2)


def test_bins_suit_every_length(spark):
    from timeline_lake.operators import joins as J

    lengths = [1e-3, 1.0, 40.0, 1200.0, 7e4, 1e7, 1e11, 1e15, 1e300]
    spans = spark.createDataFrame([("a", i, 5.0, 5.0 + n) for i, n in enumerate(lengths)], "k string, i int, s double, e double")
    copies = {r.i: r["count"] for r in J.with_bins(spans, "s", "e", 16.0).groupBy("i").count().collect()}
    assert set(copies) == set(range(len(lengths))) and max(copies.values()) <= J.COPIES + 2
    # Intervals of twenty minutes over 17 hours: a point meets those near it, not all of them.
    many = spark.createDataFrame([("a", i, i * 300.0, i * 300.0 + 1200.0) for i in range(200)], "k string, i int, s double, e double")
    held = J.with_bins(many, "s", "e", 16.0).groupBy("_bin").count().agg(F.max("count")).first()[0]
    assert held <= 6
    endless = spark.createDataFrame([("a", 0, 0.0, float("inf")), ("a", 1, float("nan"), 3.0), ("a", 2, None, 3.0), ("a", 3, -1e308, 1e308), ("a", 4, 1.0, 2.0)], "k string, i int, s double, e double")
    dots = spark.createDataFrame([("a", 1.5)], "k string, t double")
    assert [r.i for r in J.points_in_intervals(dots, endless, ["k"], "t", "s", "e").collect()] == [4]
    assert sorted((r.i, r.problem) for r in J.span_problems(endless, "s", "e").collect()) == [
        (0, "an end is not a finite time"), (1, "an end is not a finite time"), (2, "an end is missing"), (3, "the length is not finite")
    ]


def test_of_marks_at_one_instant_the_last_counts(spark):
    from timeline_lake.operators import joins as J

    marks = spark.createDataFrame([("a", 1, 2.0, "x"), ("a", 2, 2.0, "b")], "k string, id int, t double, v string")
    dots = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0)], "k string, t double")
    got = J.bracket(dots, marks, ["k"], "t", ["v"], F.lit(0), tie="id").orderBy("t").collect()
    assert [(r.before and r.before.v, r.after and r.after.v) for r in got] == [(None, "b"), ("b", "b"), ("b", None)]


def test_upsert_keeps_created(spark):
    schema = "slug string, name string, has_audio boolean, created timestamp"
    table = spark.createDataFrame([("a", "old", True, T0), ("b", "other", True, T0)], schema)
    batch = spark.createDataFrame([("a", "new", False, T1), ("c", "third", True, T1)], schema)
    once = K.upsert(table, batch, ["slug"])
    rows = [tuple(r) for r in once.orderBy("slug").collect()]
    assert rows == [("a", "new", False, T0), ("b", "other", True, T0), ("c", "third", True, T1)]
    assert [tuple(r) for r in K.upsert(once, batch, ["slug"]).orderBy("slug").collect()] == rows


def test_replace_children_and_rollup(spark):
    scenes = spark.createDataFrame([("p", "s", i, 2.0 * i, 2 * i + 1.8) for i in range(5)] + [("p", "t", 0, 0.0, 1.0)], "project_slug string, source_slug string, scene_index bigint, start_time double, end_time double")
    keys = ["project_slug", "source_slug"]
    fresh = scenes.filter("source_slug = 's' and scene_index in (1, 3)")
    saved = spark.createDataFrame([("p", "s")], "project_slug string, source_slug string")
    for _ in range(2):
        got = K.replace_children(scenes, saved, fresh, keys, ["scene_index"], "scene_index", F.floor(F.col("scene_index") / 2))
        assert sorted((r.source_slug, r.scene_index, r.start_time) for r in got.collect()) == [("s", 0, 2.0), ("s", 1, 6.0), ("t", 0, 0.0)]
        scenes = got
        fresh = got.filter("source_slug = 's'")
    parents = spark.createDataFrame([("p", "s", "extracted", 0, 3.0), ("p", "t", "extracted", 7, 3.0)], "project_slug string, source_slug string, status string, scene_count bigint, duration_seconds double")
    rolled = {r.source_slug: (r.status, r.scene_count, r.duration_seconds) for r in K.parent_rollup(parents, saved, fresh, keys).collect()}
    assert rolled == {"s": ("analyzed", 2, 7.8), "t": ("extracted", 7, 3.0)}


def test_parity(spark):
    schema = "slug string, created timestamp, duration double"
    db = spark.createDataFrame([("same", T0, 1.0), ("gone", T0, 1.0), ("off", T0, 1.0)], schema)
    disk = spark.createDataFrame([("same", T0 + datetime.timedelta(milliseconds=300), 1.0001), ("off", T0, 1.01), ("extra", T0, None)], schema)
    got = {r.slug: (r.kind, r.detail) for r in K.parity_diff(db, disk, ["slug"], ["created", "duration"]).collect()}
    assert got == {"same": ("OK", ""), "gone": ("MISSING_ON_DISK", ""), "off": ("DIFFER", "duration: db=1.0 md=1.01"), "extra": ("MISSING_IN_DB", "")}


def test_cascade(spark):
    tables = {
        "projects": spark.createDataFrame([("p",), ("q",)], "slug string"),
        "transcripts": spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a")], "project_slug string, source_slug string"),
        "words": spark.createDataFrame([("p", "a", i) for i in range(4)] + [("q", "a", 0)], "project_slug string, source_slug string, word_index int"),
    }
    links = {"transcripts": ("projects", {"project_slug": "slug"}), "words": ("transcripts", {"project_slug": "project_slug"})}
    left = K.cascade_delete(tables, links, "projects", spark.createDataFrame([("p",)], "slug string"))
    assert {name: df.count() for name, df in left.items()} == {"projects": 1, "transcripts": 1, "words": 1}


def test_files_round_trip(spark, tmp_path):
    project = tmp_path / "projects" / "my-project"
    project.mkdir(parents=True)
    (project / "project.md").write_text("---\nslug: my-project\nname: \"A \\\"B\\\"\"\ntags:\n- x\n- 'y z'\n---\n\nBody\n")
    (project / "broken.md").write_text("no header")
    (project / "c1.words.json").write_text('[{"word":"hi","start":0.0,"end":0.5,"confidence":0.9},{"word":"you","start":0.5,"end":1.0}]')
    (project / "c2.words.json").write_text("[{")
    read = D.front_matter(D.read_documents(spark, str(tmp_path), "*.md"), {"slug": "string", "name": "string"}, ["tags"]).collect()
    assert [(r.slug, r.name, r.tags, r.body) for r in read] == [("my-project", 'A "B"', ["x", "y z"], "Body\n")]
    words = D.words_sidecars(D.read_documents(spark, str(tmp_path), "*.words.json")).filter("word is not null").orderBy("word_index").collect()
    assert [(r.project_slug, r.source_slug, r.word_index, r.word, r.confidence) for r in words] == [("my-project", "c1", 0, "hi", 0.9), ("my-project", "c1", 1, "you", None)]
    projects = spark.createDataFrame([("my-project", "kept")], "slug string, name string")
    table, inserted = K.insert_or_ignore(projects, spark.createDataFrame([("my-project", "A"), ("n", "B")], "slug string, name string"), ["slug"])
    assert sorted(map(tuple, table.collect())) == [("my-project", "kept"), ("n", "B")] and inserted.count() == 1


def test_tables_and_lines_on_disk(spark, tmp_path):
    presets = P.built_in_presets(spark)
    assert presets.count() == 11
    B.write_table(presets, str(tmp_path), "presets", ["name"])
    assert B.read_table(spark, str(tmp_path), "presets").filter("name = 'william'").first().config_json.startswith('{"allCaps":true')
    lines = spark.createDataFrame([("p", "s", -2, "# Transcript: s"), ("p", "s", -1, ""), ("p", "s", 0, "- [0:00.00 – 0:01.50] hello"), ("p", "s", 3, "- [1:02.00 – 1:03.25] again")], "project_slug string, source_slug string, line_no bigint, line string")
    D.write_lines(lines, str(tmp_path / "lines"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["# Transcript: s", "", "- [0:00.00 – 0:01.50] hello", "- [1:02.00 – 1:03.25] again"]
    parsed = D.parse_transcript_lines(lines, rows=2).orderBy("line_no").collect()
    assert [(r.start, r.end, r.gap_before, r.text) for r in parsed] == [(0.0, 1.5, None, "hello"), (62.0, 63.25, 60.5, "again")]


def test_spec_spellings_merge_and_kind(spark):
    text = '{"sources":[{"id":"a","path":"/x/a.mp4"}],"segments":[{"sourceId":"a","start":0,"end":2}],"captions":{"fontSize":5},"outputPath":"/o/r.mp4","overlays":[{"source_id":"a","text":{"title":"t"},"start":0,"end":1,"x":0,"y":0,"width":1,"height":1}]}'
    docs = spark.createDataFrame([(1, text), (2, '{"sources":[],"segments":[]}'), (3, "nonsense")], "id bigint, spec_json string")
    parsed = E.parse_specs(docs)
    assert {r.id: r.problem for r in parsed.collect()} == {1: None, 2: "output_path", 3: "not a JSON object"}
    good = E.good_specs(parsed)
    assert good.select(E.overlay_kind(F.col("spec.overlays")[0])).first()[0] == "video"
    empty = good.limit(0)
    same = E.merge_specs(good, empty, ["id"]).select("spec").first()
    assert same.spec == good.select("spec").first().spec
    override = E.parse_specs(spark.createDataFrame([(1, '{"captions":{"color":"#fff"}}')], "id bigint, spec_json string"))
    merged = E.merge_specs(good, override, ["id"]).first().spec
    assert (merged.captions.font_size, merged.captions.color, merged.output_path) == (5.0, "#fff", "/o/r.mp4")
    assert column(spark, ["/o/r.mp4", "r"], E.rerender_path(F.col("v"))) == ["/o/r_rerender.mp4", "r_rerender."]


def test_frame_ranks(spark):
    frames = spark.createDataFrame([("r", i, float(i), float(e)) for i, e in enumerate([4, 1, 3, 2])], "render_id string, seq bigint, recorded_at double, elapsed double")
    row = Y.frame_stats(frames).first()
    assert (row.n, row.mean, row.p50, row.p95, row.wall) == (4, 2.5, 3.0, 4.0, 3.0)


def walk_quota(requests, limit=5_400_000):
    used, out = 0, []
    for seconds in requests:
        good = seconds is not None and seconds == seconds and 0 < seconds < float("inf")
        out.append(good and used + round(seconds * 1000) <= limit)
        used += round(seconds * 1000) if out[-1] else 0
    return out


def test_quota_is_the_walk_for_every_user(spark):
    rng = random.Random(2)
    rows, expected = [], {}
    for user in range(12):
        n = 900 if user == 0 else rng.randint(1, 60)
        choices = [6.0, 12.6, 0.1, 15.0, 180.0, 600.0, 2730.0, 3600.0, 5400.0, 5700.0, None, -60.0, 0.0, float("nan"), float("inf")]
        seconds = [rng.choice(choices[:6] + choices if user else choices[:5]) for _ in range(n)]
        expected[f"u{user}"] = walk_quota(seconds)
        rows += [(f"u{user}", "free" if user % 2 else None, i, T0 + datetime.timedelta(minutes=7 * i), s) for i, s in enumerate(seconds)]
    rows += [("payer", "pro", 0, T0, 1e6), ("payer", "pro", 1, T0, -1.0)]
    frame = spark.createDataFrame(rows, "uid string, tier string, request_id bigint, ts timestamp, duration_seconds double")
    got, reasons = {}, {}
    for r in Y.quota_decisions(frame).orderBy("uid", "request_id").collect():
        got.setdefault(r.uid, []).append(r.accepted)
        reasons[r.uid, r.request_id] = r.reason
    assert got.pop("payer") == [True, False] and reasons["payer", 1] == "missing_duration" and got == expected
    used = spark.createDataFrame([("u0", 5_400_000)], "uid string, used_ms bigint")
    assert Y.quota_decisions(frame.filter("uid = 'u0'"), used=used).filter("accepted").count() == 0


def test_search(spark):
    docs = spark.createDataFrame([("p", "alpha", "The quick brown fox jumps"), ("p", "beta", "Opus is a transformer"), ("q", "gamma", "foxes run, runs running")], "project_slug string, source_slug string, full_text string")
    index, lengths = S.postings(S.tokens(docs)), S.document_lengths(docs)
    assert [r.source_slug for r in S.search(index, lengths, ["fox"], "p").collect()] == ["alpha"]
    assert [r.source_slug for r in S.search(index, lengths, ["opus"], "p").collect()] == ["beta"]
    assert S.search(index, lengths, ["giraffe"]).count() == 0
    assert sorted(r.source_slug for r in S.search(index, lengths, ["foxes"]).collect()) == ["alpha", "gamma"]
    assert [r.source_slug for r in S.phrase_search(index, ["brown", "fox"]).collect()] == ["alpha"]
    assert [r.source_slug for r in S.boolean_search(index, any_of=["fox", "opus"], none_of=["quick", "run"]).collect()] == ["beta"]


@pytest.mark.parametrize(
    "word,stemmed",
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"),
     ("happy", "happi"), ("relational", "relat"), ("triplicate", "triplic"), ("hopeful", "hope"), ("adjustable", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control")],
)
def test_porter(word, stemmed):
    assert stem(word) == stemmed


def test_a_tree_of_many_documents_takes_few_files(spark, tmp_path):
    paths = [f"/d/p{i % 3}/f{i}{e}" for i in range(40) for e in (".md", ".words.json", ".v1.md", "")]
    docs = spark.createDataFrame([(p, f"a\n{p}\n") for p in paths] + [("/d/twice.md", "x"), ("/d/twice.md", "x"), ("/d/none.md", None), (None, "lost")], "path string, text string")
    D.write_tree(docs, str(tmp_path / "t"))
    assert len(list((tmp_path / "t").rglob("part-*"))) < 40
    for suffix in (".md", ".words.json", "9.md", ""):
        got = {r.path: r.text for r in D.read_tree(spark, str(tmp_path / "t"), suffix).collect()}
        want = {p: f"a\n{p}\n" for p in paths} | {"/d/twice.md": "x\nx", "/d/none.md": ""}
        assert got == {p: t for p, t in want.items() if p.endswith(suffix)}


def test_merged_specs_are_not_broadcast(spark):
    text = '{"sources":[{"id":"s","path":"p"}],"segments":[{"sourceId":"s","start":0,"end":1}],"outputPath":"o"}'
    specs = E.good_specs(E.parse_specs(spark.createDataFrame([(1, text)], "id int, spec_json string")))
    plan = E.merge_specs(specs, specs, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_postings_are_grouped_where_the_texts_are(spark):
    from timeline_lake.plans import search as S

    docs = spark.createDataFrame([("p", "a", "of the of"), ("p", "b", None), (None, "a", "the")], "project_slug string, source_slug string, full_text string")
    index = S.postings(S.tokens(S.by_document(docs), stemmed=False))
    assert index._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r.term, r.source_slug, r.tf, r.positions) for r in index.collect()) == [("of", "a", 2, [0, 2]), ("the", "a", 1, [0]), ("the", "a", 1, [1])]
