import os

import pytest

import corpus_pipeline
from helpers import as_dicts, prose, rows, with_odd_columns  # noqa: F401
from test_dedup import brute_force, edited
from timeline_lake.llm import registry
from timeline_lake.llm.quality_rules import judge

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    clean = [prose(i, 90) for i in range(50)]
    near = [edited(clean[0], 1, 7), edited(clean[1], 1, 8)]
    junk = [" ".join(w + "&&&***" for w in prose(i, 90).split()) for i in range(200, 210)]
    data = rows(*clean, *near, *clean[5:8], *junk, None, "", "short one")
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(d, int(d < 55), 0) for d, *_ in data if d < 65]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, data


def test_stages_one_by_one(spark, tables):
    folder, data = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]
            left[name] = [r["doc_id"] for r in out.collect()]
            assert len(set(left[name])) == len(left[name])
        if name == "quality_rules":
            assert set(left[name]) == {r["doc_id"] for r in judge(docs).filter("kept").collect()} == set(range(55))
        elif name == "quality_classifier":
            assert set(left[name]) == set(range(55))
        elif name == "exact_dedup":
            top = {t: max(d for d, x in before.items() if x == t) for t in before.values()}
            assert set(left[name]) == set(top.values())
        elif name == "near_dedup":
            plain = brute_force([(d, t) for d, t in before.items()])
            assert set(left[name]) == {d for d, (_, c, _k) in plain.items() if c == d}
            assert {0, 1} <= set(left[name]) and not {50, 51} & set(left[name])
        else:
            assert {r["doc_id"] for r in out.collect()} == set(before)
        docs = out


def test_run_is_the_stages(spark, tables):
    folder, _ = tables
    found = as_dicts(corpus_pipeline.run(spark, folder))
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(found[0])
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_on_the_smallest_tables(spark, name):
    from timeline_lake.catalog.check import compare, connect

    table = "pages" if name in ("op2_warc_from_arc", "op8_template_extraction") else "documents"
    n = spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    if name in registry.ORACLES:
        assert compare(spark, connect(FOLDER), FOLDER, registry.QUERIES[name], registry.ORACLES[name]) == ""
    else:
        assert registry.QUERIES[name](spark, FOLDER).count() >= n
