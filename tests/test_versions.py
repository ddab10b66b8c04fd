import pytest
from pyspark.sql import functions as F

from timeline_lake.operators import keyed as K
from timeline_lake.sources import versions as V

KEY = ["project", "slug"]
ROW = "project string, slug string, size bigint, note string"


def table(spark, n=400):
    return spark.range(n).select(F.concat(F.lit("p"), F.col("id") % 5).alias("project"), F.concat(F.lit("s"), "id").alias("slug"), F.col("id").alias("size"), F.lit("old").alias("note"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def folders(df):
    return {f.rsplit("/", 2)[-2] for f in df.inputFiles()}


def test_a_merge_reads_and_writes_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    V.create(table(spark), path, KEY, buckets=32)
    before = V.layout_of(spark, path)
    assert rows(V.read(spark, path)) == rows(table(spark)) and len(before.written) > 20
    batch = spark.createDataFrame([("p1", "s1", 7, "new"), ("p9", "s9", 8, "new"), (None, "s2", 9, "new")], ROW)
    seen = []

    def apply(old):
        seen.append(folders(old))
        return K.upsert(old, batch, KEY)

    touched = V.merge(spark, path, batch, apply)
    after = V.layout_of(spark, path)
    assert len(touched) <= 3 and seen[0] <= {f"_bucket={b}" for b in touched}
    assert {b for b, v in after.written.items() if v == 1} == set(touched) and after.version == 1
    assert all(after.written[b] == 0 for b in before.written if b not in touched)
    assert rows(V.read(spark, path)) == rows(K.upsert(table(spark), batch, KEY))
    assert rows(V.read(spark, path, version=0)) == rows(table(spark))
    # Deleting every row of a bucket takes it out of the manifest; a failed merge changes nothing.
    doomed = V.read(spark, path).filter(after.bucket() == touched[0]).select(*KEY)
    V.merge(spark, path, doomed, lambda old: old.filter(F.lit(False)))
    assert touched[0] not in V.layout_of(spark, path).written
    with pytest.raises(Exception):
        V.merge(spark, path, batch, lambda old: old.withColumn("size", F.raise_error(F.lit("no")).cast("long")))
    assert V.layout_of(spark, path).version == 2


def test_lookups_are_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    V.create(table(spark), path, KEY, buckets=8)
    one = V.lookup(spark, path, project="p3", slug="s13")
    assert rows(one) == [("p3", "s13", 13, "old")]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(slug,s13)" in plan and "EqualTo(project,p3)" in plan and "_bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert rows(V.lookup(spark, path, slug="s13")) == rows(one) and rows(V.lookup(spark, path, project="p3", slug="x")) == []
    wanted = spark.createDataFrame([("p3", "s13"), ("p3", "s13"), ("p0", "nobody")], "project string, slug string")
    many = V.lookup_many(spark, path, wanted)
    assert rows(many) == rows(one) and len(folders(many)) <= 2


def test_an_empty_table_can_be_merged_into(spark, tmp_path):
    path = str(tmp_path / "t")
    V.create(table(spark, 0), path, KEY, buckets=4)
    assert rows(V.read(spark, path)) == [] and rows(V.lookup(spark, path, project="p", slug="s")) == []
    batch = table(spark, 3)
    V.merge(spark, path, batch, lambda old: K.insert_or_ignore(old, batch, KEY)[0])
    assert rows(V.read(spark, path)) == rows(batch)
    with pytest.raises(ValueError):
        V.layout_of(spark, path, version=9)
