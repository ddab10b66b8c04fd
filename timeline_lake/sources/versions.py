"""Keyed tables on shared storage, kept as versions: a merge reads and writes only what its keys can touch.

A table's rows are dealt into buckets by a hash of its key columns, one folder per bucket, sorted by key, with Parquet Bloom
filters on the key columns. A merge finds the buckets of its batch, reads those, and writes their next contents beside the
old ones; a manifest then names, per bucket, the version that holds it. Nothing is overwritten, so a job that fails halfway
leaves the last version as it was, readers keep what they have opened, and any earlier version can be read again.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

BUCKETS = 64
BUCKET = "_bucket"
VERSION = "_version"
_MANIFEST = "version int, bucket int, written int, layout string"


@dataclass(frozen=True)
class Layout:
    """What a manifest says: the current version, where each bucket with rows lies, and how rows are dealt."""

    version: int
    written: dict[int, int]
    keys: list[str]
    order: list[str]
    buckets: int
    schema: StructType

    def bucket(self, *values: Column) -> Column:
        return _bucket(self.buckets, *(values or map(F.col, self.keys)))


def _bucket(buckets: int, *values: Column) -> Column:
    return F.pmod(F.xxhash64(*values), F.lit(buckets)).cast("int")


def create(df: DataFrame, folder: str, keys: list[str], order: list[str] | None = None, buckets: int = BUCKETS) -> None:
    """Write version 0. ``order`` (default: the keys) sorts the rows of a bucket; ``buckets`` stays as it is for good.

    A bucket should be a few hundred megabytes: a table of 10 TB has tens of thousands, and the driver one row for each.
    """
    schema = df.schema
    _write(df, folder, Layout(-1, {}, keys, order or keys, buckets, schema))


def layout_of(spark: SparkSession, folder: str, version: int | None = None) -> Layout:
    """The manifest of a version, by default the last one."""
    manifests = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest/*")
    wanted = manifests.agg(F.max("version")).first()[0] if version is None else version
    rows = manifests.filter(F.col("version") == wanted).collect()  # one row per bucket
    if not rows:
        raise ValueError(f"{folder} has no version {wanted}")
    said = json.loads(rows[0]["layout"])
    written = {r["bucket"]: r["written"] for r in rows if r["bucket"] is not None}
    return Layout(wanted, written, said["keys"], said["order"], said["buckets"], StructType.fromJson(said["schema"]))


def _open(spark: SparkSession, folder: str, layout: Layout, wanted: list[int] | None = None) -> DataFrame:
    paths = [f"{folder}/data/{VERSION}={v}/{BUCKET}={b}" for b, v in sorted(layout.written.items()) if wanted is None or b in wanted]
    if not paths:
        return spark.createDataFrame([], layout.schema)
    placed = StructType(list(layout.schema)).add(VERSION, IntegerType()).add(BUCKET, IntegerType())
    return spark.read.schema(placed).option("basePath", f"{folder}/data").parquet(*paths)


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """All rows of a version, by default the last one."""
    return _open(spark, folder, layout_of(spark, folder, version)).drop(VERSION, BUCKET)


def lookup(spark: SparkSession, folder: str, **values: object) -> DataFrame:
    """Rows with these values in these columns.

    With all key columns given only one bucket is read; in a file, row groups whose statistics or Bloom filters exclude the
    values are skipped.
    """
    layout = layout_of(spark, folder)
    rows = _open(spark, folder, layout)
    if BUCKET in rows.columns and set(layout.keys) <= set(values):
        kinds = {f.name: f.dataType for f in layout.schema}
        rows = rows.filter(F.col(BUCKET) == layout.bucket(*(F.lit(values[k]).cast(kinds[k]) for k in layout.keys)))
    for name, value in values.items():
        rows = rows.filter(F.col(name) == F.lit(value))
    return rows.drop(VERSION, BUCKET)


def lookup_many(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Rows whose keys are in ``wanted`` (the key columns); only the buckets of those keys are read."""
    layout = layout_of(spark, folder)
    rows = _open(spark, folder, layout, _touched(wanted, layout))
    return rows.drop(VERSION, BUCKET).join(wanted.select(*layout.keys).distinct(), layout.keys, "left_semi")


def _touched(batch: DataFrame, layout: Layout) -> list[int]:
    return [r[0] for r in batch.select(layout.bucket()).distinct().collect()]  # at most one row per bucket


def merge(spark: SparkSession, folder: str, batch: DataFrame, apply: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Write the next version and return the buckets that were read and written.

    ``apply`` is given the current rows of the buckets that ``batch`` (with the key columns) falls into and returns what they
    shall hold; it may add, change and drop rows of the batch's keys, not of other ones.
    """
    layout = layout_of(spark, folder)
    touched = _touched(batch, layout)
    changed = apply(_open(spark, folder, layout, touched).drop(VERSION, BUCKET))
    _write(changed.select(*layout.schema.names), folder, layout, touched)
    return touched


def _write(df: DataFrame, folder: str, old: Layout, touched: list[int] | None = None) -> None:
    spark = df.sparkSession
    version = old.version + 1
    path = f"{folder}/data/{VERSION}={version}"
    dealt = df.withColumn(BUCKET, old.bucket())
    n = min(old.buckets if touched is None else max(1, len(touched)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    writer = dealt.repartition(n, BUCKET).sortWithinPartitions(BUCKET, *old.order).write.partitionBy(BUCKET).mode("error")
    for key in old.keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{key}", "true")
    writer.parquet(path)
    placed = StructType(list(old.schema)).add(BUCKET, IntegerType())
    filled = [r[0] for r in spark.read.schema(placed).parquet(path).select(BUCKET).distinct().collect()]
    written = {b: v for b, v in old.written.items() if touched is not None and b not in touched} | {b: version for b in filled}
    layout = json.dumps({"keys": old.keys, "order": old.order, "buckets": old.buckets, "schema": old.schema.jsonValue()})
    rows = [(version, None, None, layout), *((version, b, v, layout) for b, v in sorted(written.items()))]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("error").parquet(f"{folder}/manifest/{version}")
