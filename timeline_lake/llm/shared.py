"""What several operators here need: the given tables, and binary files written by Spark's own writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeline_lake.session import checkpoint_folder


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own under the shared checkpoint folder, for files that a query writes and reads back."""
    return f"{checkpoint_folder(spark)}/{kind}/{uuid.uuid4().hex}"


def write_blobs(df: DataFrame, column: str, path: str, rows_per_file: int = 0) -> None:
    """Write a column of byte strings back to back into binary files, one per task, in the order of its rows.

    Every byte string must end with a zero byte: Spark's text writer puts exactly that byte after each row, on any file
    system Spark can write to and with its commit protocol, so that a lost or repeated task leaves no partial file.
    """
    rows = df.select(F.expr(f"substring({column}, 1, octet_length({column}) - 1)").cast("string").alias("value"))
    rows.write.option("lineSep", "\u0000").option("maxRecordsPerFile", rows_per_file).text(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """The files below ``path``, whole, one per row: path, content."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
