"""Reading and running streams until what is there has been taken."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timeline_lake.session import checkpoint_folder

#: The store that keyed state with timers and lifetimes needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def json_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000, archive: str | None = None) -> DataFrame:
    """JSON lines of the files that arrive in ``folder``, with ``_corrupt_record`` for lines that are no such object."""
    reader = spark.readStream.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.json(folder)


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything available to parquet files, exactly once, then stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(
        availableNow=True
    ).start().awaitTermination()


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append").trigger(
        availableNow=True
    ).start().awaitTermination()


def collect_stream(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream to a table in the shared folder and return that table."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    run_to_table(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
