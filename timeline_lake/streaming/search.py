"""Keeping the search index current from a stream of changed documents.

Each micro-batch appends its documents under its batch number, a row with all postings for each, and notes which documents it
touched; nothing is rewritten. A document's valid postings are those of its latest batch, which is decided for its row as a whole:
postings are taken out of the rows after that. `compact` folds the parts into one, sorted by term, when they become many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeline_lake.plans.search import KEYS, by_document, posting_lists
from timeline_lake.streaming.runs import run_batches

# A folded part has a term, tf and positions in each row; a batch has lists of them, terms joined by spaces, in the same order.
POSTINGS = (
    "term string, project_slug string, source_slug string, tf bigint, positions array<bigint>, "
    "terms string, tfs array<int>, places array<array<bigint>>, batch bigint"
)
TOUCHED = "project_slug string, source_slug string, batch bigint"


def follow(documents: DataFrame, folder: str, checkpoint: str, stemmed: bool = True) -> None:
    """`documents`: keys, full_text (null: deleted), changed_at. Takes what is available, then stops."""

    def apply(batch: DataFrame, number: int) -> None:
        # Dealt before they are grouped, texts are sorted once.
        latest = by_document(batch).groupBy(*KEYS).agg(F.max_by(F.struct("full_text"), "changed_at").alias("_d")).select(*KEYS, "_d.full_text")
        present = latest.filter(F.col("full_text").isNotNull())
        # Writing to the batch's own folder makes a repeated batch harmless.
        posting_lists(present, stemmed).write.mode("overwrite").parquet(f"{folder}/postings/batch={number}")
        batch.select(*KEYS).distinct().write.mode("overwrite").parquet(f"{folder}/touched/batch={number}")

    run_batches(documents, apply, checkpoint)


def current_index(spark: SparkSession, folder: str) -> DataFrame:
    """The valid postings: those of each document's latest batch."""
    touched = spark.read.schema(TOUCHED).parquet(f"{folder}/touched")
    latest = touched.groupBy(*KEYS).agg(F.max("batch").alias("batch"))
    stored = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
    folded = stored.filter(F.col("term").isNotNull()).join(latest, [*KEYS, "batch"], "left_semi")
    listed = stored.filter(F.col("terms") != "").join(latest, [*KEYS, "batch"], "left_semi")
    nth = listed.select(*KEYS, "tfs", "places", F.posexplode(F.split("terms", " ")).alias("_nth", "term"))
    postings = nth.select("term", *KEYS, F.col("tfs")[F.col("_nth")].cast("long").alias("tf"), F.col("places")[F.col("_nth")].alias("positions"))
    return folded.select(*postings.columns).unionByName(postings)


def compact(spark: SparkSession, folder: str, target: str) -> None:
    index = current_index(spark, folder)
    index.repartitionByRange("term", *KEYS).sortWithinPartitions("term", *KEYS).write.mode("error").parquet(f"{target}/postings/batch=0")
    index.select(*KEYS).distinct().write.mode("error").parquet(f"{target}/touched/batch=0")
