"""Exact duplicates: 128-bit content hashes, confirmed byte for byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeline_lake.llm.shared import given
from timeline_lake.session import cut_lineage


def content_hash(text: Column) -> Column:
    """128 bits of MD5."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_duplicates(docs: DataFrame, keep: str = "smallest", digest=content_hash) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, …): doc_id, keep_id, group_size, kept, text_sha256.

    A group is all rows with the same hash and the same bytes; a null text counts as an empty one. The row with the
    ``keep`` ("smallest" or "largest") id stays; rows with a null id stay only if their group has no other, and equal
    rows (same id and text) stay together. Grouping by (hash, text) compares whole texts inside each hash, and Spark
    adds up copies before it shuffles, so a text with very many copies is one row per task. The rows themselves travel
    without their texts; texts that share a hash but not their bytes are matched by text in a second step.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("_text")).withColumn("_hash", digest(F.col("_text")))
    variants = rows.groupBy("_hash", "_text").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    sums = ["keep_id", "group_size", "text_sha256"]
    table = cut_lineage(variants.select("_hash", "keep_id", "group_size", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256")))
    clashing = table.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_hash")
    clean = rows.select("doc_id", "_hash").join(table, "_hash")
    if not clashing.isEmpty():
        # Two texts with one hash: their rows meet by hash and bytes.
        clean = clean.join(clashing, "_hash", "left_anti")
        met = rows.join(clashing, "_hash", "left_semi")
        by_text = met.groupBy("_hash", "_text").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        by_text = by_text.withColumn("text_sha256", F.sha2(F.col("_text").cast("binary"), 256))
        clean = clean.select("doc_id", *sums).unionByName(met.join(by_text, ["_hash", "_text"]).select("doc_id", *sums))
    return clean.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_duplicates(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, all columns. Rows with a null id, which nothing can refer to, all stay."""
    kept = exact_duplicates(docs, keep).filter("kept or doc_id is null").select(F.col("doc_id").alias("_id"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(given(spark, folder, "documents"), keep="largest")


OP10_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""
