"""Labelled rows a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, modulus: int) -> Column:
    """CRC-32 of the id as text, modulo ``modulus``: the fold of a document. Null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def clear_labels(labels: DataFrame, column: str, modulus: int, left_out: int) -> DataFrame:
    """One row (doc_id, label) per document with a clear label that is not of the left-out fold.

    Several labels of one document count by majority; even votes, null labels and null ids give no row.
    """
    votes = labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col(column)).alias("_share"))
    clear = votes.filter((F.col("_share") != 0.5) & (remainder("doc_id", modulus) != left_out))
    return clear.select("doc_id", (F.col("_share") > 0.5).cast("int").alias("label"))


def label_sample(labels: DataFrame, column: str, modulus: int, left_out: int, limit: int) -> DataFrame:
    """At most ``limit`` of the clear labels (doc_id, label), the ones whose ids hash lowest."""
    return clear_labels(labels, column, modulus, left_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
