"""A corpus pipeline of five stages, each reading what the one before it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timeline_lake.llm import exact_dedup, near_dedup, packing, quality_rank, quality_rules
from timeline_lake.llm.shared import given
from timeline_lake.llm.tokens import BYTE_BPE_JSON, vocabulary
from timeline_lake.session import cut_lineage


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and resemble trusted text."""
    return quality_rules.keep_good(docs)


def ranking_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the preference ranking accepts.

    It is learned on the labelled ones of all given documents: those that the rules have left may show one label only. The
    cut is a quantile of the scores of those that are left.
    """
    model = quality_rank.fitted(spark, given(spark, sf_dir, "documents"), sf_dir)
    return quality_rank.keep_accepted(docs, model, quality_rank.usable_labels(spark, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id."""
    return exact_dedup.without_duplicates(docs, keep="largest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity, the one with the smallest doc_id."""
    return near_dedup.without_near_duplicates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their sequences and offsets."""
    return packing.pack(cut_lineage(packing.pieces(docs, vocabulary(BYTE_BPE_JSON))))


STAGES = [
    ("quality_rules", rules_stage),
    ("quality_classifier", ranking_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]

#: Learned models, hashed counts and packing have no counterpart in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
