"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeline_lake.session import cut_lineage

MOST_ROUNDS = 100


def _smallest(edges: DataFrame, source: str, other: str) -> DataFrame:
    """For each ``source`` the least node among itself and its ``other`` ends; added up before the shuffle."""
    least = edges.groupBy(source).agg(F.min(other).alias("m"))
    return least.withColumn("m", F.least("m", source))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node it knows."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both, "u", "v")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them. Edges run from the larger to the smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that can be reached) for every node on an edge ``a``–``b``.

    Edges may point either way, repeat and lead from a node to itself (such say nothing). Each round is two joins on a
    node, whose hot keys adaptive execution splits, and is written to the shared checkpoint folder; rounds end when no
    edge changes. Their number grows with the logarithm of the longest path; only counts and hashes reach the driver.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = cut_lineage(pairs)
    before = None
    for _ in range(MOST_ROUNDS):
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                current.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        before = state
        current = cut_lineage(_small_star(_large_star(current).distinct()).distinct())
    raise RuntimeError("components did not settle")
