"""Connected components by alternating large-star and small-star steps.

Each step is an aggregate and a join on a node; a node with many neighbours meets its minimum through the aggregate
(combined map-side) and a join that adaptive execution may split, never in one group. Steps end when the sum over
all edges of their hashes stays as it is, after a number of rounds that grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def labelled(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the least node of its component. Columns of any ordered type."""
    one = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state, before = stored(one, "edges"), None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above u point to the least of u's neighbourhood.
        large = _least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        # Small star: u and its lower neighbours point to the least of them.
        lower = _least(large)
        small = lower.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lower.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        state = stored(small, "edges")
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    labels = state.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
