"""Connected components by alternating large-star and small-star steps, with rows and no lists of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.tables import settle

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _to_minimum(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: neighbours above a node are linked to its smallest neighbour. Small star: the node and those below it are."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = near.join(low, "u")
    if large:
        linked = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge (u, v); the component is named by its smallest node.

    Each round halves the depth of what is not a star yet, so the number of rounds grows with the logarithm of the
    longest path. A hub is a key of joins only, which adaptive execution splits; its minimum is aggregated on the map side.
    """
    now = settle(edges.where("u <> v").select("u", "v").distinct())
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        now = settle(_to_minimum(_to_minimum(now, large=True), large=False))
        before, state = state, _state(now)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
