"""Ranks inside groups.

Scores are rounded before they are ranked: Spark does not fix the order in which doubles are summed, so
two mathematically equal scores may differ in the last bits. Rounding makes the tie-break by id decide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECIMALS = 6


def row_rank(groups: Sequence[str], order: Sequence[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*groups).orderBy(*order))


def top_k(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of every group. Spark prunes to k rows per group and task before the shuffle."""
    return df.withColumn(rank, row_rank(groups, order)).where(F.col(rank) <= k)


def rank_rows(df: DataFrame, groups: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """One-based rank of every row inside its group, without sending a whole group to one task.

    The rows are range-partitioned on (groups, order), so a group that holds much of the table is spread
    over many tasks. Positions are made global by adding the row counts of the earlier partitions, and the
    first position of a group is subtracted. That position comes back per (partition, group), so the rows of a hot group
    stay apart in this join too. The sorted rows are checkpointed: range bounds are sampled,
    so partition numbers may not be computed twice.
    """
    from ragspark.session import checkpoint_root

    spark = df.sparkSession
    checkpoint_root(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g).asc() for g in groups] + list(order)
    placed = (
        df.repartitionByRange(partitions, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .checkpoint()
        .withColumn("_part", F.shiftright("_at", 33))
    )
    # One row per partition, so the running total over it stays tiny.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    offsets = sizes.select(
        "_part",
        "_first",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    positioned = placed.join(F.broadcast(offsets), "_part").withColumn(
        "_pos", F.col("_before") + F.col("_at") - F.col("_first")
    )
    pieces = positioned.groupBy("_part", *groups).agg(F.min("_pos").alias("_from"))  # a group has at most one per partition
    starts = pieces.withColumn("_start", F.min("_from").over(Window.partitionBy(*groups))).drop("_from")
    return (
        positioned.join(starts, ["_part", *groups])
        .withColumn(rank, (F.col("_pos") - F.col("_start") + 1).cast("long"))
        .drop("_at", "_part", "_first", "_before", "_pos", "_start")
    )
