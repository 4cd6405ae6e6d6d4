"""Sharding by Karmarkar-Karp differencing, level by level.

Documents of equal text are one indivisible group. Groups are dealt into buckets of bounded size by a hash; each bucket is
partitioned by differencing into bundles, the bundles of many buckets are the items of the next level, and the last
level partitions what is left into the shards. Differencing holds partial partitions by spread (largest sum minus
smallest) and again and again combines the two of largest spread, oppositely ordered.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.tables import numbered, settle, small_side

BUCKET_ITEMS = 20_000  # items a task partitions at once
BUNDLES = 256  # what a bucket becomes
LAST_ITEMS = 20_000  # items of the last level, at most
NUMBER_ROWS = 50_000  # rows numbered by one task


def differencing(sizes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each item, by the differencing method; deterministic, ties by position.

    An item of at least the mean of the parts still open gets a part of its own first: beside it, differencing would
    level the other parts against it and not among each other.
    """
    alone = np.full(len(sizes), -1, dtype=np.int64)
    total, taken = int(sizes.sum()), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        if taken + 1 >= parts or int(sizes[i]) * (parts - taken) < total:
            break
        alone[i], taken, total = taken, taken + 1, total - int(sizes[i])
    rest = alone < 0
    alone[rest] = taken + _differenced(sizes[rest], parts - taken)
    return alone


def _differenced(sizes: np.ndarray, parts: int) -> np.ndarray:
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int64)
    # A partial partition keeps its positive sums in descending order, and which child each of its slots came from.
    sums: list = [np.array([s], dtype=np.int64) for s in sizes.tolist()]
    made: list = [None] * n
    heap = [(-int(s), i) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        x, y = sums[a], sums[b]
        # Slot k of the one meets slot parts-1-k of the other; slots beyond the stored sums are empty.
        at_x, at_y = np.arange(len(x)), parts - 1 - np.arange(len(y))
        slots = np.union1d(at_x, at_y) if len(x) + len(y) <= parts else np.arange(parts)
        total = np.zeros(parts, dtype=np.int64)
        total[at_x] = x
        total[at_y] += y
        order = slots[np.argsort(-total[slots], kind="stable")]
        sums[a] = sums[b] = None
        sums.append(total[order])
        made.append((a, b, order))
        spread = int(total[order[0]]) - (int(total[order[-1]]) if len(order) == parts else 0)
        heapq.heappush(heap, (-spread, len(sums) - 1))
    # Top down: slot k of a partition is part place[k]; slots without a sum keep some part too, for the items of size 0.
    place: list = [None] * len(sums)
    place[-1] = np.arange(parts)
    for node in range(len(sums) - 1, n - 1, -1):
        a, b, order = made[node]
        mine, place[node] = place[node], None
        rest = np.setdiff1d(np.arange(parts), order, assume_unique=True)
        by_slot = np.empty(parts, dtype=np.int64)
        by_slot[order] = mine[:len(order)]
        by_slot[rest] = mine[len(order):]
        place[a], place[b] = by_slot, by_slot[::-1]
    return np.array([p[0] for p in place[:n]], dtype=np.int64)


def _level(items: DataFrame, buckets: int, parts: int) -> DataFrame:
    """item, bytes, bucket, part: the items partitioned inside their buckets."""
    def partition(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "item"], ascending=[False, True], kind="stable")
        return rows.assign(part=differencing(rows["bytes"].to_numpy(), parts).astype("int32"))

    return (items.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)).cast("int"))
            .groupBy("bucket").applyInPandas(partition, "item string, bytes long, bucket int, part int"))


def balanced_parts(items: DataFrame, parts: int) -> DataFrame:
    """item, part: (item string, bytes long) partitioned into `parts` of near equal bytes."""
    now = settle(items.select("item", "bytes"))
    levels = []
    while (n := now.count()) > LAST_ITEMS:
        buckets = -(-n // BUCKET_ITEMS)
        level = settle(_level(now, buckets, BUNDLES).withColumn("above", F.concat_ws(".", "bucket", "part")))
        levels.append(level)
        now = settle(level.groupBy("above").agg(F.sum("bytes").alias("bytes")).select(F.col("above").alias("item"), "bytes"))
    placed = _level(now, 1, parts).select("item", "part")
    for level in reversed(levels):
        placed = level.select("item", "above").join(small_side(placed.withColumnRenamed("item", "above")), "above").select("item", "part")
    return placed


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of (doc_id, text).

    The law is `bytes`: sizes of the shards are as near equal as indivisible groups of equal texts allow. size is the UTF-8
    bytes of the text plus `overhead`. A null text has no bytes, crc 0, and is a group of its own kind; empty texts are
    another. Repeated rows and null doc_ids are rows like any other. A group larger than a shard's share has its shard
    (almost) to itself. slot numbers the rows of a shard from 0 without gap; grown_shard is null under this law.
    Other columns are not read. An empty table gives an empty result.
    """
    rows = settle(docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null")).alias("item")))
    groups = rows.groupBy("item").agg(F.sum("size").alias("bytes"))
    placed = rows.join(small_side(balanced_parts(groups, shards)), "item").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("part").alias("shard"))
    buckets = max(1, rows.count() // NUMBER_ROWS)
    slots = numbered(placed, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")],
                     F.pmod(F.xxhash64("doc_id"), F.lit(buckets)), "slot")
    return slots.withColumn("grown_shard", F.lit(None).cast("int"))
