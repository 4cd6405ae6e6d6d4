"""A candidate index for dense search: documents in cells around centroids.

Centroids come from a bounded sample; every document is put into the cell of its nearest centroid and stored in blocks, in order of cells, so
that a search reads the files of the cells it probes. A cell's radius, the largest angle of a member to the centroid, bounds the
similarity of a question to all its members, so the search can stop after the nearest cells (fast, not exact) or go on to the cells that can
still hold one of the k best (exact, the default).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions.ranking import top_k
from ragspark.functions.sizing import broadcast_if_small, fits, settled
from ragspark.operators.dense import DOC_ROWS, QUERY_ROWS, met_blocks, unit_rows, vector_blocks, vector_groups

SAMPLE_ROWS = 65_536  # vectors the centroids are fitted on, the first by a hash of their id
ROUNDS = 10
OUTSIDE = -1  # the cell of vectors without direction, or of another length than the centroids: similarity 0 to all


def spherical_means(vectors: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors. An empty cell moves to the vector farthest from its centroid."""
    centroids = vectors[:cells].copy()
    for _ in range(rounds):
        near, cosine = nearest(vectors, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, vectors)
        empty = np.flatnonzero(np.bincount(near, minlength=len(centroids)) == 0)
        sums[empty] = vectors[np.argsort(cosine, kind="stable")[:len(empty)]]
        moved = unit_rows(sums)
        moved[~moved.any(axis=1)] = centroids[~moved.any(axis=1)]
        if np.abs(moved - centroids).max() < 1e-6:
            break
        centroids = moved
    return centroids


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, best = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    for first in range(0, len(vectors), DOC_ROWS):
        scores = vectors[first:first + DOC_ROWS] @ centroids.T
        at[first:first + DOC_ROWS] = scores.argmax(axis=1)
        best[first:first + DOC_ROWS] = scores.max(axis=1)
    return at, best


def fit_centroids(docs: DataFrame, cells: int, sample: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of the most frequent vector length, from at most `sample` vectors with a direction."""
    some = docs.where(F.exists("embedding", lambda x: x != 0)).withColumn("_width", F.size("embedding"))
    common = some.groupBy("_width").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("_width")).first()
    if common is None:
        return np.zeros((0, 0))
    rows = some.where(F.col("_width") == common["_width"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("embedding").toPandas()
    vectors = unit_rows(np.stack(rows["embedding"].to_numpy()).astype("float64"))
    return spherical_means(np.unique(vectors, axis=0)[np.random.default_rng(1).permutation(len(np.unique(vectors, axis=0)))], cells, rounds)


def _assigned(shared):
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for rows in batches:
            for width, ids, matrix in vector_groups(rows):
                unit = unit_rows(matrix)
                cell, cosine = np.full(len(ids), OUTSIDE), np.ones(len(ids))
                if len(centroids) and width == centroids.shape[1]:
                    near, best = nearest(unit, centroids)
                    some = unit.any(axis=1)
                    cell, cosine = np.where(some, near, OUTSIDE), np.where(some, best, 1.0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * width, pa.int32()), pa.array(matrix.ravel()))
                yield pa.RecordBatch.from_arrays([ids, lists, pa.array(cell, pa.int32()), pa.array(cosine)], names=["doc_id", "embedding", "cell", "cosine"])

    return assigned


@dataclass(frozen=True)
class CellIndex:
    """blocks (lane = cell, width, ids, x), sizes (cell, cosine: the least of its members with the centroid, n) and the centroids."""

    blocks: DataFrame
    sizes: DataFrame
    centroids: np.ndarray

    @staticmethod
    def build(docs: DataFrame, path: str, cells: int = 256, sample: int = SAMPLE_ROWS) -> CellIndex:
        """Store the index of docs (doc_id, embedding) below `path` and return it as read back.

        Cells are laid out in order, a cell of many documents over several files.
        """
        spark = docs.sparkSession
        centroids = fit_centroids(docs, cells, sample)
        kind = docs.schema["doc_id"].dataType.simpleString()
        rows = docs.where("embedding IS NOT NULL").select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"))
        placed = rows.mapInArrow(_assigned(spark.sparkContext.broadcast(centroids)), f"doc_id {kind}, embedding array<double>, cell int, cosine double")
        placed = settled(placed.repartitionByRange("cell", F.xxhash64("doc_id")).sortWithinPartitions("cell"))
        vector_blocks(placed, "doc_id", DOC_ROWS, "cell").write.mode("overwrite").parquet(f"{path}/blocks")
        sizes = placed.groupBy("cell").agg(F.min("cosine").alias("cosine"), F.count(F.lit(1)).alias("n"))
        sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")  # a row per cell
        listed = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        return CellIndex.load(spark, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> CellIndex:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
        return CellIndex(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/sizes"),
                         np.array([r["centroid"] for r in rows]) if rows else np.zeros((0, 0)))


def _probes(shared, probes: int, later: bool):
    """Of each query (query_id, embedding[, low]) the `probes` nearest cells, or the others that may hold a similarity of `low`."""
    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, cells, radius = shared.value
        for rows in batches:
            ids, lists = rows.column(0), rows.column(1)
            for n, vector in enumerate(lists):
                values = np.asarray(vector.values.to_numpy(zero_copy_only=False), dtype=np.float64)
                length = np.sqrt(values @ values)
                bound = np.zeros(len(cells))
                inside = cells != OUTSIDE
                if length > 0 and len(centroids) and len(values) == centroids.shape[1]:
                    angle = np.arccos(np.clip(centroids[cells[inside]] @ values / length, -1, 1))
                    bound[inside] = np.cos(np.clip(angle - radius[inside], 0, np.pi))
                    apart = np.full(len(cells), np.inf)
                    apart[inside] = angle
                    order = np.argsort(apart, kind="stable")
                else:
                    order = np.argsort(cells, kind="stable")
                if later:
                    low = rows.column(2)[n].as_py()
                    order = order[probes:]
                    order = order if low is None else order[bound[order] >= low - 2e-6]
                else:
                    order = order[:probes]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([n] * len(order), pa.int64())), lists.take(pa.array([n] * len(order), pa.int64())), pa.array(cells[order], pa.int32())],
                    names=["query_id", "embedding", "lane"])

    return chosen


def cells_topk(queries: DataFrame, index: CellIndex, k: int = 5, probes: int = 8, exact: bool = True) -> DataFrame:
    """(query_id, doc_id, score, rank): the k most similar documents, as `dense_topk` ranks them.

    The `probes` nearest cells are searched first. If `exact`, the cells whose radius lets them hold a document as similar as the k-th found
    follow; else the result may miss documents of other cells.
    """
    spark = queries.sparkSession
    sizes = index.sizes.orderBy("cell").collect()  # a row per cell, a number set when the index is built
    cells = np.array([r["cell"] for r in sizes], dtype=np.int64)
    radius = np.arccos(np.clip([r["cosine"] for r in sizes], -1, 1)) + 1e-7
    shared = spark.sparkContext.broadcast((index.centroids, cells, radius))
    query_type, doc_type = queries.schema["query_id"].dataType, index.blocks.schema["ids"].dataType.elementType
    asked = settled(queries.where("embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<double>").alias("embedding")))
    schema = f"query_id {query_type.simpleString()}, embedding array<double>, lane int"

    def searched(wanted: DataFrame) -> DataFrame:
        wanted = settled(wanted)
        small = fits(wanted, 1_000_000)
        lanes = [r["lane"] for r in wanted.select("lane").distinct().collect()]  # at most the number of cells
        held = index.blocks.where(F.col("lane").isin(lanes)) if len(lanes) < len(cells) else index.blocks
        packed = vector_blocks(wanted.repartitionByRange("lane", "query_id").sortWithinPartitions("lane"), "query_id", QUERY_ROWS, "lane")
        found = met_blocks(packed, held, small, k, None, query_type, doc_type).withColumnRenamed("similarity", "score")
        return top_k(found, ["query_id"], [F.desc("score"), F.asc("doc_id")], k).drop("rank")

    best = searched(asked.mapInArrow(_probes(shared, probes, False), schema))
    if exact:
        best = settled(best)
        low = best.groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k).drop("_n")
        more = asked.join(broadcast_if_small(settled(low)), "query_id", "left").select("query_id", "embedding", "low")
        best = best.unionByName(searched(more.mapInArrow(_probes(shared, probes, True), schema)))
    return top_k(best, ["query_id"], [F.desc("score"), F.asc("doc_id")], k).select("query_id", "doc_id", "score", F.col("rank").cast("long"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact (query_id, doc_id) rows that were found."""
    total = exact.count()
    return exact.join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").count() / total if total else 1.0
