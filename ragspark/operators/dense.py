"""Dense retrieval: exact, in blocks.

Queries and documents are packed into rows that hold a block of vectors each, and blocks meet in a join on Spark; a task multiplies two
blocks at a time and keeps what was asked for, the k best rows per query or the rows above a floor. Query blocks of checked size are
broadcast, so documents are read once and not shuffled. Beyond that size both sides are dealt out to a grid: a cell joins a part of the query blocks
with a lane of the document blocks, so that documents are still read once, however many queries there are. Neither vectors nor ids pass
through the driver.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.functions.ranking import DECIMALS, top_k
from ragspark.functions.sizing import MAX_BYTES, fits, settled
from ragspark.functions.vectors import cosine, norm

QUERY_ROWS, DOC_ROWS = 1_024, 4_096  # vectors of a block; a task holds the scores of one such tile at once
BLOCK_BYTES = 4 << 20  # of one block's vectors: longer vectors make blocks of fewer rows
FLOORS_KEPT = 256  # query blocks whose best scores a task remembers


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    return np.divide(matrix, norms[:, None], out=np.zeros_like(matrix), where=norms[:, None] > 0)


def vector_groups(rows: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(width, ids, matrix) for each vector length of a batch (id, embedding)."""
    sizes = np.asarray(rows.column(1).value_lengths())
    for width in np.unique(sizes).tolist():
        at = pa.array(np.flatnonzero(sizes == width))
        values = rows.column(1).take(at).flatten().to_numpy(zero_copy_only=False)
        yield width, rows.column(0).take(at), values.astype(np.float64).reshape(len(at), width)


def _lane_runs(rows: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A batch (id, embedding[, lane]) in runs of one lane."""
    if rows.num_columns < 3:
        yield 0, rows
        return
    lanes = rows.column(2).to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(lanes)) + 1).tolist(), len(lanes)]
    for first, end in zip(edges[:-1], edges[1:], strict=True):
        if end > first:
            yield int(lanes[first]), rows.slice(first, end - first)


def _packer(most: int):
    """Blocks of unit vectors of one lane and one length, ids ascending inside a block."""
    def packed(lane: int, width: int, ids: pa.Array, matrix: np.ndarray) -> pa.RecordBatch:
        order = pc.sort_indices(ids)
        held = ids.take(order)
        return pa.RecordBatch.from_arrays(
            [pa.array([lane], pa.int32()), pa.array([width], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held),
             pa.array([unit_rows(matrix[order.to_numpy()]).tobytes()], pa.binary())], names=["lane", "width", "ids", "x"])

    def rest(lane: int, held: dict[int, tuple[list, list]]) -> Iterator[pa.RecordBatch]:
        for width, (ids, matrix) in held.items():
            if sum(map(len, ids)):
                yield packed(lane, width, pa.concat_arrays(ids), np.concatenate(matrix))
        held.clear()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        current = 0
        for batch in batches:
            for lane, rows in _lane_runs(batch):
                if lane != current:
                    yield from rest(current, held)
                    current = lane
                for width, ids, matrix in vector_groups(rows):
                    parts = held.setdefault(width, ([], []))
                    parts[0].append(ids)
                    parts[1].append(matrix)
                    size = max(1, min(most, BLOCK_BYTES // (8 * max(width, 1))))
                    if sum(map(len, parts[0])) >= size:
                        ids, matrix = pa.concat_arrays(parts[0]), np.concatenate(parts[1])
                        full = len(ids) // size * size
                        for at in range(0, full, size):
                            yield packed(lane, width, ids[at:at + size], matrix[at:at + size])
                        held[width] = ([ids[full:]], [matrix[full:]])
        yield from rest(current, held)

    return blocks


def vector_blocks(vectors: DataFrame, key: str, most: int, lane: str | None = None) -> DataFrame:
    """lane, width, ids, x: packed unit vectors; rows without a vector are left out. Rows should come in order of `lane`, an int; without it, it is 0."""
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.where("embedding IS NOT NULL").select(key, F.col("embedding").cast("array<double>").alias("embedding"), *([lane] if lane else []))
    return rows.mapInArrow(_packer(most), f"lane int, width int, ids array<{kind}>, x binary")


def _first_of_ties(scores: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k best of each row; of equal scores at the edge the first."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, dtype=bool)
    edge = np.partition(scores, -k, axis=1)[:, -k][:, None]
    above, equal = scores > edge, scores == edge
    return above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1)[:, None]))


class _Floors:
    """The k best scores so far of each query, for the query blocks met last."""

    def __init__(self, k: int):
        self.k, self.best = k, OrderedDict()

    def least(self, block: int, rows: int) -> np.ndarray:
        held = self.best.get(block)
        return np.full(rows, -np.inf) if held is None or held.shape[1] < self.k else held.min(axis=1)

    def add(self, block: int, scores: np.ndarray) -> None:
        held = self.best.pop(block, np.zeros((len(scores), 0)))
        held = np.concatenate([held, scores], axis=1)
        if held.shape[1] > self.k:
            held = np.partition(held, -self.k, axis=1)[:, -self.k:]
        self.best[block] = held
        if len(self.best) > FLOORS_KEPT:
            self.best.popitem(last=False)


def _met(k: int | None, floor: float | None, names: tuple[str, str]):
    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = _Floors(k) if k is not None else None
        for rows in batches:
            q_width, d_width, block = (rows.column(c).to_pylist() for c in ("q_width", "d_width", "q_block"))
            for n in range(rows.num_rows):
                q_ids, d_ids = rows.column("q_ids")[n].values, rows.column("d_ids")[n].values
                if q_width[n] == d_width[n]:
                    q = np.frombuffer(rows.column("q")[n].as_buffer()).reshape(len(q_ids), q_width[n])
                    d = np.frombuffer(rows.column("d")[n].as_buffer()).reshape(len(d_ids), d_width[n])
                    scores = np.round(q @ d.T, DECIMALS) + 0.0
                else:
                    scores = np.zeros((len(q_ids), len(d_ids)))  # vectors of other lengths have similarity 0
                wanted = np.ones(scores.shape, dtype=bool) if floor is None else scores >= floor
                if floors is not None:
                    wanted &= scores >= floors.least(block[n], len(q_ids))[:, None]  # equal scores may win by their id
                    some = np.flatnonzero(wanted.any(axis=1))
                    wanted[some] &= _first_of_ties(scores[some], k)
                    best = np.where(wanted, scores, -np.inf)
                    floors.add(block[n], np.partition(best, -k, axis=1)[:, -k:] if best.shape[1] > k else best)
                at, to = np.nonzero(wanted)
                if len(at):
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(at)), d_ids.take(pa.array(to)), pa.array(scores[at, to])],
                                                     names=[*names, "similarity"])

    return multiplied


def _grid(queries: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cells of a grid as `lane`.

    Copies are fewest when the sides of a cell hold alike many blocks; a part of the queries, which a task buffers, stays below the bound.
    """
    queries, docs = settled(queries.withColumn("_key", F.monotonically_increasing_id())), settled(docs.withColumn("_key", F.monotonically_increasing_id()))
    asked = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("x")), F.lit(0)).alias("b")).first()
    n_docs = docs.count()
    cells = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-int(asked["b"]) // MAX_BYTES), round(math.sqrt(cells * asked["n"] / max(n_docs, 1))))
    lanes = max(1, min(n_docs, -(-cells // parts)))
    spread = lambda count: F.pmod(F.xxhash64("_key"), F.lit(count)).cast("int")
    cell = F.concat_ws("/", "_part", "_lane")
    left = docs.withColumn("_lane", spread(lanes)).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = queries.withColumn("_part", spread(parts)).withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    return [side.withColumn("lane", cell).drop("_key", "_part", "_lane") for side in (right, left)]


def scored_pairs(queries: DataFrame, docs: DataFrame, k: int | None, floor: float | None) -> DataFrame:
    """(query_id, doc_id, similarity): what may be among a query's k best, or all at or above the floor."""
    asked, held = vector_blocks(queries, "query_id", QUERY_ROWS), vector_blocks(docs, "doc_id", DOC_ROWS)
    small = fits(queries, 1_000_000)
    if not small:
        asked, held = _grid(asked, held)
    return met_blocks(asked, held, small, k, floor, queries.schema["query_id"].dataType, docs.schema["doc_id"].dataType)


def met_blocks(asked: DataFrame, held: DataFrame, small: bool, k: int | None, floor: float | None, query_type: T.DataType, doc_type: T.DataType) -> DataFrame:
    """Query blocks times document blocks of the same lane; small query blocks are broadcast."""
    asked = asked.select("lane", F.monotonically_increasing_id().alias("q_block"), F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("x").alias("q"))
    held = held.select("lane", F.col("width").alias("d_width"), F.col("ids").alias("d_ids"), F.col("x").alias("d"))
    met = held.join(F.broadcast(asked) if small else asked.hint("merge"), "lane")
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("doc_id", doc_type), T.StructField("similarity", T.DoubleType())])
    return met.mapInArrow(_met(k, floor, ("query_id", "doc_id")), schema)


def dense_topk(queries: DataFrame, docs: DataFrame, k: int = 5, with_scores: bool = True) -> DataFrame:
    """(query_id, doc_id[, score], rank): the k most similar documents; ties go to the lower id.

    `queries` has (query_id, embedding), `docs` (doc_id, embedding). Filters on document metadata are
    plain `where` calls on `docs` before this call, so they reach the scan.
    """
    partial = scored_pairs(queries, docs, k, None).withColumnRenamed("similarity", "score")
    ranked = top_k(partial, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
    ranked = ranked.select("query_id", "doc_id", "score", F.col("rank").cast("long"))
    return ranked if with_scores else ranked.drop("score")


def semantic_search(queries: DataFrame, docs: DataFrame, min_similarity: float | None = None,
                    k: int | None = None) -> DataFrame:
    """(query_id, doc_id, similarity, retrieval_type) for documents at or above the floor.

    Without floor and k the result has a row per query and document by definition; give one of them for
    any query batch that grows with the data.
    """
    scored = scored_pairs(queries, docs, k, min_similarity)
    if k is not None:
        scored = top_k(scored, ["query_id"], [F.desc("similarity"), F.asc("doc_id")], k).drop("rank")
    return scored.withColumn("retrieval_type", F.lit("semantic"))


def pair_similarity(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Cosine similarity of given (left_id, right_id) pairs; nothing is paired here."""
    return (
        pairs.join(left.select(F.col("vec_id").alias("left_id"), F.col("embedding").alias("_a"), norm(F.col("embedding")).alias("_na")), "left_id")
        .join(right.select(F.col("vec_id").alias("right_id"), F.col("embedding").alias("_b"), norm(F.col("embedding")).alias("_nb")), "right_id")
        .withColumn("similarity", F.round(cosine(F.col("_a"), F.col("_b"), F.col("_na"), F.col("_nb")), DECIMALS))
        .drop("_a", "_b", "_na", "_nb")
    )
