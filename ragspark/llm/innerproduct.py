"""Exact top-k by inner product over vectors in descending order of length.

Candidates are range-sorted by norm and packed into blocks, so a block has a narrow range of norms. All vectors are rotated into the
basis of the right singular vectors (from the Gram matrix, summed over all rows), which puts most of an inner product into
its first coordinates. A first pass over the longest vectors gives each query a floor for its k-th best score; a block is sent
to a block of queries only if the product of the largest norms can still reach the floor of one of them. In a
pair of blocks the partial sum over the first coordinates plus the product of the residual lengths (Cauchy-Schwarz) bounds every
score; only what can reach the floor is multiplied out, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragspark.llm.tables import settle

BLOCK = 2048  # vectors of a candidate block
QUERIES = 512  # vectors of a query block
SAFE = float(1 << 62)  # products of lengths below it fit 64 bits


def fixed_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * x) of every component, kept within 64 bits; vectors that are null or hold null or non-finite components are left out."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * scale)
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(scaled, lambda x: F.floor(x).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
    return values.reshape(len(column), width)


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for rows in batches:
        column = rows.column(0)
        sizes = np.asarray(column.value_lengths())
        for width in np.unique(sizes).tolist():
            x = _matrix(column.filter(pa.array(sizes == width)), width).astype(np.float64)
            sums[width] = sums.get(width, 0) + x.T @ x
    for width, g in sums.items():
        at = np.arange(g.size)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(g.size, width), pa.int32()), pa.array(at, pa.int32()), pa.array(g.ravel())], names=["width", "cell", "x"])


def rotations(fixed: DataFrame) -> dict[int, np.ndarray]:
    """For each width its orthogonal basis, most of the squared length first. A width x width table each: it does not grow with the rows."""
    cells = fixed.select("v").mapInArrow(_gram, "width int, cell int, x double").groupBy("width", "cell").agg(F.sum("x").alias("x"))
    found: dict[int, np.ndarray] = {}
    for width, rows in cells.toPandas().groupby("width"):
        gram = np.zeros(width * width)
        gram[rows["cell"]] = rows["x"]
        found[int(width)] = np.linalg.eigh(gram.reshape(width, width))[1][:, ::-1]
    return found


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of one width packed into a row of up to `most` vectors."""
    def packed(width, parts_i, parts_x):
        ids, x = np.concatenate(parts_i), np.concatenate(parts_x)
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        return pa.RecordBatch.from_arrays(
            [pa.array([width], pa.int32()), pa.array([float(norms.max(initial=0))]), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())],
            names=["width", "norm", "ids", "x"])

    held: dict[int, tuple[list, list]] = {}
    for rows in batches:
        ids, column = rows.column(0).to_numpy(zero_copy_only=False), rows.column(1)
        sizes = np.asarray(column.value_lengths())
        for width in np.unique(sizes).tolist():
            mine = sizes == width
            x = _matrix(column.filter(pa.array(mine)), width)
            parts = held.setdefault(width, ([], []))
            parts[0].append(ids[mine])
            parts[1].append(x)
            while sum(map(len, parts[0])) >= most:
                i, y = np.concatenate(parts[0]), np.concatenate(parts[1])
                yield packed(width, [i[:most]], [y[:most]])
                parts = held[width] = ([i[most:]], [y[most:]])
    for width, (i, x) in held.items():
        if sum(map(len, i)):
            yield packed(width, i, x)


def _unpack(ids: bytes, x: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(x, np.int64).reshape(len(i), width)


def _products(rows: np.ndarray, vector: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products; where 64 bits might not hold them they are made of Python's integers and kept within 64 bits at the end."""
    if bound < SAFE:
        return rows @ vector
    exact = rows.astype(object) @ vector.astype(object)
    return np.array([max(-(1 << 63), min(int(x), (1 << 63) - 1)) for x in exact], dtype=np.int64)


def block_topk(q_ids, q, floors, c_ids, c, basis, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, candidate number, score) of each query's k best of a block at or above its floor, in order."""
    width = q.shape[1]
    fine = q.astype(np.float64) @ basis if width else np.zeros(q.shape)
    other = c.astype(np.float64) @ basis if width else np.zeros(c.shape)
    head = max(1, width // 4)
    residual_q = np.sqrt((fine[:, head:] ** 2).sum(axis=1))
    residual_c = np.sqrt((other[:, head:] ** 2).sum(axis=1))
    bound = fine[:, :head] @ other[:, :head].T + residual_q[:, None] * residual_c[None, :]
    lengths, longest = np.sqrt((fine ** 2).sum(axis=1)), float(np.sqrt((other ** 2).sum(axis=1)).max(initial=0))
    slack = 1 + 1e-9 * (lengths * longest)[:, None]
    found = []
    for n in range(len(q)):
        at = np.flatnonzero(bound[n] + slack[n] >= floors[n])
        at = at[c_ids[at] != q_ids[n]]
        scores = _products(c[at], q[n], lengths[n] * longest)
        if len(at) > k:
            cut = np.partition(scores, -k)[-k]
            at, scores = at[scores >= cut], scores[scores >= cut]
        best = np.lexsort((c_ids[at], -scores))[:k]
        found.append((np.full(len(best), n), at[best], scores[best]))
    return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True))


def topk_inner_product(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `queries` its k highest integer inner products with rows of `vectors`.

    Both have vec_id and embedding; components become floor(scale * x). A query's own vec_id is no candidate (nor is a repeated row of it);
    ties go to the smaller vec_id. Fewer candidates give fewer rows. Vectors that are null or hold null or non-finite
    components take no part; components and scores beyond 64 bits count as the largest of 64 bits; only vectors of equal length are compared. A vec_id that
    occurs again counts once with its largest vector. Extra columns are not read. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    fixed = settle(fixed_vectors(vectors, scale).groupBy("vec_id").agg(F.max("v").alias("v")))
    asked = fixed.join(fixed_vectors(queries, scale).select("vec_id").distinct(), "vec_id", "left_semi")
    basis = spark.sparkContext.broadcast(rotations(fixed))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = fixed.count()
    parts = max(1, -(-rows // (BLOCK * 4)))
    c_schema = "width int, norm double, ids binary, x binary"
    placed = fixed.withColumn("length", norm).repartitionByRange(parts, F.desc("length"), F.asc("vec_id"))
    placed = placed.sortWithinPartitions(F.desc("length"), F.asc("vec_id")).select("vec_id", "v")
    candidates = settle(placed.mapInArrow(lambda b: _blocks(b, BLOCK), c_schema).withColumn("block", F.monotonically_increasing_id()))
    blocks = settle(asked.withColumn("length", norm).repartitionByRange(max(1, parts // 4), F.desc("length"), F.asc("vec_id"))
                    .sortWithinPartitions(F.desc("length")).select("vec_id", "v")
                    .mapInArrow(lambda b: _blocks(b, QUERIES), c_schema).withColumn("query", F.monotonically_increasing_id()))
    # The longest vectors of each width, one block: a floor for every query.
    longest = candidates.groupBy("width").agg(F.max(F.struct("norm", "ids", "x")).alias("top")).select(
        "width", F.col("top.ids").alias("c_ids"), F.col("top.x").alias("c_x"))

    def floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                q_ids, q = _unpack(r.ids, r.x, r.width)
                c_ids, c = _unpack(r.c_ids, r.c_x, r.width)
                n, _, scores = block_topk(q_ids, q, np.full(len(q), -np.inf), c_ids, c, basis.value.get(r.width, np.zeros((0, 0))), k)
                counts = np.bincount(n, minlength=len(q))
                low = np.full(len(q), -np.inf)
                full = counts == k
                low[full] = scores[np.cumsum(counts)[full] - 1]
                norms = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
                # A block whose longest vector is below this reaches no floor here.
                reach = np.where(norms > 0, (low - 1) / np.maximum(norms, 1e-300), -np.inf).min()
                out.append((r.query, r.width, r.ids, r.x, low.tobytes(), float(reach) * (1 - 1e-9) if np.isfinite(reach) else -1.0))
            yield pd.DataFrame(out, columns=["query", "width", "ids", "x", "floors", "reach"])

    asked = settle(blocks.join(longest, "width").mapInPandas(
        floors, "query long, width int, ids binary, x binary, floors binary, reach double"))
    # Which blocks meet is decided on their numbers; the packed vectors follow by key.
    met = (asked.select("query", "width", "reach").join(candidates.select("block", "width", "norm"), "width")
           .where("norm >= reach").select("query", "block"))
    pairs = met.join(asked, "query").join(
        candidates.select("block", F.col("ids").alias("c_ids"), F.col("x").alias("c_x")), "block")

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q_ids, q = _unpack(r.ids, r.x, r.width)
                c_ids, c = _unpack(r.c_ids, r.c_x, r.width)
                n, at, s = block_topk(q_ids, q, np.frombuffer(r.floors, np.float64), c_ids, c, basis.value.get(r.width, np.zeros((0, 0))), k)
                yield pd.DataFrame({"query_id": q_ids[n], "vec_id": c_ids[at], "score": s})

    scored = pairs.mapInPandas(scores, "query_id long, vec_id long, score long")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
