"""Merkle manifest of a dataset: a root over all rows, and for every row a witness that proves it against the root.

Every group (source) is a tree of its own whose root is a leaf of the tree of groups. Leaves are ranked, dealt into aligned blocks of
arity ** levels, and a task appends the leaves of a block one by one: an append opens a subtree with an empty witness, and each sibling
that completes a run extends the witnesses of all leaves below the run. The roots of the blocks are appended to the next tier of blocks in
the same way, until one root is left, and so are the roots of the groups. A witness therefore is the witness inside the leaf's block,
then that of its block, and so on up to the root. No task holds more than a block, however large a group is.

A witness is bytes: for each level one byte (position in the run * 16 + number of siblings) and the siblings' digests, left to right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions.ranking import rank_rows
from ragspark.llm.tables import settle, small_side

ARITY = 3
LEVELS = 7  # 2,187 leaves to a block
DIGEST = 32


def joined_digest(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join([d.hex() for d in digests]).encode()).digest()


class Appender:
    """A tree that grows by appended digests; the witness of every leaf covers the runs that are complete so far."""

    def __init__(self, arity: int = ARITY):
        self.arity = arity
        self.witnesses: list[bytearray] = []
        self.open: list[list[tuple[bytes, int, int]]] = [[]]  # per level the subtrees of the open run: digest, first leaf, end

    def append(self, digest: bytes) -> None:
        at = len(self.witnesses)
        self.witnesses.append(bytearray())
        self._place(0, (digest, at, at + 1))

    def _place(self, level: int, subtree: tuple[bytes, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(subtree)
        if len(self.open[level]) == self.arity:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [digest for digest, _, _ in run]
        for k, (_, first, end) in enumerate(run):
            step = bytes([16 * k + len(run) - 1]) + b"".join(digests[:k] + digests[k + 1:])
            for leaf in range(first, end):
                self.witnesses[leaf] += step
        self._place(level + 1, (joined_digest(digests), run[0][1], run[-1][2]))

    def close(self, levels: int | None = None) -> bytes:
        """Completes open runs, for `levels` levels or until one node is left, and returns that node."""
        level = 0
        while levels is None or level < levels:
            higher = any(self.open[level + 1:])
            if levels is None and not higher and len(self.open[level]) == 1:
                break
            if self.open[level]:
                self._complete(level)
            level += 1
        return self.open[level][0][0]


def steps(witness: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(position in the run, siblings) for each level of a witness."""
    at = 0
    while at < len(witness):
        position, many = divmod(witness[at], 16)
        yield position, [witness[at + 1 + DIGEST * k:at + 1 + DIGEST * (k + 1)] for k in range(many)]
        at += 1 + DIGEST * many


def fold(digest: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness give."""
    for position, siblings in steps(witness):
        digest = joined_digest(siblings[:position] + [digest] + siblings[position:])
    return digest


def proof_digest(witness: bytes) -> bytes:
    return joined_digest([s for _, siblings in steps(witness) for s in siblings])


def field(column: Column) -> Column:
    """'-' for null, else the UTF-8 length, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def row_digest(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def _blocks(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """group, block, many (blocks of the group), and the block's nodes in order; `nodes` has group, at (from 0), digest and more."""
    size = arity ** levels
    node = F.struct("at", *[c for c in nodes.columns if c not in ("group", "at")])
    packed = nodes.groupBy("group", F.floor(F.col("at") / size).cast("long").alias("block")).agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    packed = settle(packed)
    counts = packed.groupBy("group").agg(F.count(F.lit(1)).alias("many"))
    return packed.join(small_side(counts), "group")


def _appended(rows: pa.RecordBatch, row: int, arity: int, levels: int) -> tuple[Appender, bytes, pa.StructArray]:
    nodes = rows.column("nodes")[row].values
    tree = Appender(arity)
    for digest in nodes.field("digest").to_pylist():
        tree.append(digest)
    return tree, tree.close(levels if rows.column("many")[row].as_py() > 1 else None), nodes


def _roots(arity: int, levels: int):
    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield pa.RecordBatch.from_arrays(
                [rows.column("group"), rows.column("block"), pa.array([_appended(rows, k, arity, levels)[1] for k in range(rows.num_rows)], pa.binary())],
                names=["group", "at", "digest"])

    return closed


def _extended(arity: int, levels: int):
    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                tree, root, nodes = _appended(rows, k, arity, levels)
                above, top = rows.column("above")[k].as_py(), rows.column("top")[k].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows.column("group")[k].as_py()] * len(nodes), pa.string()), nodes.field("at"),
                     pa.array([bytes(w) + above for w in tree.witnesses], pa.binary()), pa.array([top or root] * len(nodes), pa.binary())],
                    names=["group", "at", "witness", "top"])

    return extended


def _raised(packed: DataFrame, arity: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """The blocks with `above` (witness of the block) and `top` (root of the group), and group, top of every group."""
    roots = settle(packed.select("group", "block", "nodes", "many").mapInArrow(_roots(arity, levels), "group string, at long, digest binary"))
    if packed.agg(F.max("many")).first()[0] in (None, 1):
        tops = roots.select("group", F.col("digest").alias("top"))
        return packed.withColumn("above", F.lit(b"")).join(small_side(tops), "group"), tops
    upper, tops = _raised(_blocks(roots, arity, levels), arity, levels)
    witnesses = settle(upper.mapInArrow(_extended(arity, levels), "group string, at long, witness binary, top binary"))
    paths = witnesses.select("group", F.col("at").alias("block"), F.col("witness").alias("above"), "top")
    return packed.join(small_side(paths), ["group", "block"]), tops


def _manifest(arity: int, levels: int, kept: list[str]):
    def proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                tree, _, nodes = _appended(rows, k, arity, levels)
                above = rows.column("above")[k].as_py() + rows.column("beyond")[k].as_py()
                top, root = rows.column("top")[k].as_py(), rows.column("root")[k].as_py()
                leaves, shown = nodes.field("digest").to_pylist(), nodes.field("shown").to_pylist()
                witnesses = [bytes(w) + above for w in tree.witnesses]
                folded = [fold(leaf if other is None else other, w) for leaf, other, w in zip(leaves, shown, witnesses, strict=True)]
                many = len(leaves)
                yield pa.RecordBatch.from_arrays([
                    *[nodes.field(c) for c in kept],
                    pa.array(leaves, pa.binary()), pa.array([top] * many, pa.binary()), pa.array([root] * many, pa.binary()),
                    pa.array(witnesses, pa.binary()), pa.array([proof_digest(w) for w in witnesses], pa.binary()),
                    pa.array(folded, pa.binary()), pa.array([f == root for f in folded], pa.bool_()),
                ], names=[*kept, "leaf", "subroot", "root", "witness", "proof", "folded", "verified"])

    return proven


def merkle_manifest(rows: DataFrame, columns: list[str], group: str, order: str, shown: list[Column] | None = None,
                    arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """The `order` column of every row, then leaf, subroot, root, witness, proof (binary), folded (binary) and verified.

    A leaf is the SHA-256 of the row's `columns`. Groups are trees, ordered by name, null first, bytewise; leaves of a group ascend by `order`,
    null first, rows of equal `order` by their digest (equal rows are leaves of their own, next to each other). `shown` holds the same columns
    as somebody presents them for verification (None: as they are); the root is folded from the shown row and the witness of the original, and
    verified says whether it is the root. A row whose group and table are alone is its own root, with an empty witness. An empty table gives
    an empty result. Extra columns are not read.
    """
    digest, other = row_digest([F.col(c) for c in columns]), row_digest(shown) if shown else F.lit(None).cast("binary")
    named = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("!"))  # "!" sorts before "+"
    leaves = rows.select(named.alias("group"), F.col(order).alias("key"), digest.alias("digest"), F.nullif(other, digest).alias("shown"))
    ranked = rank_rows(leaves, ["group"], [F.col("key").asc_nulls_first(), F.col("digest").asc()], "at").withColumn("at", F.col("at") - 1)
    blocks, subroots = _raised(_blocks(ranked, arity, levels), arity, levels)
    grouped = rank_rows(subroots.withColumn("group_name", F.col("group")), [], [F.col("group").asc()], "at")
    grouped = settle(grouped.select(F.lit("").alias("group"), (F.col("at") - 1).alias("at"), F.col("top").alias("digest"), F.col("group_name")))
    tree, roots = _raised(_blocks(grouped.drop("group_name"), arity, levels), arity, levels)
    beyond = tree.mapInArrow(_extended(arity, levels), "group string, at long, witness binary, top binary")
    beyond = beyond.select("at", F.col("witness").alias("beyond"), F.col("top").alias("root")).join(grouped.select("at", "group_name"), "at")
    joined = blocks.join(small_side(beyond.select(F.col("group_name").alias("group"), "beyond", "root")), "group")
    key = rows.select(order).schema[0].dataType.simpleString()
    out = joined.select("nodes", "many", "above", "beyond", "top", "root").mapInArrow(
        _manifest(arity, levels, ["key"]),
        f"key {key}, leaf binary, subroot binary, root binary, witness binary, proof binary, folded binary, verified boolean")
    return out.withColumnRenamed("key", order)
