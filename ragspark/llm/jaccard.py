"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

1. Columns that only one document holds add to no overlap. The incidence is dealt out by n-gram in packed blocks of
   32-bit fingerprints, each shard counts its columns, and a document of n n-grams stays only if at least `similarity` * n
   of its columns are shared: any partner must hold that many of them. (A fingerprint clash can only let too much through.)
2. Documents with equal sets become one class. Among the classes left, columns are counted exactly; every class enters
   its rarest n - ceil(similarity * n) + 1 columns, for a pair that reaches the similarity shares one of them.
3. Classes connected by such columns form a family. The incidence rows of a family are multiplied block by block: blocks of
   at most BLOCK rows, only blocks of sizes that can reach the similarity, overlap counts summed over column tiles,
   pairs below the bound on the overlap that follows from their sizes discarded. A block pair returns a spanning forest of its
   links and link counts, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.components import components
from ragspark.llm.tables import settle, small_side, text_shards
from ragspark.llm.wordhash import Words, chunks, frugal, frugal_group, ids_of, mix, split_hashes, sums_by

BLOCK = 256  # rows of one side of a block product
TILE = 4096  # columns of a tile

PACKED = ("shard int, doc_ids binary, counts binary, singles binary, several binary, "
          "n binary, k1 binary, k2 binary, base binary")


def shingle_sets(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of the distinct n-grams of each document, ordered by both.

    A document of fewer words has its whole sequence as its only n-gram.
    """
    at, hashes = words.sequences(length)
    doc = np.searchsorted(words.first, at, side="right") - 1
    # Several documents may begin at the same word number when some are empty; the last of them holds the word.
    short = np.flatnonzero((words.counts > 0) & (words.counts < length))
    if len(short):
        doc = np.concatenate([doc, short])
        hashes = np.concatenate([hashes, words.sequence_hashes(words.first[short], words.counts[short])])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[fresh], hashes[fresh]


def _set_keys(doc: np.ndarray, hashes: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, key, key) of each set; equal sets have equal keys, whatever the order."""
    n = np.bincount(doc, minlength=docs)
    return n, sums_by(hashes, n), sums_by(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), n)


def _pack(batches: Iterator[pa.RecordBatch], length: int, shards: int) -> Iterator[pa.RecordBatch]:
    """One row per chunk of documents and shard. An n-gram that several documents of the chunk hold is known to be
    shared: they count it here, and the shard gets it once."""
    for rows, data, offsets in chunks(batches):
        ids = ids_of(rows)
        doc, hashes = shingle_sets(Words(data, offsets, lower=True), length)
        n, k1, k2 = _set_keys(doc, hashes, len(ids))
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        same = np.zeros(len(ordered) + 1, dtype=bool)
        same[1:-1] = ordered[1:] == ordered[:-1]
        several = np.zeros(len(ordered), dtype=bool)
        several[order] = same[1:] | same[:-1]
        shared_here = ordered[same[1:] & ~same[:-1]]
        base = np.bincount(doc[several], minlength=len(ids))
        doc, hashes = doc[~several], hashes[~several]
        shard, prints = split_hashes(hashes, shards)
        shard_s, prints_s = split_hashes(shared_here, shards)
        order = np.argsort(shard, kind="stable")  # keeps the documents in order inside a shard
        doc, prints = doc[order], prints[order]
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        order_s = np.argsort(shard_s, kind="stable")
        prints_s, cuts_s = prints_s[order_s], np.searchsorted(shard_s[order_s], np.arange(shards + 1))
        home = int(mix(np.array([ids[0] & 0x7FFFFFFFFFFFFFFF], dtype=np.uint64))[0] % np.uint64(shards))
        out = []
        for s in range(shards):
            mine = slice(cuts[s], cuts[s + 1])
            some, counts = np.unique(doc[mine], return_counts=True)
            if s != home and not len(some) and cuts_s[s] == cuts_s[s + 1]:
                continue
            if s == home:
                some, counts = np.arange(len(ids)), np.bincount(doc[mine], minlength=len(ids))
            row = [s, ids[some].tobytes(), counts.astype(np.uint32).tobytes(), prints[mine].tobytes(),
                   prints_s[cuts_s[s]:cuts_s[s + 1]].tobytes()]
            row += [x.tobytes() for x in (n.astype(np.int64), k1, k2, base.astype(np.int64))] if s == home else [None] * 4
            out.append(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int32())] + [pa.array([r[i] for r in out], pa.binary()) for i in range(1, 9)],
            names=["shard", "doc_ids", "counts", "singles", "several", "n", "k1", "k2", "base"])


def repeated_values(parts: list[np.ndarray]) -> np.ndarray:
    """The values that occur at least twice, ordered."""
    values = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)
    twice = values[1:][values[1:] == values[:-1]]
    return twice[np.concatenate([[True], twice[1:] != twice[:-1]])] if len(twice) else twice


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def _count_columns(rows: pd.DataFrame) -> pd.DataFrame:
    """For the documents of a shard: how many of their columns in it another document has too."""
    singles = [np.frombuffer(b, np.uint32) for b in rows["singles"]]
    several = [np.frombuffer(b, np.uint32) for b in rows["several"]]
    shared = repeated_values([*singles, *several, *several])
    found = []
    for mine, row in zip(singles, rows.itertuples(index=False), strict=True):
        counts = np.frombuffer(row.counts, np.uint32).astype(np.int64)
        part = {"doc_id": np.frombuffer(row.doc_ids, np.int64), "shared": sums_by(among(mine, shared).astype(np.int64), counts)}
        if row.n is not None:
            part["shared"] = part["shared"] + np.frombuffer(row.base, np.int64)
            part |= {k: np.frombuffer(getattr(row, k), np.int64) for k in ("n", "k1", "k2")}
        else:
            part |= {k: np.zeros(len(counts), np.int64) for k in ("n", "k1", "k2")}
            part["n"] = part["n"] - 1  # not said here
        found.append(pd.DataFrame(part))
    return pd.concat(found, ignore_index=True)


def set_table(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, n (size of the set), k1, k2 (keys of the set), shared (an upper bound of the columns it shares)."""
    shards = text_shards(docs)
    packed = docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(lambda b: frugal(_pack(b, length, shards)), PACKED)
    counted = packed.groupBy("shard").applyInPandas(
        frugal_group(_count_columns), "doc_id long, shared long, n long, k1 long, k2 long")
    return counted.groupBy("doc_id").agg(
        F.sum("shared").alias("shared"), F.max(F.struct("n", "k1", "k2")).alias("s")).select("doc_id", "shared", "s.*")


def _sets(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in chunks(batches):
        ids = ids_of(rows)
        doc, hashes = shingle_sets(Words(data, offsets, lower=True), length)
        n, k1, k2 = _set_keys(doc, hashes, len(ids))
        cuts = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(n.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
             pa.ListArray.from_arrays(pa.array(cuts), pa.array(hashes.view(np.int64)))],
            names=["doc_id", "n", "k1", "k2", "columns"])


def _needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap two sets of these sizes must have: ceil(percent * (a + b) / (100 + percent))."""
    return -((-percent * (a + b)) // (100 + percent))


def _incidence(rows: pd.DataFrame, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) numbers of the cells in the given columns, ordered by column."""
    values = np.concatenate([np.asarray(c, dtype=np.int64) for c in rows["columns"]])
    row = np.repeat(np.arange(len(rows)), [len(c) for c in rows["columns"]])
    at = np.minimum(np.searchsorted(columns, values), len(columns) - 1)
    held = columns[at] == values
    order = np.argsort(at[held], kind="stable")
    return row[held][order], at[held][order]


def _block_product(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between the rows of side 0 and side 1, or among those of side 0 where there is no other side."""
    rows = rows.sort_values(["n", "doc_id"], kind="stable")
    left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
    square = bool(rows["square"].iloc[0])
    if square:
        right = left
    empty = pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
    if not len(left) or not len(right):
        return empty
    own = np.concatenate([np.asarray(c, dtype=np.int64) for c in rows["columns"]])
    values, counts = np.unique(own, return_counts=True)
    columns = values[counts > 1]  # the others add to no overlap
    if not len(columns):
        return empty
    a, a_at = _incidence(left, columns)
    b, b_at = (a, a_at) if square else _incidence(right, columns)
    overlap = np.zeros((len(left), len(right)), dtype=np.float32)
    for low in range(0, len(columns), TILE):
        width = min(TILE, len(columns) - low)
        tiles = []
        for row, at, n in ((a, a_at, len(left)), (b, b_at, len(right))):
            cut = slice(*np.searchsorted(at, [low, low + width]))
            tile = np.zeros((n, width), dtype=np.float32)
            tile[row[cut], at[cut] - low] = 1
            tiles.append(tile)
        overlap += tiles[0] @ tiles[1].T
    n_a, n_b = left["n"].to_numpy()[:, None], right["n"].to_numpy()[None, :]
    linked = overlap.astype(np.int64) >= _needed(n_a, n_b, percent)
    if square:
        np.fill_diagonal(linked, False)
    ids_a, ids_b = left["doc_id"].to_numpy(), right["doc_id"].to_numpy()
    links_a = linked @ right["copies"].to_numpy()
    out = [pd.DataFrame({"u": ids_a, "v": ids_a, "links": links_a})]
    if not square:
        out.append(pd.DataFrame({"u": ids_b, "v": ids_b, "links": linked.T @ left["copies"].to_numpy()}))
    out.append(_forest(linked, ids_a, ids_b, square))
    found = pd.concat(out, ignore_index=True)
    return found[(found["links"] > 0) | (found["u"] != found["v"])]


def _forest(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, square: bool) -> pd.DataFrame:
    """As many edges as connect what the links connect."""
    shift = 0 if square else len(ids_a)
    ids = ids_a if square else np.concatenate([ids_a, ids_b])
    label = np.arange(len(ids))
    for i in range(len(ids_a)):
        mine = np.flatnonzero(linked[i]) + shift
        if len(mine):
            labels = np.unique(np.append(label[mine], label[i]))
            if len(labels) > 1:
                label[np.isin(label, labels[1:])] = labels[0]
    far = label != np.arange(len(ids))
    return pd.DataFrame({"u": ids[far], "v": ids[label[far]], "links": 0})


def rarest_columns(sets: DataFrame, percent: int) -> DataFrame:
    """doc_id, column: the rarest columns of each set, as many as a partner cannot all lack. Columns of one set are left out."""
    cells = sets.select("doc_id", "n", F.explode("columns").alias("column"))
    counts = cells.groupBy("column").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    most_missing = F.expr(f"n - ceil({percent} * n / 100)")
    return (
        cells.join(counts, "column")
        .groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("held", "column"))).alias("cells"))
        .withColumn("take", (most_missing + 1 - (F.col("n") - F.size("cells"))).cast("int"))
        .where("take > 0")
        .select("doc_id", F.explode(F.slice("cells", 1, F.col("take"))).alias("cell"))
        .select("doc_id", F.col("cell.column").alias("column"))
    )


def _star_edges(cells: DataFrame) -> DataFrame:
    """Each document of a column linked to the first document of it."""
    first = cells.groupBy("column").agg(F.min("doc_id").alias("v"))
    return cells.join(first, "column").select(F.col("doc_id").alias("u"), "v").where("u <> v").distinct()


def block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Each row of `members` (family, doc_id, n, ...) once for every block pair it takes part in.

    A family of at most BLOCK rows is one block. A larger one is cut by size class and a hash of the id; only blocks of the
    same or of neighbouring classes meet, as sizes further apart cannot reach the similarity.
    """
    step = float(np.log(100 / percent)) * 1.001
    members = members.withColumn("cls", F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int"))
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("rows"))
    members = members.join(small_side(sizes.where(F.col("rows") > 1)), "family")
    small = members.where(F.col("rows") <= BLOCK).select(
        *members.columns, *[F.lit(0).alias(c) for c in ("c1", "b1", "c2", "b2", "side")], F.lit(True).alias("square"))
    large = members.where(F.col("rows") > BLOCK)
    blocks = settle(large.groupBy("family", "cls").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    near = blocks
    for shift, name in ((-1, "below"), (1, "above")):
        other = blocks.select("family", (F.col("cls") - shift).alias("cls"), F.col("blocks").alias(name))
        near = near.join(other, ["family", "cls"], "left")
    near = small_side(near.na.fill(0, ["below", "above"]))
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks").cast("long")).cast("int")

    def pairs(count, make):
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col(count) - 1, F.lit(0))), make)).otherwise(
            F.array().cast("array<struct<c1:int,b1:int,c2:int,b2:int,side:int,square:boolean>>"))

    def pair(c1, b1, c2, b2, side, square):
        return F.struct(c1.alias("c1"), b1.alias("b1"), c2.alias("c2"), b2.alias("b2"), side.cast("int").alias("side"), square.alias("square"))

    c, b = F.col("cls"), F.col("block")
    met = F.concat(
        pairs("blocks", lambda o: pair(c, F.least(b, o), c, F.greatest(b, o), b > o, b == o)),
        pairs("above", lambda o: pair(c, b, c + 1, o, F.lit(0), F.lit(False))),
        pairs("below", lambda o: pair(c - 1, o, c, b, F.lit(1), F.lit(False))),
    )
    large = (large.join(near, ["family", "cls"]).withColumn("block", block).withColumn("met", F.explode(met))
             .select(*[F.col(x) for x in members.columns], "met.*"))
    return small.unionByName(large)


def jaccard_groups(docs: DataFrame, length: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each document of (doc_id, text).

    Two documents link when 100 * intersection >= percent * union of their sets of `length`-word n-grams of the text with A-Z in
    lower case. component_id is the smallest doc_id that links lead to, n_links the number of other documents
    linked directly, copies included. A null, empty or wordless text has an empty set, links with nothing and is its
    own component. Rows without doc_id are left out; a doc_id that occurs again counts as one document (the row
    with the largest set). Other columns are not read. An empty table gives an empty result.
    N-grams are compared by 64-bit hashes.
    """
    table = settle(set_table(docs, length))
    maybe = table.where(f"n > 0 AND 100 * shared >= {percent} * n")
    keys = ["n", "k1", "k2"]
    classes = settle(maybe.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    wanted = classes.select(F.col("rep").alias("doc_id"), "copies", *[F.col(k).alias(f"w_{k}") for k in keys])
    texts = docs.select("doc_id", "text").join(small_side(wanted.select("doc_id")), "doc_id", "left_semi")
    sets = texts.mapInArrow(lambda b: frugal(_sets(b, length)), "doc_id long, n long, k1 long, k2 long, columns array<long>")
    sets = sets.join(wanted, "doc_id").where(" AND ".join(f"{k} = w_{k}" for k in keys)).dropDuplicates(["doc_id"])
    sets = settle(sets.select("doc_id", "n", "copies", "columns"))
    families = components(_star_edges(settle(rarest_columns(sets, percent))))
    members = sets.join(small_side(families.select(F.col("node").alias("doc_id"), F.col("component").alias("family"))), "doc_id")
    met = block_pairs(members, percent).select("family", "c1", "b1", "c2", "b2", "side", "square", "doc_id", "n", "copies", "columns")
    found = settle(met.groupBy("family", "c1", "b1", "c2", "b2").applyInPandas(
        lambda rows: _block_product(rows, percent), "u long, v long, links long"))
    groups = components(found.where("u <> v").select("u", "v"))
    links = found.where("u = v").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    reps = classes.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").join(links, "rep", "left")
    reps = reps.select(*keys, "copies", F.coalesce("component", "rep").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    named = maybe.select("doc_id", *keys).join(small_side(reps), keys).select(
        "doc_id", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return table.select("doc_id", F.col("n").alias("n_shingles")).join(named, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))
