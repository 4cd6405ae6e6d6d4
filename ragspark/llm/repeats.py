"""Substring dedup with fixed-block anchors.

1. Every text is cut into non-overlapping blocks of half a window of words; each rolling sequence of that length probes
   them. Any window that occurs again holds a whole block of its own document, and a probe of the other
   occurrence equals that block. Blocks and probes are dealt out by hash as packed 32-bit fingerprints; a
   shard returns only the blocks that something else equals. (A fingerprint clash only adds a candidate.)
2. The hits are extended: the windows that hold such a block get a 64-bit hash, are dealt out again with their positions, and
   each equality class keeps its first occurrence.
3. Overlapping windows to be removed merge into maximal repeats, which are cut out of the texts.

A sequence that fills a chunk of documents is sent once by it, so that a passage found in a third of all documents is one
entry per chunk and not one per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.jaccard import among, repeated_values
from ragspark.llm.tables import settle, small_side, text_shards
from ragspark.llm.wordhash import Words, chunks, frugal, frugal_group, ids_of, mix, split_hashes

PROBES = "shard int, all_prints binary, prints binary, doc_ids binary, blocks binary"
WINDOWS = "shard int, hashes binary, doc_ids binary, starts binary"
FOUND = "doc_id long, places binary"


def _groups(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _binary(names: str, rows: list[list]) -> pa.RecordBatch:
    columns = [c.split() for c in names.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(columns)],
                                      names=[n for n, _ in columns])


def _places(ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The places of each document, as one value."""
    some, first = np.unique(ids, return_index=True)
    cuts = [*first.tolist(), len(ids)]
    values = places.astype(np.uint32)
    return some, [values[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def _probe(batches: Iterator[pa.RecordBatch], block: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk for each shard; rows with shard -1 hold blocks that are known here to occur again."""
    for rows, data, offsets in chunks(batches):
        ids, words = ids_of(rows), Words(data, offsets)
        at, hashes = words.sequences(block)
        if not len(at):
            continue
        doc = np.searchsorted(words.first, at, side="right") - 1
        inside = at - words.first[doc]
        aligned = inside % block == 0
        different, where, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        again = counts[where] > 1
        out = []
        known = aligned & again
        if known.any():
            for one, value in zip(*_places(ids[doc[known]][(o := np.argsort(ids[doc[known]], kind="stable"))], (inside[known] // block)[o]), strict=True):
                out.append([-1, None, None, np.int64(one).tobytes(), value])
        shard, prints = split_hashes(different, shards)
        order, cuts = _groups(shard, shards)
        mine = aligned & ~again
        shard_b, prints_b = split_hashes(hashes[mine], shards)
        order_b, cuts_b = _groups(shard_b, shards)
        ids_b, blocks_b = ids[doc[mine]], (inside[mine] // block).astype(np.uint32)
        for s in range(shards):
            o, b = order[cuts[s]:cuts[s + 1]], order_b[cuts_b[s]:cuts_b[s + 1]]
            if len(o):
                out.append([s, prints[o].tobytes(), prints_b[b].tobytes(), ids_b[b].tobytes(), blocks_b[b].tobytes()])
        yield _binary(PROBES, out)


def _hits(rows: pd.DataFrame) -> pd.DataFrame:
    """The blocks of a shard that two chunks or more hold as a block or as a probe."""
    if rows["shard"].iloc[0] < 0:  # found inside a chunk
        return pd.DataFrame({"doc_id": [int(np.frombuffer(b, np.int64)[0]) for b in rows["doc_ids"]], "places": list(rows["blocks"])})
    twice = repeated_values([np.frombuffer(b, np.uint32) for b in rows["all_prints"]])
    ids, blocks = [], []
    for row in rows.itertuples(index=False):
        hit = among(np.frombuffer(row.prints, np.uint32), twice)
        ids.append(np.frombuffer(row.doc_ids, np.int64)[hit])
        blocks.append(np.frombuffer(row.blocks, np.uint32)[hit])
    ids, blocks = np.concatenate(ids), np.concatenate(blocks)
    order = np.argsort(ids, kind="stable")
    some, values = _places(ids[order], blocks[order])
    return pd.DataFrame({"doc_id": some, "places": values})


def _extend(batches: Iterator[pa.RecordBatch], window: int, block: int, shards: int) -> Iterator[pa.RecordBatch]:
    """The windows that hold a hit block. Of equal ones in a chunk only the first goes to a shard; rows with shard -1 hold the rest."""
    for rows, data, offsets in chunks(batches):
        ids, words = ids_of(rows), Words(data, offsets)
        lists = rows.column(rows.schema.get_field_index("places")).to_pylist()
        begins, ends = [], []
        for first, count, places in zip(words.first, words.counts, lists, strict=True):
            at = np.unique(np.concatenate([np.frombuffer(p, np.uint32) for p in places])).astype(np.int64) * block
            low, high = np.maximum(at + block - window, 0), np.minimum(at, count - window)
            held = low <= high
            begins.append(low[held] + first)
            ends.append(high[held] + first + 1)
        change = np.zeros(len(words.starts) + 2, dtype=np.int32)
        np.add.at(change, np.concatenate(begins), 1)
        np.add.at(change, np.concatenate(ends), -1)
        at = np.flatnonzero(np.cumsum(change) > 0)
        if not len(at):
            continue
        hashes = words.sequence_hashes(at, np.full(len(at), window))
        doc = np.searchsorted(words.first, at, side="right") - 1
        start, owner = at - words.first[doc], ids[doc]
        order = np.lexsort((start, owner, hashes))
        h, i, p = hashes[order], owner[order], start[order]
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = h[1:] != h[:-1]
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
        same_place = (i == i[head]) & (p == p[head])  # the row itself, or a row given twice
        out = []
        later = np.flatnonzero(~same_place)
        if len(later):
            o = later[np.lexsort((p[later], i[later]))]
            for one, value in zip(*_places(i[o], p[o]), strict=True):
                out.append([-1, None, np.int64(one).tobytes(), value])
        h, i, p = h[fresh], i[fresh], p[fresh].astype(np.uint32)
        order, cuts = _groups(split_hashes(h, shards)[0], shards)
        for s in range(shards):
            o = order[cuts[s]:cuts[s + 1]]
            if len(o):
                out.append([s, h[o].tobytes(), i[o].tobytes(), p[o].tobytes()])
        yield _binary(WINDOWS, out)


def _later(rows: pd.DataFrame) -> pd.DataFrame:
    """The windows of a shard that also start earlier."""
    if rows["shard"].iloc[0] < 0:
        return pd.DataFrame({"doc_id": [int(np.frombuffer(b, np.int64)[0]) for b in rows["doc_ids"]], "places": list(rows["starts"])})
    h = np.concatenate([np.frombuffer(b, np.uint64) for b in rows["hashes"]])
    i = np.concatenate([np.frombuffer(b, np.int64) for b in rows["doc_ids"]])
    p = np.concatenate([np.frombuffer(b, np.uint32) for b in rows["starts"]])
    order = np.lexsort((p, i, h))
    h, i, p = h[order], i[order], p[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = h[1:] != h[:-1]
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
    later = (i != i[head]) | (p != p[head])
    i, p = i[later], p[later]
    order = np.lexsort((p, i))
    some, values = _places(i[order], p[order])
    return pd.DataFrame({"doc_id": some, "places": values})


def _merge(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The word ranges [begin, end) that the windows of a document cover, as one value."""
    for rows in batches:
        out = []
        for places in rows.column(rows.schema.get_field_index("places")).to_pylist():
            at = np.unique(np.concatenate([np.frombuffer(p, np.uint32) for p in places])).astype(np.int64)
            gap = np.flatnonzero(np.diff(at) > window)
            begins, ends = at[np.append(0, gap + 1)], at[np.append(gap, len(at) - 1)] + window
            out.append(np.stack([begins, ends], axis=1).astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")), pa.array(out, pa.binary())], names=["doc_id", "ranges"])


def _cut(batches: Iterator[pa.RecordBatch], rest: list[str]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in chunks(batches):
        words = Words(data, offsets, hashed=False)
        raw = data.tobytes()
        removed, kept, changed = np.zeros(len(words.counts), np.int64), [], []
        ranges = rows.column(rows.schema.get_field_index("ranges")).to_pylist()
        for d, (first, count, value) in enumerate(zip(words.first.tolist(), words.counts.tolist(), ranges, strict=True)):
            keep = np.ones(count, dtype=bool)
            for a, b in np.frombuffer(value or b"", np.uint32).reshape(-1, 2):
                keep[a:b] = False
            at = np.flatnonzero(keep) + first
            removed[d] = count - len(at)
            kept.append(b" ".join([raw[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)]).decode())
        yield pa.RecordBatch.from_arrays(
            [rows.column(rows.schema.get_field_index(c)) for c in rest]
            + [pa.array(words.counts.astype(np.int64)), pa.array(removed), pa.array(kept, pa.string())],
            names=[*rest, "n_words", "n_removed", "kept_text"])


def repeat_ranges(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, ranges: the word ranges of each document that repeat something earlier (pairs of 32-bit word numbers, end excluded)."""
    block, shards = window // 2, text_shards(docs)
    named = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    # Rows that are settled inside a chunk (shard -1) need no meeting; a salt keeps them from one task.
    key = [F.col("shard"), F.when(F.col("shard") < 0, F.pmod(F.xxhash64("doc_ids"), F.lit(shards))).otherwise(0).alias("salt")]
    hits = named.mapInArrow(lambda b: frugal(_probe(b, block, shards)), PROBES).groupBy(*key).applyInPandas(frugal_group(_hits), FOUND)
    hits = hits.groupBy("doc_id").agg(F.collect_list("places").alias("places"))
    near = named.join(small_side(hits), "doc_id")
    later = near.mapInArrow(lambda b: frugal(_extend(b, window, block, shards)), WINDOWS).groupBy(*key).applyInPandas(frugal_group(_later), FOUND)
    later = later.groupBy("doc_id").agg(F.collect_list("places").alias("places"))
    return later.mapInArrow(lambda b: frugal(_merge(b, window)), "doc_id long, ranges binary")


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...) with n_words, n_removed and kept_text, its kept words joined by one space.

    A word goes if a window of `window` words over it also starts earlier: in a document of smaller doc_id, or further
    up in its own. Windows are judged on the input. Words are runs of bytes other than space and 0x09 to 0x0D, compared as
    they are (by 64-bit hashes of the windows). Null and empty texts and texts of less than `window` words have
    nothing removed; kept_text is then empty or all words. A row whose doc_id is null takes no part and keeps its words. Rows
    that share a doc_id count as one document: none of them is earlier, and what is found in one is
    removed by its place in each. Columns of `docs` named like a new one are replaced.
    """
    rest = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text", "ranges")]
    ranges = small_side(repeat_ranges(docs, window))
    joined = docs.select(*rest).join(ranges, "doc_id", "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema.fields)
    return joined.mapInArrow(lambda b: frugal(_cut(b, rest)), f"{schema}, n_words long, n_removed long, kept_text string")
