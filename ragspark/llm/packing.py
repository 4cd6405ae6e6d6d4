"""Packing by power-of-two decomposition.

A document of n tokens is cut, from its start, into pieces of `length` tokens and then one piece for each set bit of the rest, longest
first. Pieces of equal length form a bucket, so a batch of a bucket is a full rectangle; every piece is a
sequence, none crosses documents, and none is padded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.wordhash import chunks, frugal

END = 1  # id that ends every document
_encoders: dict = {}


class Encoder:
    """Ids of a byte-level BPE vocabulary file of the `tokenizers` library.

    Texts within the code points 0 to 0x24F go through `tiktoken`, which gives the same ids from the same vocabulary several
    times as fast; other texts, and those that spell a special token, go through `tokenizers`.
    """

    def __init__(self, path: str) -> None:
        import json
        import re

        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.path = path
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelled = {chr(b): b for b in printable}
        spelled |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(spelled[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.odd = re.compile("|".join(["[^\\x00-\\u024f]", *map(re.escape, sorted(special))]))

    @cached_property
    def plain(self):
        """Loaded by the tasks that meet a text for it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> np.ndarray:
        if self.odd.search(text):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.asarray(self.fast.encode_ordinary(text), dtype=np.uint32)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(n: int, length: int) -> list[int]:
    """Lengths of the pieces of n tokens: whole lengths, then the set bits of the rest from the top."""
    rest = n % length
    return [length] * (n // length) + [1 << b for b in range(length.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pack(batches: Iterator[pa.RecordBatch], tokenizer: str, length: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(tokenizer)
    for rows, data, offsets in chunks(batches):
        raw, ids, starts, counts, totals, where = data.tobytes(), [], [], [], [], []
        for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            tokens = np.append(encode(raw[a:b].decode()), np.uint32(END))
            sizes = pieces(len(tokens), length)
            ids.append(tokens)
            counts += sizes
            starts += (np.cumsum(sizes) - sizes).tolist()
            totals += [len(tokens)] * len(sizes)
            where += [d] * len(sizes)
        cuts = np.append(0, np.cumsum(counts)) * 4
        values = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(np.concatenate(ids).astype("<u4").tobytes())])
        yield pa.RecordBatch.from_arrays(
            [rows.column(rows.schema.get_field_index("doc_id")).take(pa.array(where)), pa.array(starts, pa.int64()),
             pa.array(counts, pa.int64()), pa.array(totals, pa.int64()), values],
            names=["doc_id", "start", "length", "doc_tokens", "ids"])


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048) -> DataFrame:
    """A row per piece of (doc_id, text): doc_id, start, length, doc_tokens, ids, sequence_id, offset, padding.

    ids holds the piece's ids as little-endian unsigned 32-bit numbers; the bucket of a piece is its length, a power of two up to
    `length` (itself a power of two). offset and padding are 0: a piece is a sequence. sequence_id is unique, and the same again for the same
    files. Each document ends with id 1; null and empty texts are that id alone. Null and repeated doc_ids are kept as they
    are. Long texts give many pieces. Other columns are not read; nothing is shuffled. An empty table gives an empty result.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    doc = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.select("doc_id", "text").mapInArrow(
        lambda b: frugal(_pack(b, tokenizer, length)), f"doc_id {doc}, start long, length long, doc_tokens long, ids binary")
    zero = F.lit(0).cast("long")
    return cut.select("*", F.monotonically_increasing_id().alias("sequence_id"), zero.alias("offset"), zero.alias("padding"))
