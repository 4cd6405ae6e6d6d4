"""Words of UTF-8 texts and hashes of word sequences, vectorised over the bytes of an Arrow batch.

A word is a run of bytes other than space and 0x09 to 0x0D. A word or a sequence of words gets a polynomial hash modulo
2**64 over randomised values, taken from running sums, so its cost does not depend on the length of the sequence.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = (1 << 20) - 1  # text handled at once by a task; one longer text is a chunk of its own

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd base and of its inverse, kept as far as a chunk needs them; a longer text makes its own."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) >= n:
            return self.up[:n], self.down[:n]
        size = 1 << (n - 1).bit_length()
        up, down = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)), dtype=np.uint64)
                    for b in (self.base, self.inverse))
        if n <= CHUNK_BYTES + 1:
            self.up, self.down = up, down
        return up[:n], down[:n]


_BYTES, _WORDS = _Powers(0x9E3779B97F4A7C55), _Powers(0xD6E8FEB86659FD93)


class Words:
    """The words of a chunk of documents.

    starts, ends: byte offsets in `data`; hashes: 64 bits for each word; counts: words of each document; first: number
    of the first word of each document.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True) -> None:
        self.data, self.offsets = data, offsets
        inside = ~_SEPARATOR[data]
        edge = np.zeros(len(data) + 1, dtype=bool)  # a document begins here, or the data end
        edge[offsets] = True
        begins, stops = inside.copy(), inside.copy()
        if len(data):
            begins[1:] &= ~inside[:-1] | edge[1:-1]
            stops[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        bounds = np.searchsorted(self.starts, offsets)
        self.first, self.counts = bounds[:-1], np.diff(bounds)
        if hashed:
            up, down = _BYTES.to(len(data) + 1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
                _BYTE_VALUES[_LOWER[data] if lower else data] * up[:-1], dtype=np.uint64)])
            self.hashes = mix((total[self.ends] - total[self.starts]) * down[self.starts])

    def sequences(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of its first word, hash) of every sequence of `length` words inside one document."""
        n = len(self.hashes)
        at = np.arange(max(0, n - length + 1))
        last = np.repeat(self.first + self.counts, self.counts)[:len(at)]
        at = at[at + length <= last]
        return at, self.sequence_hashes(at, np.full(len(at), length))

    def sequence_hashes(self, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        up, down = _WORDS.to(len(self.hashes) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * up[:-1], dtype=np.uint64)])
        return mix((total[at + lengths] - total[at]) * down[at] + lengths.astype(np.uint64))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    texts = (pc.fill_null(texts, "") if texts.null_count else texts).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts, offsets in them), about `most` bytes at once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(at, end - at), data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
            at = end


def give_back() -> None:
    """Return freed memory to the system: Python workers stay for later tasks, and would keep what earlier ones needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def frugal(task: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task, which gives its memory back after the last one."""
    yield from task
    give_back()


def frugal_group(function: Callable) -> Callable:
    """The function of a group, which gives its memory back after each group."""
    def run(rows):
        try:
            return function(rows)
        finally:
            give_back()
    return run


def ids_of(batch: pa.RecordBatch, column: str = "doc_id") -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).cast(pa.int64()).to_numpy(zero_copy_only=False)


def split_hashes(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, 32-bit fingerprint inside the shard): the upper half of a hash deals it out, the lower half names it."""
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64), hashes.astype(np.uint32)


def sums_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of `counts` values."""
    kind = np.uint64 if values.dtype == np.uint64 else np.int64
    total = np.append(np.zeros(1, kind), np.cumsum(values, dtype=kind))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
