"""Words, hashes and shingles of whole Arrow text columns, computed with numpy.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. All functions work on the UTF-8 bytes
of many texts at once; `slices` keeps what is held at a time near `BYTES`, however long a batch is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BYTES = 2 << 20
SHINGLE = 5

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _random.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Between the letters and digits of any alphabet, as far as bytes tell: all other ASCII characters.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, all bits of the output depend on all of the input."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers_up_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(64, 1 << int(n - 1).bit_length()), _BASE, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about `limit` bytes of text each, one row at least."""
    lengths = np.diff(texts(batch.column(column))[1]) if batch.num_rows else np.zeros(0, np.int64)
    part = (np.cumsum(lengths) - 1) // limit if len(lengths) else lengths
    cuts = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


class Words:
    """Words of several texts: where they start and end, how many each text has, their hashes.

    `between` says for each byte whether it separates words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, between: np.ndarray = _SPACE):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        space = between[self.data]
        n = len(space)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        self.space = space
        self.starts = np.flatnonzero(~space & (before | first[:-1]))
        self.ends = np.flatnonzero(~space & (after | first[1:])) + 1
        self.edges = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.edges)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash a word; equal bytes give equal hashes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        begin = self.starts[0]
        span = np.diff(np.append(self.starts, len(self.data)))
        place = np.arange(begin, len(self.data)) - np.repeat(self.starts, span)
        values = _BYTE[self.data[begin:]]
        values *= _powers_up_to(int(span.max()) + 1)[place]
        values[self.space[begin:]] = 0
        sums = np.add.reduceat(values, self.starts - begin)
        return mix(sums + (self.ends - self.starts).astype(np.uint64) * _BASE)


def joined_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every `n` consecutive words, whatever texts they are in."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        total += hashes[i : len(hashes) - n + 1 + i] * _PLACE[i]
    return mix(total)


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 5-word shingles of each text, one after the other, and their edges.

    A text with one to four words has the whole sequence as its only shingle; a text without
    words has none.
    """
    h, counts = words.hashes(), words.counts
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(counts.dtype))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    values = np.zeros(edges[-1], np.uint64)
    long = counts >= SHINGLE
    windows = joined_hashes(h, SHINGLE)
    if long.any():
        reps = sizes[long]
        at = np.repeat(words.edges[:-1][long] - np.concatenate(([0], np.cumsum(reps)[:-1])), reps) + np.arange(reps.sum())
        to = np.repeat(edges[:-1][long] - np.concatenate(([0], np.cumsum(reps)[:-1])), reps) + np.arange(reps.sum())
        values[to] = windows[at]
    for n in range(1, SHINGLE):
        own = np.flatnonzero(counts == n)
        if len(own):
            total = np.full(len(own), n, np.uint64)
            for i in range(n):
                total += h[words.edges[own] + i] * _PLACE[i]
            values[edges[own]] = mix(mix(total))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[edges[:-1][sizes > 0]] = True
    kept = np.concatenate(([0], np.cumsum(fresh)))
    return values[fresh], kept[edges]
