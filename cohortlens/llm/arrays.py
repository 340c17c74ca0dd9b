"""Whole texts as numpy arrays inside a task: words, 64-bit hashes of words and of runs of words.

Functions here see one bounded chunk of an Arrow batch at a time. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes hashed at once, so that the tables of powers stay small however long a text is.
HASH_BYTES = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20240501)
_BYTE_CODES = _random.integers(1, 2**63, 256, dtype=np.uint64)
_ORDER_CODES = _random.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table(n: int, sign: int) -> np.ndarray:
    table = _powers[sign]
    if len(table) < n:
        size = max(n, HASH_BYTES + 1)
        table = np.full(size, _BASE if sign > 0 else _INVERSE, np.uint64)
        table[0] = 1
        table = np.cumprod(table)
        if size <= HASH_BYTES + 1:
            _powers[sign] = table
    return table


@dataclass
class Chunk:
    """Consecutive rows of a batch: ``data`` holds their UTF-8 bytes, row i at ``offsets[i]:offsets[i + 1]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Words (runs without ASCII white space) of a chunk, in order; ``first[i]:first[i + 1]`` are those of row i."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a text column into chunks of about ``limit`` bytes, whole rows only."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        last = min(last, len(texts))
        yield Chunk(row, data[offsets[row]:offsets[last]], offsets[row:last + 1] - offsets[row])
        row = last


def find_words(chunk: Chunk) -> Words:
    data, offsets = chunk.data, chunk.offsets
    inside = ~SPACE[data]
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    filled = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    begins[heads] = inside[heads]
    closes[tails] = inside[tails]
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets))


def hash_words(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(words.starts), np.uint64)
    at = 0
    while at < len(out):
        begin = words.starts[at]
        stop = max(at + 1, int(np.searchsorted(words.ends, begin + HASH_BYTES, "right")))
        part = data[begin:words.ends[stop - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        codes = _BYTE_CODES[part]
        codes *= _power_table(len(part) + 1, 1)[:len(part)]
        np.cumsum(codes, out=sums[1:])
        s, e = words.starts[at:stop] - begin, words.ends[at:stop] - begin
        got = sums[e] - sums[s]
        got *= _power_table(len(part) + 1, -1)[s]
        got ^= (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        out[at:stop] = mix(got)
        at = stop
    return out


def hash_runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words, by its first word. Runs may cross rows; callers choose."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * _ORDER_CODES[0]
    for k in range(1, size):
        out += hashes[k:k + n] * _ORDER_CODES[k]
    return mix(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``starts[0]..starts[0] + lengths[0] - 1, starts[1]..`` as one array."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(total)


def run_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which a run of ``size`` words fits into its row, and how many each row has."""
    lengths = np.maximum(np.diff(first) - size + 1, 0)
    return ragged(first[:-1], lengths), lengths


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over ``offsets[i]:offsets[i + 1]`` for each i."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class Column:
    """An array that grows."""

    def __init__(self, kind: type):
        self.data, self.size = np.zeros(1 << 12, kind), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            grown = np.zeros(max(need, 2 * len(self.data)), self.data.dtype)
            grown[:self.size] = self.data[:self.size]
            self.data = grown
        self.data[self.size:need] = values
        self.size = need

    @property
    def values(self) -> np.ndarray:
        return self.data[:self.size]
