"""Vectorised word and shingle hashing over Arrow string columns.

A word is a run of bytes other than ``[\\x20\\x09-\\x0D]``; A-Z count as a-z. A word's hash is a polynomial of random
byte values modulo 2**64, finished by a 64-bit mixer, so that every pass is a numpy operation over whole chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Chunks keep the working arrays near the cache; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_VALUE[:] = _BYTE_VALUE[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for at, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[at] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """The words of rows ``first`` to ``first + rows`` of a column, in order."""

    first: int
    rows: int
    data: np.ndarray  # bytes as stored
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  # of row i: words bounds[i] to bounds[i + 1]

    def text(self, word: int) -> str:
        return self.data[self.start[word] : self.end[word]].tobytes().decode("utf-8", "replace")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    return data, offsets


def word_chunks(column: pa.Array) -> Iterator[Words]:
    """Words of all rows, in chunks of rows of about CHUNK_BYTES."""
    if not len(column):
        return
    data, offsets = buffers(column)
    row = 0
    while row < len(offsets) - 1:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        yield _words(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], row)
        row = stop


def _words(data: np.ndarray, offsets: np.ndarray, first: int) -> Words:
    rows = len(offsets) - 1
    none = np.zeros(0, dtype=np.int64)
    if not len(data):
        return Words(first, rows, data, none, none, np.zeros(0, dtype=np.uint64), np.zeros(rows + 1, dtype=np.int64))
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _tables(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * power[: len(data)], out=total[1:])
    hashes = mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return Words(first, rows, data, start, end, hashes, np.searchsorted(start, offsets))


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Of each row the sorted distinct hashes of its ``k``-word shingles; of a row with fewer words, the hash of all of
    them; of a row without words, nothing."""
    h, n = words.hash, np.diff(words.bounds)
    joined = {}

    def fold(length: int) -> np.ndarray:
        if length not in joined:
            acc = mix64(h[: max(0, len(h) - length + 1)] + np.uint64(length))
            for j in range(1, length):
                acc = mix64(acc * _BASE + h[j : len(h) - length + 1 + j])
            joined[length] = acc
        return joined[length]

    for i in range(words.rows):
        at, count = words.bounds[i], int(n[i])
        if not count:
            yield np.zeros(0, dtype=np.uint64)
        elif count <= k:
            yield fold(count)[at : at + 1]
        else:
            own = np.sort(fold(k)[at : at + count - k + 1])
            keep = np.empty(len(own), dtype=bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
