"""Vectorised words and word hashes over Arrow text columns.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return; as all of these are ASCII, UTF-8 text is cut as bytes.
All functions work on bounded slices, so that memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 20

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


@dataclass
class Words:
    """Words of a slice of documents: byte spans, the document of each, and the count per document."""

    data: np.ndarray
    first: int
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    firsts: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def index(self) -> np.ndarray:
        """Position of each word in its document."""
        return np.arange(len(self.starts)) - np.repeat(self.firsts, self.counts)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most ``most`` bytes, or of one document."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high
        low = high


def words(offsets: np.ndarray, data: np.ndarray, low: int, high: int) -> Words:
    """The words of documents ``low`` to ``high``."""
    base = int(offsets[low])
    part = data[base : int(offsets[high])]
    bounds = offsets[low : high + 1] - base
    inside = _IS_WORD[part]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(part))]
    opens[cuts] |= inside[cuts]
    closes[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    firsts = np.searchsorted(starts, bounds)
    return Words(part, low, starts, ends, np.diff(firsts), firsts[:-1])


def _power_tables(size: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << (max(size, 1) - 1).bit_length(), SLICE_BYTES)
    if (size, which) not in _powers:
        p = int(_MULTIPLIERS[which])
        both = []
        for base in (p, pow(p, -1, 1 << 64)):
            out = np.empty(size, np.uint64)
            out[0], n, step = 1, 1, base
            while n < size:
                out[n : 2 * n] = out[:n] * np.uint64(step)
                n, step = 2 * n, step * step % (1 << 64)
            both.append(out)
        if size > SLICE_BYTES:
            return both[0], both[1]
        _powers[size, which] = both[0], both[1]
    return _powers[size, which]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(w: Words, which: int = 0) -> np.ndarray:
    """A 64-bit polynomial hash of every word, from prefix sums over the bytes."""
    up, down = _power_tables(len(w.data) + 1, which)
    sums = np.zeros(len(w.data) + 1, np.uint64)
    np.cumsum((w.data.astype(np.uint64) + np.uint64(1)) * up[: len(w.data)], out=sums[1:])
    return mix((sums[w.ends] - sums[w.starts]) * down[w.starts] + (w.ends - w.starts).astype(np.uint64))


def window_hashes(hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A hash of each run of ``length`` word hashes (one for each start, without those cut off)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out *= _MULTIPLIERS[which]
        out += hashes[k : k + n]
    return mix(out)


def spark_xxhash64(x: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of a column of longs, signed as there."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(v: np.ndarray, k: int) -> np.ndarray:
        return (v << np.uint64(k)) | (v >> np.uint64(64 - k))

    h = np.full(len(x), 42 + 8, np.uint64) + p5
    h ^= turn(x.astype(np.int64).view(np.uint64) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)
