"""Vectorised text work inside Arrow tasks: words, 64-bit word hashes and shingles.

Whole texts are handled in groups of about CHUNK bytes, so that memory follows the longest
text and not the Arrow batch. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: every input bit reaches every output bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_POWER = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    """0xD6E8FEB86659FD93 to the power 0 .. n-1."""
    global _POWER
    if len(_POWER) < n:
        more = np.full(max(n, 1024), 0xD6E8FEB86659FD93, U)
        more[0] = 1
        _POWER = np.cumprod(more)
    return _POWER


def kinds(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, set for the bytes in the given ranges."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Bytes of words that white space alone separates, and of words of letters, digits and non-ASCII.
SPACED = ~kinds((0x20, 0x20), (0x09, 0x0D))
ALNUM = kinds((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LINES = ~kinds((0x0A, 0x0A))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row groups (first, last) of about ``size`` bytes with their bytes and offsets."""
    data, offsets = text_bytes(column)
    first, rows = 0, len(column)
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of ``kind`` bytes within a row."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by content alone."""
    if not len(starts):
        return np.zeros(0, U)
    size = ends - starts
    total = int(size.sum())
    first = np.cumsum(size) - size
    small = np.int32 if len(data) < 1 << 30 else np.int64
    within = np.arange(total, dtype=small) - np.repeat(first.astype(small), size)
    value = _BYTE[data[within + np.repeat(starts.astype(small), size)]]
    value *= powers(int(size.max()) + 1)[within]
    summed = np.zeros(total + 1, U)
    np.cumsum(value, out=summed[1:])
    return mix(summed[first + size] - summed[first] + size.astype(U) * U(0xA0761D6478BD642F))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive entries of h, len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, U)
    out = np.zeros(len(h) - n + 1, U)
    p = powers(n + 1)
    for i in range(n):
        out += h[i : len(h) - n + 1 + i] * p[i + 1]
    return mix(out + U(n))


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles.

    Letters A-Z are lower-cased. A row of fewer words gives its whole sequence as one element;
    a row without words gives none.
    """
    for first, last, data, offsets in chunks(column):
        data = LOWER[data]
        starts, ends, row = words(data, offsets, SPACED)
        h = hashes(data, starts, ends)
        g = grams(h, n)
        bounds = np.searchsorted(row, np.arange(last - first + 1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= n:
                x = np.sort(g[a : b - n + 1])
                yield x[np.concatenate(([True], x[1:] != x[:-1]))]
            elif b > a:
                yield grams(h[a:b], b - a)
            else:
                yield h[:0]
