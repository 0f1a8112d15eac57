"""Words of UTF-8 texts as numpy arrays: byte spans, owners and 64-bit keys.

A key is a polynomial hash over the bytes of a word, read from one running sum per block, so no
Python code runs per word. Keys stand for words throughout this subpackage: two of n different
words meet with a chance of about n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
GROUP = 4 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


class Runs(NamedTuple):
    """Maximal runs without a separator: owner in the batch, first byte, byte after, key."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of a key may be used alone."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=None)
def _letters(lower: bool) -> np.ndarray:
    """A random 64-bit number per byte; with ``lower``, A-Z have those of a-z."""
    t = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if lower:
        t[65:91] = t[97:123]
    return t


@lru_cache(maxsize=None)
def _separators(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


WHITE = b"\t\n\v\f\r "


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def series(base: int) -> np.ndarray:
        x = np.full(n + 1, base, dtype=np.uint64)
        x[0] = 1
        return np.cumprod(x, dtype=np.uint64)

    return series(_BASE), series(pow(_BASE, -1, 1 << 64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    a = pc.fill_null(column, "").cast(pa.large_binary())
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    body = a.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data, offsets


def groups(offsets: np.ndarray, limit: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or one longer row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def runs(data: np.ndarray, offsets: np.ndarray, lower: bool = False, separators: bytes = WHITE) -> Runs:
    """Maximal runs without separators in the rows that ``offsets`` bound, in order."""
    base, end = int(offsets[0]), int(offsets[-1])
    is_sep, letters = _separators(separators), _letters(lower)
    first = np.zeros(end - base + 1, dtype=bool)
    first[offsets - base] = True
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    pos = base
    while pos < end:
        stop = min(pos + BLOCK, end)
        while stop < end:  # a block ends where a run does
            cut = np.flatnonzero(is_sep[data[stop : stop + 4096]] | first[stop - base : min(stop + 4096, len(data)) - base][: len(data[stop : stop + 4096])])
            if len(cut):
                stop += int(cut[0])
                break
            stop = min(stop + 4096, end)
        b = data[pos:stop]
        sep = is_sep[b]
        new = first[pos - base + 1 : stop - base]
        begin = ~sep
        last = begin.copy()
        begin[1:] &= sep[:-1] | new
        last[:-1] &= sep[1:] | new
        s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
        size = BLOCK
        while size < len(b):
            size *= 2
        up, down = _powers(size)
        total = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(letters[b] * up[: len(b)], out=total[1:])
        key = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        found.append((s + pos, e + pos, key))
        pos = stop
    if found:
        start, stop_, key = (np.concatenate(x) for x in zip(*found))
    else:
        start, stop_, key = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Runs(doc, start, stop_, key)


def bounds(doc: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` rows begins in arrays sorted by ``doc``, and their end."""
    return np.searchsorted(doc, np.arange(n + 1))


def windows(key: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of ``n`` consecutive words of one row, and the index of each window's first word."""
    if len(key) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(key) - n + 1
    total = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + key[j : j + m]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(total[at]), at


def row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags in each row; ``flags`` starts at offsets[0]."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    at = offsets - offsets[0]
    return total[at[1:]] - total[at[:-1]]
