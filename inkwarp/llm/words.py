"""Words of text columns, found and hashed in numpy over the bytes of Arrow batches.

A word is a maximal run of ASCII letters, ASCII digits and characters beyond ASCII, in lower case.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK, SLICE = 1 << 20, 1_000_000
_M1, _M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _STEP)]))


_POWERS = _powers(256)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its rows' offsets in them; null is as an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def trim() -> None:
    """Gives freed memory back to the system; an idle worker would keep it beside the next ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most rows whole rows with about most bytes of a text column, as arrays made from them take many times as much."""
    for batch in batches:
        at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
        low = 0
        while low < batch.num_rows:
            high = min(low + rows, max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1))
            yield batch.slice(low, high - low)
            low = high
    trim()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end, row) of each word. Works through the bytes in chunks that end between words."""
    n = len(data)
    inside, cut = IS_WORD[data], np.zeros(n + 1, bool)
    cut[offsets] = True
    hashes, firsts, ends = [], [], []
    low = 0
    while low < n:
        high = min(n, low + CHUNK)
        while high < n:
            stop = np.flatnonzero(~inside[high : high + 4096] | cut[high : high + min(4096, n - high)])
            if len(stop):
                high += int(stop[0])
                break
            high = min(n, high + 4096)
        w = inside[low:high]
        first, last = w.copy(), w.copy()
        first[1:] &= ~w[:-1] | cut[low + 1 : high]
        last[:-1] &= ~w[1:] | cut[low + 1 : high]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(start):
            length = end - start
            begin = np.cumsum(length) - length
            at = np.arange(int(length.sum())) - np.repeat(begin, length)
            powers = _POWERS if (most := int(length.max())) <= len(_POWERS) else _powers(most)
            value = _BYTE[data[low:high][w]] * powers[at]
            hashes.append(mix(np.add.reduceat(value, begin) ^ length.astype(np.uint64)))
            firsts.append(start + low)
            ends.append(end + low)
        low = high
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.concatenate(firsts)
    return np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(offsets, start, "right") - 1


def column_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the words of a text column."""
    found = words(*buffers(pc.utf8_lower(column)))
    return found[0], found[3]


def grams(hashes: np.ndarray, rows: np.ndarray, n_rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct n-gram hashes in ascending order, and the rows' offsets in them.

    A row of fewer than n words has one gram of all its words; a row without words has none.
    """
    factors = mix(np.arange(11, 11 + n, dtype=np.uint64))
    m = len(hashes)
    g, r = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if m >= n:
        g = np.zeros(m - n + 1, np.uint64)
        for k in range(n):
            g += hashes[k : m - n + 1 + k] * factors[k]
        whole = rows[: m - n + 1] == rows[n - 1 :]
        g, r = g[whole], rows[: m - n + 1][whole]
    count = np.bincount(rows, minlength=n_rows) if m else np.zeros(n_rows, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        begin = np.cumsum(count) - count
        g = np.concatenate([g, np.array([np.sum(hashes[begin[i] : begin[i] + count[i]] * factors[: count[i]]) for i in short], np.uint64)])
        r = np.concatenate([r, short])
    g = mix(g)
    if len(short):
        order = np.argsort(r, kind="stable")
        g, r = g[order], r[order]
    bounds = np.searchsorted(r, np.arange(n_rows + 1))
    for i in range(n_rows):
        g[bounds[i] : bounds[i + 1]].sort()
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    g, r = g[keep], r[keep]
    return g, np.searchsorted(r, np.arange(n_rows + 1))
