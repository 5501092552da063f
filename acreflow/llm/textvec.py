"""Words and word shingles of Arrow string batches as numpy arrays.

A batch is cut into pieces of about a megabyte, so memory is bounded by that
and by the longest single text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C1B  # 3 mod 8
_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table() -> np.ndarray:
    """A random 64-bit value for each byte; A-Z have those of a-z."""
    table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    table[65:91] = table[97:123]
    return table


_TABLE = byte_table()
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES):
    """(i, j) of consecutive rows of at most ``limit`` bytes together, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def spans(data: np.ndarray, at: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: a run of bytes that aren't blank, by default ``[^\\x20\\x09-\\x0D]+``."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = solid.copy()
    starts[1:] &= edge[1:-1] | ~solid[:-1]
    ends = solid
    ends[:-1] &= edge[1:-1] | ~np.roll(solid, -1)[:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(at, first, "right") - 1


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, PIECE_BYTES + 1)
        out = []
        for base in (_BASE, _INV):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _powers = tuple(out)
    return _powers


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
    """64-bit hashes of the words, with the default table A-Z taken as a-z."""
    up, down = powers(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=run[1:])
    return mix64((run[last] - run[first]) * down[first])


def shingles(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``k`` words; a row with fewer words gives all of them as one."""
    step = [np.uint64(int(mix64(np.array([i + 1], np.uint64))[0]) | 1) for i in range(k)]
    n = len(hashes)
    if n >= k:
        total = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            total += hashes[i : n - k + 1 + i] * step[i]
        inside = row[: n - k + 1] == row[k - 1 :]
        long_h, long_r = mix64(total[inside]), row[: n - k + 1][inside]
    else:
        long_h, long_r = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not n:
        return long_h, long_r
    heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    counts = np.diff(np.r_[heads, n])
    few = heads[counts < k]
    if not len(few):
        return long_h, long_r
    few_n = counts[counts < k]
    total = few_n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(k - 1):
        has = few_n > i
        total[has] += hashes[few[has] + i] * step[i]
    h, r = np.r_[long_h, mix64(total)], np.r_[long_r, row[few]]
    order = np.argsort(r, kind="stable")
    return h[order], r[order]


def distinct(h: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, by row and then hash."""
    if not len(h):
        return h, r
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]
    return h[new], r[new]


def shingle_sets(column: pa.Array, k: int):
    """Pieces of a column: first row, rows, and hash and row (from the first) of each distinct shingle."""
    data, at = buffers(column)
    for i, j in pieces(at):
        part, off = data[at[i] : at[j]], at[i : j + 1] - at[i]
        first, last, row = spans(part, off)
        yield i, j - i, *distinct(*shingles(word_hashes(part, first, last), row, k))
