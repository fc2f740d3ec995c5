"""Vectorised helpers over Arrow string columns: words, word hashes, shingles.

Words are maximal runs of characters other than space and ``\\t``-``\\r``; hashes see ``A-Z`` in lower
case.  Everything works on blocks of about a megabyte, so a batch of very long texts needs no more
memory than its word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd multipliers."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * _BASE + np.uint64(seed)
    return mix(steps) | np.uint64(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _BASE), np.full(n + 1, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the offsets of each row's words."""
    inside = ~SEPARATOR[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its lower-cased bytes, then mixed."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        first, last = starts[i], ends[j - 1]
        up, down = _powers(BLOCK) if last - first <= BLOCK else _powers.__wrapped__(int(last - first))
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum((LOWER[data[first:last]].astype(np.uint64) + np.uint64(1)) * up[: last - first], out=sums[1:])
        s, e = starts[i:j] - first, ends[i:j] - first
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def shingle_hashes(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles in order, and the offsets of each row's shingles.

    A row of fewer words has one shingle, its whole sequence; a row without words has none.
    """
    weights = constants(size, 17)
    n = np.diff(at)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    rows = np.repeat(np.arange(len(n)), counts)
    begins = at[:-1][rows] + np.arange(offsets[-1]) - offsets[:-1][rows]
    length = np.minimum(n, size)[rows]
    h = length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    short = bool(len(length)) and int(length.min()) < size
    for k in range(size):
        term = padded[begins + k] * weights[k]
        h += np.where(length > k, term, np.uint64(0)) if short else term
    return mix(h), offsets


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split a string column into runs of rows of about ``most`` bytes: (first, end, bytes, offsets)."""
    data, offsets = utf8(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def shingles(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each block of rows: (first, end, shingle hashes, offsets)."""
    for i, j, data, offsets in blocks(column):
        starts, ends, at = word_bounds(data, offsets)
        yield i, j, *shingle_hashes(word_hashes(data, starts, ends), at, size)


def distinct(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, and their offsets."""
    if not len(h):
        return h, offsets
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    h, rows = h[new], rows[new]
    return h, np.searchsorted(rows, np.arange(len(offsets)))


def reduce_rows(op: np.ufunc, values: np.ndarray, offsets: np.ndarray, empty) -> np.ndarray:
    """``op`` over each row's values; ``empty`` where a row has none."""
    out = np.full((len(offsets) - 1, *values.shape[1:]), empty, values.dtype)
    full = offsets[:-1] < offsets[1:]
    if full.any():
        out[full] = op.reduceat(values, offsets[:-1][full], axis=0)
    return out
