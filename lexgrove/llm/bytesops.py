"""Vectorised text primitives on the UTF-8 buffers of Arrow string columns.

A column is taken as one byte buffer and row offsets, so that words, hashes and n-grams of thousands of
documents come from a few numpy passes and no Python object is made per word.

A word is a maximal run of ASCII letters, ASCII digits and bytes of non-ASCII characters. Letters are compared
without case for ASCII and Latin-1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """1, m, m^2, ... modulo 2^64, at least n of them."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), _MULT, np.uint64)
        grown[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(grown)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def text_slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = column_bytes(column)
    for a, b in slices(offsets, most):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters; no byte changes its place."""
    low = _FOLD[data]
    if len(data) > 1:
        lead = np.flatnonzero(data[:-1] == 0xC3) + 1
        lead = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
        low[lead] += 0x20
    return low


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each row the index of its first word (with a last entry)."""
    inside = _WORD[data] if is_word is None else is_word
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the given spans, which ascend and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    within = np.arange(total) - np.repeat(first, lengths)
    values = low[within + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    values *= powers(int(lengths.max()) + 1)[within]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, index of each row's first word, and hashes of the lower-cased words."""
    starts, ends, rows = word_bounds(data, offsets)
    return starts, ends, rows, span_hashes(fold(data), starts, ends)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each place on; the last n - 1 places are left out. Rows aren't regarded."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].astype(np.uint64, copy=True)
    for k in range(1, n):
        out *= _MULT
        out += h[k : k + m]
    return mix(out)


def within_rows(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row index and place of every n-gram that stays within a row (rows: first word of each row, with a last entry)."""
    count = np.maximum(np.diff(rows) - n + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    return row, np.arange(int(count.sum())) - np.repeat(first - rows[:-1], count)


def char_index(data: np.ndarray) -> np.ndarray:
    """Number of characters before each byte, and after the last."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
