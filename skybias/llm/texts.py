"""Word hashes of whole Arrow text columns, computed with numpy on the raw UTF-8 bytes.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z count as a-z. The hash of a word is a polynomial over
random 64-bit values of its bytes, so the hashes of all words of a column come from one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    values[ord("A"):ord("Z") + 1] = values[ord("a"):ord("z") + 1]
    return values


_VALUES = _byte_values()
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes; a longer row stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end
        row = end


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in ``raw``, and the number of words before each row."""
    solid = ~_BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    left, right = solid.copy(), solid.copy()
    left[1:] &= ~solid[:-1] | edge[1:-1]
    right[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(left), np.flatnonzero(right) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span."""
    n = len(raw)
    powers = np.full(n + 1, _BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[raw] * powers[:-1], out=total[1:])
    back = np.full(n + 1, _INVERSE, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows: first row, end row, the word hashes and the offset of each row's words among them."""
    raw, offsets = buffers(column)
    for a, b in slices(offsets):
        part, at = raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        starts, ends, first = spans(part, at)
        yield a, b, hashes(part, starts, ends), first


def shingles(word: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words and the row of each; a row with fewer words gives one shingle, without words none."""
    counts = np.diff(first)
    per_row = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), per_row)
    begin = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row) + first[row]
    length = np.minimum(counts[row], n)
    value = np.zeros(len(row), np.uint64)
    for j in range(n):
        inside = length > j
        at = np.minimum(begin + j, max(len(word) - 1, 0))
        step = mix(word[at] + np.uint64((j + 1) * _BASE % (1 << 64))) if len(word) else np.zeros(len(row), np.uint64)
        value += np.where(inside, step, np.uint64(0))
    return mix(value + length.astype(np.uint64)), row


def distinct(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, sorted within the row, and the offsets of the rows."""
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[new], row[new]
    return values, np.searchsorted(row, np.arange(rows + 1))
