"""MinHash signatures and exact Jaccard similarities of shingle sets, vectorised over Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from skybias.llm import texts

BLOCK = 1 << 15  # shingles whose hashes stay in a core's cache
_ODD = np.uint32(0x85EBCA6B)
BRIEF = 2048  # values of a set whose 16 bits still tell it from others


def seeds(n: int) -> np.ndarray:
    return (texts.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signatures(values: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """One row of ``n`` minima per set, for sets that are not empty (uint32)."""
    out = np.empty((len(offsets) - 1, n), np.uint32)
    factor, row = seeds(n), 0
    held = np.empty((2, max(BLOCK, int(np.diff(offsets).max(initial=0)))), np.uint32)
    while row < len(out):
        end = min(max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1), len(out))
        part, at = values[offsets[row]:offsets[end]], offsets[row:end] - offsets[row]
        x, shifted = held[:, :len(part)]
        for i in range(n):
            np.multiply(part, factor[i], out=x)
            np.right_shift(x, np.uint32(15), out=shifted)
            x ^= shifted
            x *= _ODD
            out[row:end, i] = np.minimum.reduceat(x, at)
        row = end
    return out


def shortened(signature: np.ndarray) -> np.ndarray:
    """16 bits of each of the 32-bit minima, mixed first: the upper bits of the minima of a large set are all zero."""
    return ((signature ^ signature >> np.uint32(15)) * _ODD >> np.uint32(16)).astype(np.uint16)


def run_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """Keys of the runs of ``rows`` coordinates: equal where the run's number and all its values are."""
    n, width = signature.shape
    keys = np.zeros((n, width // rows), np.uint64)
    for j in range(rows):
        keys = texts.mix(keys + signature[:, j::rows][:, :width // rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return texts.mix(keys + np.arange(1, width // rows + 1, dtype=np.uint64))


def sketches(signature: np.ndarray) -> np.ndarray:
    """Four bits of each of the 16-bit values of every row, two values in a byte: equal values have equal bits."""
    low = (signature & 15).astype(np.uint8)
    if low.shape[1] % 2:
        low = np.pad(low, ((0, 0), (0, 1)))
    return low[:, ::2] | low[:, 1::2] << 4


def sketch_agreement(one: np.ndarray, two: np.ndarray, width: int) -> np.ndarray:
    """Row by row: the number of the ``width`` values whose bits are equal, which is at least that of the equal values."""
    other = one ^ two
    return ((other & 15) == 0).sum(1) + (other < 16).sum(1) - width % 2


def word_sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Distinct shingles of ``n`` words of each row, as (first row, end row, hashes, offsets)."""
    for a, b, word, first in texts.words(column):
        value, row = texts.shingles(word, first, n)
        yield a, b, *texts.distinct(value, row, b - a)


def char_shingles(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Shingles of ``n`` code points of each row, repeats included; a shorter row is one shingle, an empty one has none."""
    raw, offsets = texts.buffers(column)
    for a, b in texts.slices(offsets, BLOCK):
        part, at = raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        code = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)
        before = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        first = before[at]
        size = np.diff(first)
        value = np.zeros(max(len(code) - n + 1, 0), np.uint32)
        for j in range(n):
            value = value * np.uint32(0x01000193) + code[j:j + len(value)] + np.uint32(7)
        per_row = np.where(size >= n, size - n + 1, np.minimum(size, 1))
        end = np.cumsum(per_row)
        begin = np.repeat(first[:-1] - (end - per_row), per_row) + np.arange(end[-1] if len(end) else 0)
        short = np.flatnonzero((size < n) & (size > 0))
        out = value[np.minimum(begin, max(len(value) - 1, 0))] if len(value) else np.zeros(len(begin), np.uint32)
        if len(short):
            x = size[short].astype(np.uint64) + np.uint64(1 << 32)
            for j in range(n - 1):
                c = code[np.minimum(first[:-1][short] + j, len(code) - 1)].astype(np.uint64)
                x = np.where(size[short] > j, texts.mix(x * np.uint64(31) + c), x)
            out[end[short] - 1] = (x >> np.uint64(32)).astype(np.uint32)
        out ^= out >> np.uint32(16)
        out *= np.uint32(0xC2B2AE35)
        out ^= out >> np.uint32(13)
        yield a, b, out, np.concatenate([[0], end])


def distinct_shingles(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 32-bit values of each row, sorted within the row, and the offsets of the rows."""
    rows = len(offsets) - 1
    both = np.sort(np.repeat(np.arange(rows, dtype=np.uint64) << np.uint64(32), np.diff(offsets)) | values)
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    return both.astype(np.uint32), np.searchsorted(both, np.arange(rows + 1, dtype=np.uint64) << np.uint64(32))


def brief(values: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """16 bits of each value of a set, every one once; None for large sets, where they would say too little."""
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        out.append(np.unique((values[a:b] & values.dtype.type(0xFFFF)).astype(np.uint16)).tobytes() if b - a <= BRIEF else None)
    return out


def may_be_alike(p: np.ndarray, q: np.ndarray, held: list[np.ndarray | None], size: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of places (sorted by ``p``) have enough values of ``held`` in common for a Jaccard similarity of ``least``; those without ``held`` may.

    Common values have common bits, but for those that share their bits with another value of the same set.
    """
    keep, flag = np.ones(len(p), bool), np.zeros(1 << 16, bool)
    first = np.flatnonzero(np.diff(p, prepend=-1))
    for i, j in zip(first, np.append(first[1:], len(p)) if len(p) else first, strict=True):
        x, one = p[i], held[p[i]]
        k = np.array([k for k in range(i, j) if one is not None and held[q[k]] is not None], np.int64)
        if not len(k):
            continue
        flag[one] = True
        others = [held[y] for y in q[k]]
        each = np.array([len(o) for o in others])
        both = np.add.reduceat(flag[np.concatenate(others)].astype(np.int64), np.cumsum(each) - each)
        flag[one] = False
        both += np.minimum(size[x] - len(one), size[q[k]] - each)
        keep[k] = both >= least / (1 + least) * (size[x] + size[q[k]]) * (1 - 1e-9)
    return keep


def overlaps(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row by row: size of both sets and of their intersection. Each side: (distinct values, offsets)."""
    rows = len(one[1]) - 1
    sizes = [np.diff(x[1]) for x in (one, two)]
    value = np.concatenate([one[0], two[0]])
    row = np.concatenate([np.repeat(np.arange(rows), s) for s in sizes])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    twice = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
    return sizes[0], sizes[1], np.bincount(row[1:][twice], minlength=rows)
