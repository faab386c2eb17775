"""Numpy kernels over the bytes of a batch of texts, used inside Arrow tasks.

A text column of a record batch is one byte buffer with offsets.  Words, their hashes and
hashes of sliding windows are found for all texts of a block at once, without a Python
step per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS: dict[int, np.ndarray] = {}


def powers(of: int, n: int) -> np.ndarray:
    """of**0 .. of**(n-1) modulo 2**64."""
    have = _POWERS.get(of)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 4096)
        steps = np.full(size, of, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[of] = np.multiply.accumulate(steps)
    return have[:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    if len(column) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32, count=len(column) + column.offset + 1)[column.offset :].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of whole texts of about ``size`` bytes."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, and for each text the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    m = is_word[data]
    edge = np.empty(len(m) + 1, bool)
    edge[1:-1] = m[1:] & ~m[:-1]
    edge[0], edge[-1] = m[0], False
    cut = offsets[:-1][offsets[:-1] < offsets[1:]]
    edge[cut] = m[cut]
    starts = np.flatnonzero(edge)
    edge[1:-1] = m[:-1] & ~m[1:]
    edge[0], edge[-1] = False, m[-1]
    cut = offsets[1:][offsets[:-1] < offsets[1:]]
    edge[cut] = m[cut - 1]
    ends = np.flatnonzero(edge)
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums whose differences, shifted, hash any slice."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_VALUE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def slice_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts] + (ends - starts).astype(np.uint64))


def word_set(pattern_excludes: list[tuple[int, int]]) -> np.ndarray:
    """Table of the bytes that belong to words: all but the given ranges."""
    table = np.ones(256, bool)
    for a, b in pattern_excludes:
        table[a : b + 1] = False
    return table
