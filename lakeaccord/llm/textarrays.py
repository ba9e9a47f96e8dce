"""Words and windows of whole Arrow text columns as numpy arrays, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
HASH_BYTES = 1 << 20

_BYTES = np.arange(256)
SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
NOT_SPACE = ~SPACE
#: Digits, a-z (after folding) and every byte of a character beyond ASCII.
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: A-Z to a-z, byte by byte; bytes beyond ASCII stay.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(256, dtype=np.uint64))
_BASE = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0xA0761D6478BD642F)


def strings(column) -> pa.Array:
    """One large_string array without nulls: a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def blocks(column, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows and the end) for runs of rows of about `limit` bytes."""
    column = strings(column)
    n = len(column)
    if not n:
        return
    _, places, content = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of word bytes; a run ends with its row."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    before, here = inside[:-1], inside[1:]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    lengths = ends - starts
    total = np.concatenate([[0], np.cumsum(lengths)])
    powers = np.full(int(lengths.max()), _BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(total, total[first] + HASH_BYTES, "right")) - 1)
        size, began = lengths[first:last], total[first:last] - total[first]
        inner = np.arange(int(total[last] - total[first])) - np.repeat(began, size)
        values = _BYTE_VALUES[data[inner + np.repeat(starts[first:last], size)]]
        values *= powers[inner]
        out[first:last] = np.add.reduceat(values, began)
        first = last
    return mix(out ^ (lengths.astype(np.uint64) * _STEP))


def window_hashes(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` consecutive words of one row, and the index of each window's first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[size - 1 :] == rows[:n])
    total, factor = np.zeros(n, np.uint64), np.uint64(1)
    for i in range(size):
        total += hashes[i : i + n] * factor
        factor = np.uint64((int(factor) * int(_STEP)) & 0xFFFFFFFFFFFFFFFF)
    return mix(total[at] ^ np.uint64(size)), at


def row_lists(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """An Arrow list per row 0..n-1 from values sorted by row."""
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
