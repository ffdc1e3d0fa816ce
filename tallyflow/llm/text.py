"""Byte-level helpers that work on whole Arrow text columns at a time: words, hashes, lines."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once, which bounds the arrays of a task. A longer single text is its own chunk.
CHUNK_BYTES = 1 << 20
_BLOCK = 1 << 20

#: The separators of words: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_VALUES = np.random.default_rng(20_240_229).integers(1, 2**64 - 1, 256, dtype=np.uint64)[LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows in them; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES):
    """Slices of the batches with the bytes and row offsets of their text column, of about ``limit`` bytes each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = text_bytes(batch.column(text))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
            yield batch.slice(row, end - row), data[at[row]:at[end]], at[row:end + 1] - at[row]
            row = end
    pa.default_memory_pool().release_unused()  # the worker may wait, or run another operator, with what it holds


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true within rows: starts, ends, and the number of runs before each row offset."""
    n = inside.size
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1] | cut[1:n]
        last[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row: starts, ends, and the first word of each row (one entry more)."""
    return spans(~SPACE[data], offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS[0].size < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            up = np.full(max(n, _BLOCK), base, np.uint64)
            up[0] = 1
            _POWERS[k] = np.cumprod(up, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span with A-Z lower-cased; spans must be in order and not overlap."""
    out = np.empty(starts.size, np.uint64)
    i = 0
    while i < starts.size:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        low, high = starts[i], ends[j - 1]
        power, inverse = _powers(int(high - low) + 1)
        sums = np.zeros(int(high - low) + 1, np.uint64)
        np.cumsum(_VALUES[data[low:high]] * power[:high - low], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - low] - sums[starts[i:j] - low]) * inverse[starts[i:j] - low]
        i = j
    return mix(out)


def per_span(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each span."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return sums[ends] - sums[starts]
