"""Whole Arrow batches of texts as one byte array: hashes of substrings and words without a loop over rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n + 1:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0], _powers[1]


class Substrings:
    """Hashes of any substrings of ``data``, each in constant time; ``kind`` 0 and 1 are independent."""

    def __init__(self, data: np.ndarray, kind: int = 0):
        power, self.inverse = _power_tables(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[kind][data] * power[: len(data)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def all_of(self, q: int) -> np.ndarray:
        """The hash of the ``q`` bytes from every position on."""
        n = max(0, len(self.sums) - q)
        return (self.sums[q:] - self.sums[:n]) * self.inverse[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and the n + 1 offsets of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterable[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``most`` bytes of text (one row at least), with their bytes and offsets."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
            yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every row, and for each row the number of its first word (n + 1 entries)."""
    inside = ~SPACE[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    left, right = np.ones(n, bool), np.ones(n, bool)
    left[1:] = ~inside[:-1]
    right[:-1] = ~inside[1:]
    starts = np.flatnonzero(inside & (left | edge[:n]))
    ends = np.flatnonzero(inside & (right | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word with A-Z lower-cased, and each row's first word (n + 1 entries)."""
    starts, ends, first = word_bounds(data, offsets)
    return mix(Substrings(LOWER[data]).hashes(starts, ends) + (ends - starts).astype(np.uint64)), first
