"""Words of UTF-8 text by numpy, for operators that read whole texts inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class Words(NamedTuple):
    """Words in order of place; positions are bytes of the texts laid end to end."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray


def byte_class(letters: bool = True, digits: bool = True) -> np.ndarray:
    """Which bytes belong to words: ASCII letters, digits, and all of 0x80 and above."""
    table = np.zeros(256, dtype=bool)
    table[0x80:] = True
    if letters:
        table[ord("A") : ord("Z") + 1] = True
        table[ord("a") : ord("z") + 1] = True
    if digits:
        table[ord("0") : ord("9") + 1] = True
    return table


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


LOWER = _lower()
_BYTE_VALUE = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MIX


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row begins (null is empty)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes together; a longer row stands alone."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Maximal runs of word bytes that do not cross rows; A-Z hash like a-z."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, none.astype(np.uint64))
    inside = table[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return Words(starts, ends, rows, _hashes(data, inside, ends - starts))


def _hashes(data: np.ndarray, inside: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    if not len(lengths):
        return np.zeros(0, dtype=np.uint64)
    values = _BYTE_VALUE[LOWER[data[inside]]]
    firsts = np.cumsum(lengths) - lengths
    places = np.arange(len(values)) - np.repeat(firsts, lengths)
    powers = np.full(int(lengths.max()), _FACTOR, dtype=np.uint64)
    powers[0] = 1
    sums = np.add.reduceat(values * np.cumprod(powers)[places], firsts)
    sums ^= sums >> np.uint64(31)
    return sums * _FACTOR
