"""Words of whole Arrow batches as 64-bit numbers, without a Python object per word.

A word is a run of bytes for which the given table says so; two words are equal when their
numbers are. Numbers come from a running sum over the bytes of a slice, so the work is linear
in the bytes and the extra memory is bounded by the slice, not by the batch or the longest text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODE = np.random.Generator(np.random.PCG64(20240229)).integers(
    1, 1 << 63, 256, dtype=np.uint64
) * np.uint64(2) + np.uint64(1)

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything but space and the control characters 09 to 0D belongs to a word.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: Letters, digits and every byte of a character outside ASCII belong to a word.
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for slot, base in enumerate((_ODD, _INVERSE)):
            table = np.full(max(n, SLICE), base, dtype=np.uint64)
            table[0] = 1
            _powers[slot] = np.cumprod(table)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit number over all its bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def number_of(word: bytes) -> int:
    """The number that ``hashes`` gives a single word."""
    data = np.frombuffer(word, dtype=np.uint8)
    return int(hashes(data, np.array([0]), np.array([len(data)]))[0])


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and where each row begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, starts, data = column.buffers()
    begin = np.frombuffer(starts, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or len(begin) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    body = np.frombuffer(data, dtype=np.uint8)[begin[0]:begin[-1]]
    return body, begin - begin[0]


def hashes_within(
    data: np.ndarray, start: np.ndarray, end: np.ndarray,
    parts: list[tuple[np.ndarray, np.ndarray]],
) -> list[np.ndarray]:
    """For each (from, to) in ``parts`` one number per word; a part lies within its word.

    Words, given by ``start`` and ``end``, are in order and do not overlap.
    """
    out = [np.empty(len(start), dtype=np.uint64) for _ in parts]
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(end, start[first] + SLICE, "right")))
        low, high = int(start[first]), int(end[last - 1])
        power, inverse = _power_tables(high - low + 1)
        running = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODE[data[low:high]] * power[:high - low], out=running[1:])
        for slot, (begin, stop) in zip(out, parts, strict=True):
            a, b = begin[first:last] - low, stop[first:last] - low
            slot[first:last] = (running[b] - running[a]) * inverse[a] + (b - a).astype(np.uint64)
        first = last
    return [mix(x) for x in out]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One number per byte range ``start:end``; ranges are in order and do not overlap."""
    return hashes_within(data, start, end, [(start, end)])[0]


@dataclass
class Words:
    """``start`` and ``end`` of each word in ``data``; ``first[i]`` is the first word of row i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def numbers(self) -> np.ndarray:
        return hashes(self.data, self.start, self.end)


def split(column: pa.Array, member: np.ndarray = NOT_SPACE, lower: bool = True) -> Words:
    """The words of every row; no word crosses two rows."""
    data, begin = texts(column)
    inside = member[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    before[begin[:-1]] = False
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    after[begin[1:]] = False
    start = np.flatnonzero(inside & ~before[:-1])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    first = np.searchsorted(start, begin)
    return Words(LOWER[data] if lower else data, start, end, first)
