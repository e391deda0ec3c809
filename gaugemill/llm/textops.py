"""Words and rolling hashes of whole Arrow string columns, in numpy.

A word is a run of bytes other than space and 0x09-0x0D; folding lowers A-Z only. Hashes have 64 bits and are the
same in every process, so they can be shuffled and compared between tasks. Texts are taken whole; a block of
neighbouring rows of about ``BLOCK`` bytes is worked on at a time, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_FOLDED = np.concatenate([_BYTE[:65], _BYTE[97:123], _BYTE[91:]])
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_COEFFICIENT = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_SECOND = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + 4096)
        made = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


@dataclass
class Words:
    """Words of rows ``lo`` to ``hi``: byte positions in ``data``, and of each row the index of its first word."""

    lo: int
    hi: int
    data: np.ndarray
    row_at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    sums: np.ndarray | None

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the (folded) bytes of each span, wherever it stands."""
        _, inverse = _powers(len(self.data) + 1)
        return mix((self.sums[ends] - self.sums[starts]) * inverse[starts])

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)


def blocks(column: pa.Array, fold: bool = True, hashed: bool = True) -> Iterator[Words]:
    """The column's rows in order, a block at a time; null counts as the empty text."""
    column = pc.fill_null(column, "") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    buffers, n = column.buffers(), len(column)
    at = np.frombuffer(buffers[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK, "right")) - 1)
        yield _split(lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], fold, hashed)
        lo = hi


def _split(lo: int, hi: int, data: np.ndarray, row_at: np.ndarray, fold: bool, hashed: bool) -> Words:
    inside = ~SPACE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = row_at[1:-1]
    here, before = edge[edge < len(data)], edge[edge > 0] - 1
    opens[here], closes[before] = inside[here], inside[before]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    sums = None
    if hashed:
        powers, _ = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _BYTE)[data] * powers[: len(data)], out=sums[1:])
    return Words(lo, hi, data, row_at, starts, ends, np.searchsorted(starts, row_at), sums)


def windows(hashes: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """Hash of each run of ``size`` values, in order (runs may cross rows; see ``within``); ``second``, another hash,
    which with the first has 128 bits."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * (_SECOND if second else _COEFFICIENT)[k]
    return mix(out + np.uint64(size))


def within(row_of: np.ndarray, size: int) -> np.ndarray:
    """Which of those runs lie in one row."""
    return row_of[: max(0, len(row_of) - size + 1)] == row_of[size - 1 :]


def whole(hashes: np.ndarray) -> np.uint64:
    """Hash of one sequence of fewer than 64 values."""
    return mix(np.array([np.sum(hashes * _COEFFICIENT[: len(hashes)], dtype=np.uint64) + np.uint64(len(hashes))], np.uint64))[0]


def set_of(words: Words, hashes: np.ndarray, shingles: np.ndarray, row: int, size: int) -> np.ndarray:
    """Sorted distinct shingles of one row of the block; a shorter row is one shingle, an empty one has none."""
    a, b = int(words.first[row]), int(words.first[row + 1])
    if b - a >= size:
        return np.unique(shingles[a : b - size + 1])
    return np.array([whole(hashes[a:b])], np.uint64) if b > a else np.zeros(0, np.uint64)
