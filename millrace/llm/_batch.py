"""Whole-text statistics over Arrow batches in numpy: words, shingles and windows without a Python loop per word.

Hashes are 64 bits: a polynomial over bytes with a random table, finished by splitmix64. Two different words or
shingles of one text or pair collide with a chance near 2^-64; sets compared by hash are compared exactly up to that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 21  #: bytes of text handled at once; a longer single text is handled alone
_RNG = np.random.RandomState(20240607)
_TABLE = _RNG.randint(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE[SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = _RNG.randint(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}
HELD: dict = {}  #: what a worker keeps from one task of an operator to the next; the first batch of another operator drops it


def _power(n: int, name: str, by: np.uint64) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE), by, np.uint64)
        have[0] = 1
        have = _powers[name] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    HELD.clear()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def slices(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE bytes."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """The words ([^\\x20\\x09-\\x0D]+) of the rows lo..hi of a text column."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lo: int, hi: int, lower: bool = False):
        self.at = at[lo : hi + 1] - at[lo]
        self.data = data[at[lo] : at[hi]]
        if lower:
            self.data = _LOWER[self.data]
        inside = ~SPACE[self.data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = self.at[1:-1]
        edges = edges[(edges > 0) & (edges < len(self.data))]
        before[edges] = False
        after[edges - 1] = False
        self.inside = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.at)  #: index of each row's first word; one more entry than rows
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        n = len(self.data)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(_TABLE[self.data] * _power(n, "mul", _MUL), self.starts)
            return mix(sums * _power(n, "inv", _INV)[self.starts])

    def windows(self, width: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all width-word windows that stay inside a row, and the index of each one's first word."""
        n = len(hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            total = hashes[:n] * _MIX[0]
            for j in range(1, width):
                total = total + hashes[j : j + n] * _MIX[j]
            whole = np.repeat(self.first[1:], self.count)[:n] - np.arange(n) >= width
            return mix(total)[whole], np.flatnonzero(whole)

    def shingle_sets(self, width: int) -> Iterator[np.ndarray]:
        """For each row the sorted distinct hashes of its shingles; a row with fewer words has its whole sequence as one."""
        h = self.hashes()
        found, where = self.windows(width, h)
        cuts = np.searchsorted(where, self.first)
        for i, n in enumerate(self.count):
            if n >= width:
                own = np.sort(found[cuts[i] : cuts[i + 1]])
                first = np.ones(len(own), bool)
                np.not_equal(own[1:], own[:-1], out=first[1:])
                yield own[first]
            elif n:
                own = h[self.first[i] : self.first[i + 1]]
                with np.errstate(over="ignore"):
                    yield mix((own * _MIX[:n]).sum(keepdims=True, dtype=np.uint64) + _MIX[32 + n])
            else:
                yield np.zeros(0, np.uint64)
