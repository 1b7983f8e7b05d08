"""Vectorised word, line and window kernels over the UTF-8 bytes of Arrow string columns.

Texts stay in their Arrow buffers: words are found with a byte class table, and every word or line gets a 64-bit hash,
the sum of a random number for each byte at its place; windows of words get polynomial hashes of the words'. Both come
from one prefix sum, so no Python object is made per word. A kernel call works on a slice of rows with at most
``SLICE_BYTES`` of text (a longer text is a slice of its own), which bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

#: The ASCII white space that separates words: tab, line feed, vertical tab, form feed, carriage return, space.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply), so that near inputs give unrelated outputs."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Places in an item whose random numbers are looked up.
PLACES = 512
_TABLE = mix(np.arange(PLACES << 8, dtype=np.uint64) + _U(0x9E3779B97F4A7C15))


class Items:
    """Hashes of items (words, lines) that begin at ``starts`` and don't overlap: of each, or of beginnings of each."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.starts = starts
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        if len(starts):
            begin = int(starts[0])
            place = np.arange(begin, len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
            at = (place << 8) | data[begin:]
            number = _TABLE[np.minimum(at, len(_TABLE) - 1)]
            far = np.flatnonzero(place >= PLACES)
            if len(far):
                number[far] = mix(at[far].astype(np.uint64) + _U(0x9E3779B97F4A7C15))
            np.cumsum(number, out=self.sums[begin + 1 :])

    def hashes(self, ends: np.ndarray) -> np.ndarray:
        return mix(self.sums[ends] - self.sums[self.starts] + mix((ends - self.starts).astype(np.uint64)))


class Polynomial:
    """Prefix-sum polynomial hashing of 64-bit hashes, modulo 2**64 with an odd base; ranges hash in constant time.

    For short windows (some dozens of hashes): long sequences of a certain regular form have equal hashes in any base."""

    def __init__(self, seed: int):
        self.base = int(mix(np.array([seed], dtype=np.uint64))[0]) | 1
        self.back = pow(self.base, -1, 1 << 64)
        self.seed = seed
        self._up = self._down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 1 << 16)
            up, down = np.full(size, self.base, dtype=np.uint64), np.full(size, self.back, dtype=np.uint64)
            up[0] = down[0] = 1
            self._up, self._down = np.multiply.accumulate(up), np.multiply.accumulate(down)
            if n > 4 * SLICE_BYTES:  # a rare long text must not pin its powers
                kept = self._up, self._down
                self._up = self._down = np.ones(1, dtype=np.uint64)
                return kept
        return self._up, self._down

    def ranges(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for each pair."""
        up, down = self._powers(len(values) + 1)
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(self.seed * 2 + 1))


HASH_A, HASH_B = Polynomial(11), Polynomial(23)


class Texts:
    """Rows of one string column as bytes: ``data`` and the ``offsets`` of each row; nulls are empty."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        wide = pa.types.is_large_string(column.type)
        _, offsets, data = column.buffers()
        n = len(column)
        if n and offsets is not None:
            at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
        else:
            at = np.zeros(n + 1, dtype=np.int64)
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
        self.data, self.offsets, self.rows = whole[at[0] : at[-1]], at - at[0], n

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes of a class that don't cross rows: starts, ends, and the run offsets of each row."""
        if not len(self.data):
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(self.rows + 1, dtype=np.int64)
        mask = inside[self.data]
        before, after = np.empty_like(mask), np.empty_like(mask)
        before[0] = after[-1] = False
        before[1:], after[:-1] = mask[:-1], mask[1:]
        first, last = self.offsets[:-1], self.offsets[1:]
        before[first[first < len(mask)]] = False
        after[last[last > 0] - 1] = False
        starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(~SPACE)

    def count(self, inside: np.ndarray) -> np.ndarray:
        """Bytes of a class in each row."""
        sums = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(inside[self.data], out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each item, from the item offsets of rows."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def windows(hashes: np.ndarray, offsets: np.ndarray, size: int, poly: Polynomial = HASH_A) -> tuple[np.ndarray, np.ndarray]:
    """Item positions at which a window of ``size`` items lies within its row, and the windows' hashes."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.flatnonzero(np.arange(len(hashes)) + size <= ends)
    return at, poly.ranges(hashes, at, at + size) if len(at) else np.zeros(0, dtype=np.uint64)


def covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n items lie in a run of ``size`` items that starts at one of ``at``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge)[:n] > 0


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows again, in pieces of at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = Texts(batch.column(batch.schema.get_field_index(column))).offsets[1:]
        begin = 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
