"""Vectorised helpers for text in Arrow batches: byte buffers, words, and hashes of any substring.

A polynomial prefix sum over a buffer gives the 64-bit hash of every substring in constant time, so words,
k-byte strings and longer passages all share one pass over the bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PIECE_BYTES = 2 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**n modulo 2**64, kept for the next call."""
    got = _powers.get(base)
    if got is None or len(got) <= n:
        got = np.full(max(n + 1, 1 << 20), base, U64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if len(got) <= 4 * PIECE_BYTES:
            _powers[base] = got
    return got


class Hasher:
    """Hashes of substrings of one buffer: ``h(starts, ends)`` for arrays of positions."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(BYTE_VALUES[data] * powers(_BASE, n)[:n], out=self.sums[1:])
        self.inverse = powers(_INVERSE, n)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])

    def windows(self, k: int) -> np.ndarray:
        """The hash of the k bytes at every position that has so many after it."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n])


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch | pa.Table, column: str = "text", limit: int = PIECE_BYTES) -> Iterator:
    """Slices of whole rows with about ``limit`` bytes of text each, or one row if that is longer."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(np.asarray(sizes, np.int64))
    row = 0
    while row < batch.num_rows:
        before = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(row, stop - row)
        row = stop


def words(data: np.ndarray, offsets: np.ndarray, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and ``len(offsets)`` counts of the words before each row; no word crosses rows."""
    inside = ~spaces[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < len(data)]
    starts[first] = inside[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) + 1, np.searchsorted(at, offsets)


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of ``size`` consecutive words; a row of fewer words has one for all of them."""
    factor = U64(0xD6E8FEB86659FD93)
    n = len(hashes) - size + 1
    if n > 0:
        rolled = hashes[:n].copy()
        for i in range(1, size):
            rolled *= factor
            rolled += hashes[i : i + n]
        rolled = mix(rolled)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            h = U64(0x5851F42D4C957F2D + (b - a))
            with np.errstate(over="ignore"):
                for x in hashes[a:b]:
                    h = h * factor + x
            out.append(mix(np.array([h], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def text_shingles(column: pa.Array | pa.ChunkedArray, size: int = 5) -> list[np.ndarray]:
    """The shingle set of each text of a column: words between ASCII white space, A-Z in lower case."""
    data, offsets = buffers(column)
    data = LOWER[data]
    starts, ends, rows = words(data, offsets)
    return shingles(Hasher(data)(starts, ends), rows, size)


def mix_light(x: np.ndarray) -> np.ndarray:
    """One round of mixing in place, for values that are already well spread."""
    x ^= x >> U64(32)
    return x


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there on glibc only


def release() -> None:
    """Hand memory that is kept from a group that is done back to the system, for the next worker or the JVM."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)
