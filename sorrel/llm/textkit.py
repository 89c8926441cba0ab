"""Vectorised text primitives shared by the operators: Arrow buffers in, numpy arrays out.

Texts are handled as one UTF-8 byte array with document offsets, so that tokenising and
hashing cost a few nanoseconds a byte and no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_SPACE = np.ones(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[95] = True
_ALNUM[128:] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (murmur style): every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2 ** 64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(size, U64)
        done = 1
        while done < size:
            have[done : 2 * done] = have[:done] * U64(pow(base, done, 1 << 64))
            done *= 2
        if size <= 1 << 21:
            _powers[base] = have
    return have[:n]


@dataclass
class Texts:
    """UTF-8 bytes of several texts; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def char_prefix(self) -> np.ndarray:
        """Number of characters before each byte position (one longer than data)."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes with inside set, never across texts: starts, ends, first run of each text."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.offsets), np.int64)
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:]
        first = self.offsets[:-1][self.offsets[:-1] < n]
        begin[first] = inside[first]
        last = self.offsets[1:][self.offsets[1:] > 0] - 1
        end[last] = inside[last]
        starts = np.flatnonzero(begin)
        return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, self.offsets)

    def words(self, kind: str = "space") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of non-space bytes, or (kind "alnum") of ASCII letters, digits, underscores and non-ASCII bytes."""
        return self.spans((_SPACE if kind == "space" else _ALNUM)[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines that hold more than white space, trimmed of ASCII white space at both ends."""
        starts, ends, first = self.spans(self.data != 10)
        if not len(starts):
            return starts, ends, first
        solid = np.zeros(len(self.data) + 1, np.int64)
        where = np.flatnonzero(_SPACE[self.data])
        np.cumsum(_SPACE[self.data], out=solid[1:])
        keep = solid[ends] > solid[starts]
        lo, hi = where[solid[starts[keep]]], where[solid[ends[keep]] - 1] + 1
        return lo, hi, np.searchsorted(lo, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for many spans: differences of one running polynomial."""
        if not len(starts):
            return np.zeros(0, U64)
        n = len(self.data)
        run = np.zeros(n + 1, U64)
        np.cumsum(_BYTE_VALUES[self.data] * powers(_BASE, n), out=run[1:])
        return mix((run[ends] - run[starts]) * powers(_INVERSE, n + 1)[starts] + (ends - starts).astype(U64))


def texts(column: pa.Array, lower: bool = False) -> Texts:
    """A string column as Texts without copying it row by row; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if lower:
        column = pc.utf8_lower(column)
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(raw[at[0] : at[-1]], at - at[0])


def release() -> None:
    """Gives memory that Arrow and the C library keep for later back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries
        pass


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about limit bytes (one text of any length at least)."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def owner(first: np.ndarray) -> np.ndarray:
    """Index of the text of every run, from the first run of each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values by text."""
    run = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=run[1:])
    return run[first[1:]] - run[first[:-1]]


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal 64-bit keys together, and the start of each group in it.

    Sorting key and position packed in one word is several times faster than argsort; the few
    positions whose leading bits agree are told apart by their whole keys.
    """
    n = len(keys)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = U64(max(1, (n - 1).bit_length()))
    low = (U64(1) << bits) - U64(1)
    packed = np.sort((keys & ~low) | np.arange(n, dtype=U64))
    order = (packed & low).astype(np.int64)
    lead = packed >> bits
    new = np.ones(n, bool)
    new[1:] = lead[1:] != lead[:-1]
    whole = keys[order]
    if ((whole[1:] != whole[:-1]) & ~new[1:]).any():
        order = np.argsort(keys, kind="stable")
        whole = keys[order]
        new[1:] = whole[1:] != whole[:-1]
    return order, np.flatnonzero(new)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start .. start + size - 1 of all runs, one after the other."""
    to = np.cumsum(sizes)
    return np.repeat(starts - to + sizes, sizes) + np.arange(to[-1] if len(to) else 0)
