"""Heads of sets of 32-bit features in one order, rare features first, and what meets by them; numpy only.

Of the features that two sets share, the first in that order lies, in each of them, before all others that they share.
So two sets that share o features have one in common that is among the first x - o + 1 of the one, of x features, and
among the first y - o + 1 of the other, of y: no pair is lost, whatever the order. How many they must share to reach
the threshold follows from their sizes, so a set sends its first features with their places, and those of a feature
meet if sizes and places allow it and their parity bitmaps (sorrel.llm.partenum) differ in few enough bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from sorrel.llm import partenum
from sorrel.llm.textkit import U64, spread

#: Pairs of rows that are looked at together, and words of their bitmaps. They decide memory only: all pairs are looked at.
AT_ONCE = 100_000
#: Lists of more rows are first tied to some of their rows, of which at most so many are tried.
LONG, CENTRES = 1_000, 16


def ranks(counts: np.ndarray) -> np.ndarray:
    """The order's first key by cell, ten times the binary logarithm of the cell's count."""
    return (np.log2(np.maximum(counts, 1)) * 10).clip(0, 255).astype(np.uint8)


def shared(threshold: float, sizes: np.ndarray) -> np.ndarray:
    """Features that two sets of so many features together share at least if they reach the threshold."""
    return np.ceil(threshold / (1 + threshold) * sizes - 1e-9).astype(np.int64)


def smallest(threshold: float, sizes: np.ndarray) -> np.ndarray:
    """Features of the smallest set that can reach the threshold with one of so many."""
    return np.ceil(threshold * sizes - 1e-9).astype(np.int64)


def heads(features: np.ndarray, first: np.ndarray, order: np.ndarray, threshold: float, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, index of its set and place in it of the first features of the sets to use."""
    sizes = np.where(use, np.diff(first), 0)
    own = np.repeat(use, np.diff(first))
    features = features[own]
    key = (order[partenum.cells(features)].astype(U64) << U64(32)) | features.astype(U64)
    of = np.repeat(np.arange(len(sizes), dtype=U64), sizes)
    key = np.sort((of << U64(40)) | key)
    begin = np.append(0, np.cumsum(sizes))
    many = np.where(sizes > 0, sizes - smallest(threshold, sizes) + 1, 0)
    which = np.repeat(np.arange(len(sizes)), many)
    at = spread(begin[:-1], many)
    return (key[at] & U64(0xFFFFFFFF)).astype(np.uint32), which, at - begin[which]


def counts(order: np.ndarray, features: np.ndarray) -> np.ndarray:
    """About how many sets have each feature."""
    return np.exp2(order[partenum.cells(features)] / 10)


def pack(value: np.ndarray, which: np.ndarray, place: np.ndarray, numbers: np.ndarray, maps: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> bytes:
    """Rows sorted by value as bytes, by planes, then number (below 2 ** BLOCK), size and bitmap of each set in them.

    which is a set's index in numbers and sizes. A place over 65,535 is sent as that, with which a pair is kept the more.
    """
    present, local = np.unique(which, return_inverse=True)
    step = np.diff(value, prepend=value[:1]).astype(np.uint32)
    step[:1] = value[:1]
    planes = [x.view(np.uint8).reshape(len(x), -1).T.ravel() for x in (step, local.astype(np.uint16), np.minimum(place, 65_535).astype(np.uint16))]
    bits = maps[spread(at[present], at[present + 1] - at[present])]
    parts = [*planes, numbers[present].astype(np.uint16).view(np.uint8), sizes[present].astype(np.uint32).view(np.uint8), bits.view(np.uint8)]
    return np.array([len(value), len(present)], np.int64).tobytes() + b"".join(p.tobytes() for p in parts)


def unpack(data: bytes) -> tuple[np.ndarray, ...]:
    """value, local number of the set and place of each row; number, size and bitmap (all in one array) of each set."""
    n, m = np.frombuffer(data, np.int64, 2).tolist()
    raw, at, out = np.frombuffer(data, np.uint8, offset=16), 0, []
    for kind in (np.uint32, np.uint16, np.uint16):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + width * n].reshape(width, n).T).view(kind).ravel())
        at += width * n
    present, sizes, maps = raw[at : at + 2 * m].copy().view(np.uint16), raw[at + 2 * m : at + 6 * m].copy().view(np.uint32), raw[at + 6 * m :].copy().view(U64)
    return np.cumsum(out[0], dtype=np.uint32), out[1].astype(np.int64), out[2].astype(np.int64), present.astype(np.int64), sizes.astype(np.int64), maps


class Lists:
    """The rows of some features: of each the value, the set, and the place there; of each set size, bitmap and whether it is wanted.

    Pairs are given if their larger set is wanted.
    """

    def __init__(self, value: np.ndarray, of: np.ndarray, place: np.ndarray, sizes: np.ndarray, maps: np.ndarray, wanted: np.ndarray, threshold: float):
        key = (value.astype(U64) << U64(32)) | sizes[of].astype(U64)
        order = np.argsort(key)
        value = value[order]
        same = np.append(False, value[1:] == value[:-1])
        order = order[same | np.append(same[1:], False)]  # many features have one row
        self.key, self.of, self.place = key[order], of[order], place[order]
        self.size, self.wanted = sizes[self.of], wanted[self.of]
        self.words = partenum.bitmap_words(sizes)
        self.maps, self.at, self.threshold = maps, np.append(0, np.cumsum(self.words)), threshold

    def possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether rows i and j, of one feature, may be of similar sets that meet there."""
        parts = [self._possible(i[at : at + AT_ONCE], j[at : at + AT_ONCE]) for at in range(0, len(i), AT_ONCE)]
        return np.concatenate([np.zeros(0, bool), *parts])

    def _possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        both = self.size[i] + self.size[j]
        least = shared(self.threshold, both)
        good = (self.place[i] <= self.size[i] - least) & (self.place[j] <= self.size[j] - least)
        good &= np.minimum(self.size[i], self.size[j]) >= smallest(self.threshold, np.maximum(self.size[i], self.size[j]))
        good &= np.where(self.size[i] > self.size[j], self.wanted[i], self.wanted[j])
        at = np.flatnonzero(good)
        good[at] = self._apart(self.of[i[at]], self.of[j[at]]) <= partenum.differences(self.threshold, both[at])
        return good

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        kind, which = np.unique(self.words[a] * (1 << 32) + self.words[b], return_inverse=True)
        for k in range(len(kind)):
            rows, wa, wb = np.flatnonzero(which == k), int(kind[k]) >> 32, int(kind[k]) & 0xFFFFFFFF
            step = max(1, AT_ONCE // (wa + wb))  # bitmaps of long texts are long
            for some in (rows[at : at + step] for at in range(0, len(rows), step)):
                x, y = (self.maps[self.at[s[some], None] + np.arange(w)] for s, w in ((a, wa), (b, wb)))
                out[some] = partenum.differ(x, y)
        return out

    def joined(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets by which all sets hang together that possible pairs connect.

        In a long list, rows that one of CENTRES of its rows is possible with hang together by that; where these are
        most of it, only the others are compared with all.
        """
        value, rows = self.key & ~U64(0xFFFFFFFF), np.arange(len(self.key))
        low, early, begin, many = self._windows(value)
        begins = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else rows
        lengths = np.diff(np.append(begins, len(value)))
        for start, length in zip(begins[lengths > LONG].tolist(), lengths[lengths > LONG].tolist()):
            i, j, rest = self._tied(start, length)
            yield self.of[i], self.of[j]
            if 2 * len(rest) < length:
                many[start : start + length] = 0
                high = np.searchsorted(self.key, value[rest] | np.floor(self.size[rest] / self.threshold + 1e-9).astype(U64), "right")
                yield from self._compared(rest, rows, low[rest], high - low[rest])
        yield from self._compared(rows, early, begin, many)

    def _windows(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The first row that sizes allow each to meet; rows that can be of a smaller set; of these, the first and number for each.

        A smaller set shares its feature the earlier, as it shares more of its features, and how much smaller it is
        bounds how late the larger set may have the feature.
        """
        least = smallest(self.threshold, self.size).astype(U64)
        most = np.floor((self.size - self.place) * (1 + self.threshold) / self.threshold + 1e-9).astype(np.int64) - self.size
        soon = self.place <= self.size - shared(self.threshold, 2 * self.size)
        early = np.flatnonzero(soon)
        begin = np.searchsorted(self.key[early], value | least)
        end = np.searchsorted(self.key[early], value | np.clip(most, 0, self.size).astype(U64), "right")
        many = np.minimum(end, np.cumsum(soon) - soon) - begin
        return np.searchsorted(self.key, value | least), early, begin, np.where(self.wanted, np.maximum(many, 0), 0)

    def _compared(self, rows: np.ndarray, others: np.ndarray, low: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The possible pairs of sets of each row and so many others, from low on."""
        run = np.append(0, np.cumsum(many))
        lo = 0
        while lo < len(many):
            hi = max(lo + 1, int(np.searchsorted(run, run[lo] + AT_ONCE, "right")) - 1)
            if run[hi] > run[lo]:
                i, j = others[spread(low[lo:hi], many[lo:hi])], np.repeat(rows[lo:hi], many[lo:hi])
                good = np.flatnonzero(self.possible(i, j))
                yield self.of[i[good]], self.of[j[good]]
            lo = hi

    def _tied(self, begin: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and their centres, and the rows that don't hang together with the most."""
        label, tried, hits, centres = np.arange(length), np.zeros(length, bool), [], []
        for _ in range(CENTRES):
            alone = np.flatnonzero((np.bincount(label, minlength=length)[label] == 1) & ~tried)
            if not len(alone):
                break
            centre = alone[len(alone) // 2]
            tried[centre] = True
            near = np.flatnonzero(self.possible(begin + np.arange(length), np.full(length, begin + centre)))
            hits.append(begin + near)
            centres.append(np.full(len(near), begin + centre))
            together = np.zeros(length, bool)
            together[label[np.append(near, centre)]] = True
            label[together[label]] = centre
        return np.concatenate(hits), np.concatenate(centres), begin + np.flatnonzero(label != np.bincount(label).argmax())
