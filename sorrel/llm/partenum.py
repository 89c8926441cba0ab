"""PartEnum signatures of sets of 32-bit features, and what meets by them; numpy only.

Two sets of Jaccard index t or more differ in at most k = 2 (1 - t) / (1 + t) top features, top being the larger
set's largest possible size. The feature domain is cut into n1 partitions, so that one of them holds at most k2
differences, and each partition into k2 + DEPTH parts, of which at least DEPTH are then alike in both sets. A set
enumerates subsets of the parts of each partition: a part that tells enough by itself is a subset of its own; of the
others, subsets in order of position, each grown until it tells enough or has DEPTH parts. Two similar sets have DEPTH
like parts in some partition: if one of them tells enough both sign for it, and else both sign for the same beginning
of them, as both grow it by the same rule. So they share a signature, whatever "enough" means: what a part tells is
the sum of its features' weights (rarer ones weigh more), which decides how often sets meet by chance, not which meet.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import ceil, floor, log

import numpy as np

from sorrel.llm.textkit import U64, grouped, mix, owner, spread

#: Differences that the fullest partition may hold, and parts alike in it at least. They decide cost only.
K2, DEPTH = 4, 4
#: Bits of a feature's cell in the table of weights, of one byte each; the largest weight.
CELLS = 22
HEAVIEST = 10.0
#: Sets of a block, which has 2 ** BLOCK numbers.
BLOCK = 11
#: Bits by which signatures of one bucket are told apart; chance agreements of them are pairs that bitmaps turn away.
VALUE = 34
#: Of that many sets of one signature or less, all pairs are given; larger groups meet by centres.
FEW = 8
#: Groups beyond this are reduced to their centres before they are sent.
HOT = 64
NEAR = 3


@lru_cache(64)
def bands(threshold: float, largest: int) -> np.ndarray:
    """Smallest size of each band, up to two beyond the last that holds largest."""
    lows = [1]
    while lows[-1] <= largest:
        lows.append(floor(lows[-1] / threshold + 1e-9) + 1)
    return np.array([*lows, floor(lows[-1] / threshold + 1e-9) + 1], np.int64)


def differences(threshold: float, sizes: np.ndarray | int) -> np.ndarray:
    """Features in which two sets of so many features together can differ and still reach the threshold."""
    return np.floor((1 - threshold) / (1 + threshold) * sizes + 1e-9).astype(np.int64)


def shape(top: int, threshold: float) -> tuple[int, int]:
    """Partitions, and parts of each, for a band of sets of at most top features."""
    k = int(differences(threshold, 2 * top))
    k2 = min(K2, k)
    return ceil((k + 1) / (k2 + 1)), k2 + DEPTH


def cells(features: np.ndarray) -> np.ndarray:
    return (mix(features.astype(U64) + U64(0x632BE59BD9B4E019)) >> U64(64 - CELLS)).astype(np.int64)


@dataclass
class Weights:
    """What a feature tells, in steps of a twentieth, by its cell; what a signature must tell."""

    steps: np.ndarray
    enough: float

    @classmethod
    def of(cls, counts: np.ndarray, sets: int) -> Weights:
        told = np.log(max(sets, 1) / np.maximum(counts, 1)).clip(0, HEAVIEST)
        return cls((told * 20).astype(np.uint8), log(max(sets, 1)) + 4)

    def told(self, features: np.ndarray) -> np.ndarray:
        return self.steps[cells(features)].astype(np.float64)


def _salted(cells: np.ndarray, salt: np.uint64, parts: int) -> np.ndarray:
    """The parts' contents with their places in the domain."""
    at = np.arange(parts, dtype=U64) * U64(0x9E3779B97F4A7C15) + salt
    return mix(cells.reshape(-1, parts) ^ mix(at)).ravel()


def band_of(sizes: np.ndarray, lows: np.ndarray) -> np.ndarray:
    return np.searchsorted(lows, sizes, "right") - 1


def signatures(features: np.ndarray, first: np.ndarray, threshold: float, weights: Weights, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature, index of its set, and whether it is of the set's own band (else of the next); of the wanted bands only."""
    sizes = np.diff(first)
    lows = bands(threshold, int(sizes.max(initial=1)))
    bands_ = band_of(sizes, lows)
    enough, out = weights.enough * 20, []

    def emit(signs: np.ndarray, sets: np.ndarray, own: bool) -> None:
        out.append((signs, sets, np.full(len(signs), own)))

    for band in np.unique(bands_[sizes > 0]):
        members = np.flatnonzero((bands_ == band) & (sizes > 0))
        where = spread(first[:-1][members], sizes[members])
        local = np.repeat(np.arange(len(members)), sizes[members])
        value = features[where].astype(U64)
        content, place, told = mix(value + U64(0x27D4EB2F165667C5)), mix(value + U64(0x165667B19E3779F9)), weights.told(features[where])
        for instance in (band, band + 1):
            if wanted is not None and not wanted[instance]:
                continue
            own = instance == band
            n1, n2 = shape(int(lows[instance + 1] - 1), threshold)
            salt = mix(np.array([instance * 1_000_003 + 17], U64))[0]
            part = (mix(place ^ salt) % U64(n1 * n2)).astype(np.int64) + local * (n1 * n2)
            cells = np.zeros(len(members) * n1 * n2, U64)
            np.add.at(cells, part, content)
            tells = np.bincount(part, weights=told, minlength=len(cells))
            cells = _salted(cells, salt, n1 * n2)
            strong = tells >= enough
            at = np.flatnonzero(strong)
            emit(cells[at], members[at // (n1 * n2)], own)
            cells, tells, weak = cells.reshape(-1, n2), tells.reshape(-1, n2), ~strong.reshape(-1, n2)
            row, last = np.nonzero(weak)
            sign, sum_ = cells[row, last], tells[row, last]
            for _ in range(1, DEPTH):
                count = n2 - 1 - last
                of, then = np.repeat(np.arange(len(row)), count), spread(last + 1, count)
                use = weak[row[of], then]
                of, then = of[use], then[use]
                row, last = row[of], then
                sign, sum_ = mix(sign[of] + cells[row, last] * U64(3)), sum_[of] + tells[row, last]
                done = sum_ >= enough
                emit(sign[done], members[row[done] // n1], own)
                row, last, sign, sum_ = (x[~done] for x in (row, last, sign, sum_))
            emit(sign, members[row // n1], own)
    if not out:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def sketches(features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bits of each set: one of the smallest hash of each of 16 bins; 0 of empty bins."""
    value = mix(features.astype(U64) + U64(0x2545F4914F6CDD1D))
    least = np.full((len(first) - 1) * 16, 2**64 - 1, U64)
    np.minimum.at(least, owner(first) * 16 + (value >> U64(60)).astype(np.int64), value << U64(4))
    bits = ((least >> U64(4)) & U64(1)).astype(bool) & (least != U64(2**64 - 1))
    return np.packbits(bits.reshape(-1, 16), axis=1).view(np.uint16).ravel()


def bitmap_words(sizes: np.ndarray) -> np.ndarray:
    """64-bit words of a set's parity bitmap: a power of two, more than half a bit for each feature.

    Bitmaps of unlike sets differ in about half of their bits, by four standard deviations and more above what similar
    sets may, also for small sets.
    """
    return 1 << np.ceil(np.log2(np.maximum((sizes * 0.6 + 24) / 64, 1))).astype(np.int64)


def bitmaps(features: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmaps of all sets, one after the other, and the first word of each.

    A bit is the parity of the set's features that fall on it, so two bitmaps differ in no more bits than the
    sets do in features; a half of a bitmap xor the other half is the bitmap of half the length.
    """
    words = bitmap_words(np.diff(first))
    at = np.append(0, np.cumsum(words))
    bit = mix(features.astype(U64) + U64(0x94D049BB133111EB)) & (np.repeat(words, np.diff(first)).astype(U64) * U64(64) - U64(1))
    out = np.zeros(at[-1], U64)
    np.bitwise_xor.at(out, np.repeat(at[:-1], np.diff(first)) + (bit >> U64(6)).astype(np.int64), U64(1) << (bit & U64(63)))
    return out, at


def apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Bits in which the bitmaps of each pair differ, the longer one folded."""
    out = np.zeros(len(a), np.int64)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    kind, which = np.unique(la * (1 << 32) + lb, return_inverse=True)
    for i in range(len(kind)):
        rows = np.flatnonzero(which == i)
        x, y = (np.frombuffer(b"".join(s[r] for r in rows), U64).reshape(len(rows), -1) for s in (a, b))
        out[rows] = differ(x, y)
    return out


def differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which the rows of x and y differ, the longer ones folded."""
    while x.shape[1] > y.shape[1]:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    while y.shape[1] > x.shape[1]:
        y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def _combine(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within each run."""
    at = spread(starts, sizes)
    later = np.repeat(starts + sizes, sizes) - at - 1
    return np.repeat(at, later), spread(at + 1, later)


def centres(run: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The position that each row is tied to: its own (a centre), or that of a centre of its run with a near sketch.

    In each run the first row is a centre, to which all rows with a near sketch are tied; of the rest, the first is
    the next centre, until none is left.
    """
    out, rows = np.arange(len(run)), np.arange(len(run))
    while len(rows):
        lead = np.append(True, run[rows][1:] != run[rows][:-1])
        centre = rows[np.maximum.accumulate(np.where(lead, np.arange(len(rows)), 0))]
        near = np.bitwise_count(sketch[rows] ^ sketch[centre]) <= NEAR
        out[rows[near]] = centre[near]
        rows = rows[~near]
    return out


def meet(sign: np.ndarray, ids: np.ndarray, own: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (n, 2) and ties (n, 2) of the sets of equal signatures; rows must be sorted by signature.

    A pair may be similar. A tie joins a centre to a set that stands behind it, and a pair of centres stands for the
    pairs of those behind them, too. Sets that both sign for the next band meet in their own.
    """
    new = np.append(True, sign[1:] != sign[:-1]) if len(sign) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(sign)))
    use = (sizes > 1) & np.logical_or.reduceat(own, starts) if len(starts) else np.zeros(0, bool)
    small = use & (sizes <= FEW)
    i, j = _combine(starts[small], sizes[small])
    good = own[i] | own[j]
    pairs = [np.stack([ids[i[good]], ids[j[good]]], axis=1)]
    large = use & (sizes > FEW)
    where = spread(starts[large], sizes[large])
    run = np.repeat(np.arange(int(large.sum())), sizes[large])
    to = centres(run, sketch[where])
    tied = to != np.arange(len(to))
    ties = np.stack([ids[where[to[tied]]], ids[where[tied]]], axis=1)
    if len(where):
        heads, of = where[~tied], run[~tied]
        begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        i, j = _combine(begin, np.diff(np.append(begin, len(of))))
        pairs.append(np.stack([ids[heads[i]], ids[heads[j]]], axis=1))
    pairs = np.concatenate(pairs)
    return distinct(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1)), distinct(ties[ties[:, 0] != ties[:, 1]])


def distinct(rows: np.ndarray) -> np.ndarray:
    """The rows (n, 2), each once."""
    if not len(rows):
        return rows
    keys = mix(rows[:, 0].astype(U64)) * U64(0x9E3779B97F4A7C15) ^ mix(rows[:, 1].astype(U64) + U64(0x2545F491))
    order, groups = grouped(keys)
    return rows[order[groups]]


def cool(sign: np.ndarray, where: np.ndarray, own: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows to send, and ties (n, 2) of positions, where groups of more than HOT rows keep their centres only.

    These then count as of their own band, as one of those behind them may be.
    """
    new = np.append(True, sign[1:] != sign[:-1]) if len(sign) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(sign)))
    hot = sizes > HOT
    send = np.ones(len(sign), bool)
    if not hot.any():
        return send, np.zeros((0, 2), np.int64)
    at = spread(starts[hot], sizes[hot])
    to = centres(np.repeat(np.arange(int(hot.sum())), sizes[hot]), sketch[where[at]])
    tied = to != np.arange(len(to))
    send[at[tied]] = False
    own[at] = True
    return send, distinct(np.stack([where[at[to[tied]]], where[at[tied]]], axis=1))


def pack(value: np.ndarray, where: np.ndarray, own: np.ndarray, sketch: np.ndarray) -> bytes:
    """Rows sorted by value as bytes: differences of values and places by planes, and the sketches of the sets there."""
    present, local = np.unique(where, return_inverse=True)
    step = np.diff(value, prepend=U64(0)).astype(U64)
    entry = (local.astype(np.uint16) << np.uint16(1)) | own
    parts = [step.view(np.uint8).reshape(-1, 8)[:, :5].T.ravel(), entry.view(np.uint8).reshape(-1, 2).T.ravel(), present.astype(np.uint16).view(np.uint8), sketch[present].view(np.uint8)]
    return np.array([len(value), len(present)], np.int64).tobytes() + b"".join(p.tobytes() for p in parts)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """value, where, own and sketch of each row."""
    n, m = np.frombuffer(data, np.int64, 2)
    raw = np.frombuffer(data, np.uint8, offset=16)
    step = np.zeros((n, 8), np.uint8)
    step[:, :5] = raw[: 5 * n].reshape(5, n).T
    entry = np.ascontiguousarray(raw[5 * n : 7 * n].reshape(2, n).T).view(np.uint16).ravel()
    present, sketch = raw[7 * n : 7 * n + 2 * m].copy().view(np.uint16), raw[7 * n + 2 * m :].copy().view(np.uint16)
    local = entry >> 1
    return np.cumsum(step.view(U64).ravel()), present[local].astype(np.int64), (entry & 1).astype(bool), sketch[local]
