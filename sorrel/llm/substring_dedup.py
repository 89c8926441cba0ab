"""Substring dedup: intervals of at least min_words words that two documents have in common.

Candidates first: of every min_words words in a row, the k-gram of smallest hash is an anchor (winnowing), so two
documents that share so many words share an anchor. Around each anchor that occurs in several documents, the
words that an interval through it can touch form a segment. Equal segments of an anchor are one kind, whose words
leave a task once, so a passage that many documents copy is no heavier than one. Kinds of the same anchor meet in a
shard, where they are put into a compressed FM-index: a wavelet matrix over the Burrows-Wheeler transform of
their words, with sampled ranks, and bit vectors for the documents that hold them. Every kind is then streamed through
the index: windows of min_words words are searched backward, from left to right. Where the interval of suffixes stops
holding two documents, no window that covers the words read so far has matching statistics of min_words, so the search
goes on behind the word that failed. A window that holds is extended to the right by bisection. The intervals of a kind
go to its members by a join, and a document's intervals are united where they overlap or touch.

Shards hold whole anchors and about SHARD_WORDS words, and every repetition is looked for in one shard only. A shard is
larger where the kinds of one anchor are: these are as many as there are different surroundings of one k-gram.

Words are runs of letters, digits, underscores and non-ASCII characters of the lower-case text, compared by
their 32-bit hashes. Intervals are given in words (start inclusive, end exclusive, from 0).

Defined results: documents without words, null texts and null doc_ids have no intervals. A passage that repeats
inside one document only isn't reported. Rows of one doc_id count as one document: the union of their intervals
is reported. Ties don't matter, as every interval is reported for every document that holds it. Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.llm.storage import stored
from sorrel.llm.textkit import U64, chunks, mix, owner, release, spread, texts

ANCHOR_WORDS = 8
SHARD_WORDS = 1 << 18


def anchors(words: np.ndarray, first: np.ndarray, min_words: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of the winnowed k-grams of all texts; words has one hash each."""
    window, n = min_words - k + 1, len(words)
    doc = owner(first)
    if n < min_words:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    grams = words[: n - k + 1].copy()
    for i in range(1, k):
        grams = grams * U64(0xD6E8FEB86659FD93) + words[i : n - k + 1 + i]
    grams = mix(grams)
    # the smallest of each window by doubling; its position rides in the low bits, so the leftmost wins
    bits = U64(max(1, n.bit_length()))
    low = (U64(1) << bits) - U64(1)
    least, width = (grams & ~low) | np.arange(len(grams), dtype=U64), 1
    while width * 2 <= window:
        least, width = np.minimum(least[: len(least) - width], least[width:]), width * 2
    if width < window:
        rest = window - width
        least = np.minimum(least[: len(least) - rest], least[rest:])
    inside = doc[: len(least)] == doc[min_words - 1 : min_words - 1 + len(least)]
    place = np.unique((least[inside] & low).astype(np.int64))
    return grams[place], place


class Bits:
    """A packed bit vector with a rank directory."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.append(packed, np.zeros(8 + (-len(packed)) % 8, np.uint8)).view(U64)
        self.ranks = np.append(0, np.cumsum(np.bitwise_count(self.words).astype(np.int64)))[:-1].astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word = at >> 6
        return self.ranks[word] + np.bitwise_count(self.words[word] & ((U64(1) << (at & 63).astype(U64)) - U64(1)))


class WaveletMatrix:
    """Sequence of symbols below 2 ** bits as one packed bit vector per bit, with a rank directory each."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.length = len(symbols)
        self.levels, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(self.length - int(bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of the symbol before lo and before hi; begin is where its run starts in the last level."""
        at = np.concatenate([lo, hi])
        both = np.concatenate([symbol, symbol])
        for depth in range(self.bits):
            ones = self.levels[depth].rank(at)
            one = (both >> (self.bits - 1 - depth)) & 1 == 1
            at = np.where(one, self.zeros[depth] + ones, at - ones)
        half = len(lo)
        return at[:half] - begin, at[half:] - begin


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling on packed keys; the last symbol must be unique and least."""
    n = len(text)
    wide = max(1, n.bit_length())
    _, rank = np.unique(text, return_inverse=True)
    rank, step = rank.astype(np.int64), 1
    packs = 3 * wide <= 64
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        if packs:
            packed = np.sort((((rank << wide) | second) << wide | np.arange(n)).view(U64)).view(np.int64)
            order, key = packed & ((1 << wide) - 1), packed >> wide
        else:
            whole = rank * (n + 1) + second
            order = np.argsort(whole, kind="stable")
            key = whole[order]
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        rank[order] = np.cumsum(new) - 1
        step *= 2
        if new.all() or step >= n:
            return order


class FMIndex:
    """FM-index of segments of words, each with the document that holds it (-1: several do)."""

    def __init__(self, words: np.ndarray, first: np.ndarray, docs: np.ndarray):
        self.alphabet, codes = np.unique(words, return_inverse=True)
        count = len(first) - 1
        sizes = np.diff(first)
        # a separator (1) ends each segment, and 0 the text
        text = np.ones(len(words) + count + 1, np.int64)
        text[-1] = 0
        place = np.arange(len(words)) + np.repeat(np.arange(count), sizes)
        text[place] = codes + 2
        self.codes = codes + 2
        order = suffix_array(text)
        before = text[order - 1]
        top = len(self.alphabet) + 1
        self.matrix = WaveletMatrix(before, top)
        counts = np.bincount(text, minlength=top + 1)
        self.smaller = np.append(0, np.cumsum(counts))
        # where the occurrences of a symbol begin after the last level of the matrix: in order of reversed bits
        symbols = np.arange(top + 1)
        turned = np.zeros(top + 1, np.int64)
        for bit in range(self.matrix.bits):
            turned |= ((symbols >> bit) & 1) << (self.matrix.bits - 1 - bit)
        by = np.argsort(turned)
        self.begin = np.empty(top + 1, np.int64)
        self.begin[by] = np.cumsum(counts[by]) - counts[by]
        holder = np.full(len(text), -2, np.int64)
        holder[place] = np.repeat(docs, sizes)
        holder = holder[order]
        self.changes = Bits(np.append(False, holder[1:] != holder[:-1]))
        self.several = Bits(holder == -1)

    def shared(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether the suffixes lo .. hi - 1 belong to at least two documents."""
        some = hi > lo
        last = np.maximum(hi, lo + 1)
        return some & ((self.changes.rank(last) > self.changes.rank(lo + 1)) | (self.several.rank(last) > self.several.rank(lo)))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.matrix.rank(symbol, lo, hi, self.begin[symbol])
        return self.smaller[symbol] + a, self.smaller[symbol] + b

    def repeats(self, first: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment, start and end of the maximal shared intervals of at least min_words, all segments in step."""
        sizes, everything = np.diff(first), self.matrix.length
        seg = np.flatnonzero(sizes >= min_words)
        size = sizes[seg]
        base = first[:-1][seg]
        # the words at .. end - 1 are known to be shared; the aim is to get down to start
        start, end, at = np.zeros(len(seg), np.int64), size.copy(), size.copy()
        lo, hi = np.zeros(len(seg), np.int64), np.full(len(seg), everything, np.int64)
        # extending: start .. held - 1 is shared, start .. lost - 1 is not
        extending, held, lost = np.ones(len(seg), bool), np.full(len(seg), min_words - 1), size + 1
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(seg):
            new_lo, new_hi = self.extend(self.codes[base + at - 1], lo, hi)
            good = self.shared(new_lo, new_hi)
            at -= good
            lo, hi = new_lo, new_hi
            turn = np.flatnonzero(~good | (at == start))
            if not len(turn):
                continue
            won, ext = good[turn], extending[turn]
            s, e, z = start[turn], end[turn], size[turn]
            # a window that held starts an extension; one that failed moves behind the failed word
            a, b = held[turn], lost[turn]
            a = np.where(won, e, a)
            b = np.where(ext, np.where(won, b, e), np.where(won, z + 1, b))
            trying = (won | ext) & (a >= min_words) & (b - a > 1)
            done = (won | ext) & (a >= min_words) & (b - a <= 1)
            found.append((seg[turn[done]], s[done], a[done]))
            window = ~trying
            s = np.where(window, np.where(done, a - min_words + 1, np.where(ext, s, at[turn])), s)
            # the first attempt on a segment is the whole of it; if that fails, its first window
            e = np.where(window, s + min_words, np.where(ext, (a + b) // 2, z))
            start[turn], end[turn], at[turn], extending[turn], held[turn], lost[turn] = s, e, e, ~window, a, b
            lo[turn], hi[turn] = 0, everything
            over = end > size
            if over.any():
                keep = ~over
                seg, size, base, start, end, at, lo, hi, extending, held, lost = (x[keep] for x in (seg, size, base, start, end, at, lo, hi, extending, held, lost))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


def unite(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals that overlap or touch made one, by document."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if not len(doc):
        return doc, lo, hi
    new_doc = np.append(True, doc[1:] != doc[:-1])
    lift = (np.cumsum(new_doc) - 1) * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(hi + lift)
    new = np.append(True, (lo + lift)[1:] > reach[:-1])
    begin = np.flatnonzero(new)
    return doc[begin], lo[begin], (reach - lift)[np.append(begin[1:], len(doc)) - 1]


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    body = texts(part.column("text"), lower=True)
    starts, ends, first = body.words("alnum")
    return body.hashes(starts, ends), first


def _anchor_rows(min_words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            words, first = _words(part)
            hashes, place = anchors(words, first, min_words, k)
            doc = owner(first)[place]
            once = np.unique(np.stack([hashes.view(np.int64), doc]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(once[0]), part.column("doc_id").take(pa.array(once[1]))], ["anchor", "doc_id"])

    return run


MEMBERS = "anchor long, same long, doc_id long, start int"
KINDS = "anchor long, same long, doc_id long, again boolean, words binary"


def _segment_rows(min_words: int, k: int, kinds: bool):
    """The segments of documents (MEMBERS), or what an index needs of them (KINDS): for each kind, the equal segments of
    an anchor, its words once by task, with a document that has it, and once again if another document has it, too."""
    # the kinds that this task has met, sorted, with the document each was sent with, and whether another was sent, too
    met = [np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, bool)]

    def of_kinds(anchor: np.ndarray, same: np.ndarray, doc: np.ndarray, words: np.ndarray, to: np.ndarray) -> pa.RecordBatch:
        kind, lead, back = np.unique(mix(anchor.view(U64) ^ mix(same.view(U64))), return_index=True, return_inverse=True)
        least, most = np.full(len(kind), 2**63 - 1), np.full(len(kind), -(2**63))
        np.minimum.at(least, back, doc)
        np.maximum.at(most, back, doc)
        at = np.minimum(np.searchsorted(met[0], kind), max(len(met[0]) - 1, 0))
        old = met[0][at] == kind if len(met[0]) else np.zeros(len(kind), bool)
        new = ~old
        other = most.copy()
        other[old] = np.where(least[old] != met[1][at[old]], least[old], most[old])
        again = other != least
        again[old] = (other[old] != met[1][at[old]]) & ~met[2][at[old]]
        met[2][at[old & again]] = True
        fresh = lead[new]
        sizes = np.diff(to)[fresh]
        offsets = np.append(0, np.cumsum(np.append(sizes, np.zeros(int(again.sum()), np.int64)) * 4)).astype(np.int32)
        rows = np.append(fresh, lead[again])
        flags = np.arange(len(rows)) >= len(fresh)
        blobs = pa.Array.from_buffers(pa.binary(), len(rows), [pa.py_buffer(np.packbits(~flags, bitorder="little").tobytes()), pa.py_buffer(offsets.tobytes()), pa.py_buffer(words[spread(to[:-1][fresh], sizes)].tobytes())])
        out = pa.RecordBatch.from_arrays([pa.array(anchor[rows]), pa.array(same[rows]), pa.array(np.append(least[new], other[again])), pa.array(flags), blobs], ["anchor", "same", "doc_id", "again", "words"])
        merged = np.concatenate([met[0], kind[new]]), np.concatenate([met[1], least[new]]), np.concatenate([met[2], again[new]])
        order = np.argsort(merged[0])
        met[:] = [x[order] for x in merged] if len(order) <= 500_000 else [x[:0] for x in merged]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            words, first = _words(part)
            hashes, place = anchors(words, first, min_words, k)
            doc = owner(first)[place]
            lists = part.column("anchors")
            wanted = lists.flatten().to_numpy(zero_copy_only=False).view(U64)
            of = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            salt = mix(np.arange(1, part.num_rows + 1, dtype=U64))
            use = np.isin(mix(hashes ^ salt[doc]), mix(wanted ^ salt[of]))
            hashes, place, doc = hashes[use], place[use], doc[use]
            lo = np.maximum(first[doc], place - (min_words - k))
            hi = np.minimum(first[doc + 1], place + min_words)
            symbols = (words >> U64(32)).astype(np.uint32)
            for i in range(0, len(lo), 4000):
                a, b = lo[i : i + 4000], hi[i : i + 4000]
                sizes = b - a
                where = spread(a, sizes)
                to = np.append(0, np.cumsum(sizes))
                run_ = np.append(U64(0), np.cumsum(mix(symbols[where].astype(U64) + mix((np.arange(len(where)) - np.repeat(to[:-1], sizes)).astype(U64)))))
                same = mix((run_[to[1:]] - run_[to[:-1]]) ^ sizes.astype(U64)).view(np.int64)
                at = doc[i : i + 4000]
                anchor = hashes[i : i + 4000].view(np.int64)
                if kinds:
                    yield of_kinds(anchor, same, part.column("doc_id").to_numpy()[at], symbols[where], to)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(same), part.column("doc_id").take(pa.array(at)), pa.array((a - first[at]).astype(np.int32))], ["anchor", "same", "doc_id", "start"])

    return run


FOUND = "doc_id long, start_word int, end_word int"


INTERVALS = "anchor long, same long, lo int, hi int"


def _shard_rows(min_words: int):
    """Cuts the sorted kinds into shards, indexes each and streams its kinds through the index."""

    def search(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, same, doc = (np.concatenate([p[i] for p in parts]) for i in range(3))
        blobs = [b for p in parts for b in p[3]]
        heads = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (same[1:] != same[:-1])))
        least, most = np.minimum.reduceat(doc, heads), np.maximum.reduceat(doc, heads)
        blobs = [blobs[i] for i in heads.tolist()]
        first = np.append(0, np.cumsum([len(b) // 4 for b in blobs]))
        index = FMIndex(np.frombuffer(b"".join(blobs), np.uint32), first, np.where(least == most, doc[heads], -1))
        seg, lo, hi = index.repeats(first, min_words)
        seg, lo, hi = unite(seg, lo, hi)
        if len(seg):
            yield pa.RecordBatch.from_arrays([pa.array(anchor[heads[seg]]), pa.array(same[heads[seg]]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["anchor", "same", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        volume = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, same, doc = (batch.column(c).to_numpy() for c in ("anchor", "same", "doc_id"))
            blobs = batch.column("words").to_pylist()
            new = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])).tolist()
            for lo, hi in zip(new, [*new[1:], len(anchor)]):
                # before an anchor that goes on from the rows held nothing is cut
                if volume >= SHARD_WORDS and held and held[-1][0][-1] != anchor[lo]:
                    yield from search(held)
                    held, volume = [], 0
                held.append((anchor[lo:hi], same[lo:hi], doc[lo:hi], blobs[lo:hi]))
                volume += sum(len(b) // 4 for b in blobs[lo:hi] if b)
        if held:
            yield from search(held)
        release()

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unites the intervals of each document, from rows sorted by document."""
    held = None
    for batch in batches:
        rows = pa.table([batch.column(c) for c in range(3)], ["doc_id", "start_word", "end_word"])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        doc, lo, hi = (rows.column(c).to_numpy().astype(np.int64) for c in range(3))
        cut = int(np.searchsorted(doc, doc[-1])) if len(doc) else 0
        yield from _as_batch(*unite(doc[:cut], lo[:cut], hi[:cut]))
        d, a, b = unite(doc[cut:], lo[cut:], hi[cut:])
        held = pa.table([pa.array(d), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["doc_id", "start_word", "end_word"])
    if held is not None:
        yield from held.to_batches()


def _as_batch(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(doc):
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["doc_id", "start_word", "end_word"])


def repeated(docs: DataFrame, min_words: int = 50, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """doc_id, start_word and end_word of every maximal run of intervals that other documents have too."""
    k = min(anchor_words, min_words)
    rows = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    met = stored(rows.mapInArrow(_anchor_rows(min_words, k), "anchor long, doc_id long"), "anchors")
    shared = met.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    hits = met.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    wanted = rows.join(hits, "doc_id").select("doc_id", "text", "anchors")
    kinds = wanted.mapInArrow(_segment_rows(min_words, k, True), KINDS)
    repeats = kinds.repartition("anchor").sortWithinPartitions("anchor", "same", "again").mapInArrow(_shard_rows(min_words), INTERVALS)
    members = wanted.mapInArrow(_segment_rows(min_words, k, False), MEMBERS)
    found = members.join(repeats, ["anchor", "same"]).select("doc_id", (F.col("start") + F.col("lo")).alias("start_word"), (F.col("start") + F.col("hi")).alias("end_word"))
    return found.repartition("doc_id").sortWithinPartitions("doc_id", "start_word").mapInArrow(_united, FOUND)
