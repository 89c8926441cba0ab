"""Similarity join of documents by the Jaccard index of their word n-gram sets: first features in order of rarity, or PartEnum.

Similar sets share one of their rarest features (sorrel.llm.prefix), so a set sends these, with their places in it, its
size and its parity bitmap, by blocks of sets and buckets of features. Pairs that sizes, places or bitmaps rule out go
where they meet; of the others only a forest of the sets that they connect leaves a bucket.

Sets are put into bands of about equal size: the largest of a band is 1 / threshold times the smallest, so two similar
sets lie in one band or in neighbouring ones. Where the rarest features of a band's sets are common (DENSE), pairs whose
larger set lies in it meet by signatures instead (sorrel.llm.partenum), which enumerate subsets of partitions of the
feature domain so that any two similar sets share one; each set signs for its own band and the next, if these are dense.
Signatures travel packed, some four bytes each. Sets that share one are pairs to look at or, in groups of many, are tied
to centres with a near sketch; a pair of centres stands for the pairs of those behind them. Of these pairs, too, only
those go that can't be similar: parity bitmaps differ in no more bits than the sets in features, and by the triangle
inequality those behind two centres are no nearer than the centres less the two radii.

What is left connects sets into groups; in these, all pairs are verified on the whole sets, in blocks of BLOCK_SETS,
each pair of blocks by a task of its own. So no link is lost, and how sets met decides cost only.

Where only classes are wanted, not links, the sets of a group of several blocks are first compared with CENTRES of them.
Most of a group of near copies hangs together by that, and pairs within it are left out: they can't change the classes.

classes() gives a row for each document: its class (documents connected by links, named by the smallest doc_id) and
its number of links, that is of other documents whose index with it is threshold or more. Copies (documents of equal
sets) are verified once and counted as often as they occur. keep_one() keeps one document of each class.

Words are runs of letters, digits, underscores and non-ASCII characters of the lower-case text; a text of fewer
than n words has the one n-gram of all its words. Features are 32-bit hashes of n-grams.

Defined results: rows with a null doc_id have no row in classes() and are kept by keep_one(). A document without
words (null and empty texts too) is a class of its own without links. A document is a doc_id with a set: rows that agree in
both count once, a doc_id with texts of several sets has a row for each, and of these keep_one() removes those that
are in another document's class, by their text. Of several rows of the document that stays, those with the
smallest text hash stay if their texts differ, and all of them if the texts are equal. Columns other than doc_id and
text are ignored, or passed through by keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.llm import partenum, prefix
from sorrel.llm.partenum import BLOCK, VALUE, Weights
from sorrel.llm.storage import discard, fresh, limited_broadcast, settle, size_in_bytes, stored
from sorrel.llm.textkit import U64, chunks, mix, owner, release, texts

#: Signatures or first features that one task sorts; buckets of first features at least, for tables that aren't small.
BUCKET = 1_500_000
LEAST_BUCKETS = 32
#: Occurrences of a set's first features from which a band of sets meets by PartEnum, and the share of sets measured.
DENSE, SAMPLE = 4_000_000, 16
#: Bytes of edges that one task connects.
ONE_TASK = 32 << 20
#: Sets of a group that one task compares with so many others.
BLOCK_SETS = 1_500
#: Sets of a larger group with which all its sets are compared first if only classes are wanted.
CENTRES = 16


@dataclass(frozen=True)
class Join:
    n: int = 1
    threshold: float = 0.8


def feature_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 32-bit features of all texts, and the first of each text."""
    body = texts(column, lower=True)
    starts, ends, first = body.words("alnum")
    doc, word = owner(first), body.hashes(starts, ends)
    left = first[1:][doc] - np.arange(len(word))
    size = np.minimum(n, np.diff(first)[doc])
    grams, keep = word.copy(), left >= size
    for i in range(1, n):
        more = np.flatnonzero((left > i) & keep)
        grams[more] = grams[more] * U64(0xD6E8FEB86659FD93) + word[more + i]
    keys = np.sort((doc[keep].astype(U64) << U64(32)) | (mix(grams[keep]) >> U64(32)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    keys = keys[new]
    return (keys & U64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(keys, np.arange(len(body) + 1, dtype=U64) << U64(32))


def set_hashes(features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set, of 62 bits."""
    run = np.append(U64(0), np.cumsum(mix(features.astype(U64) + U64(0x5851F42D4C957F2D))))
    return (mix((run[first[1:]] - run[first[:-1]]) ^ np.diff(first).astype(U64)) >> U64(2)).astype(np.int64)


def _blobs(data: np.ndarray, at: np.ndarray, width: int, keep: np.ndarray) -> pa.Array:
    """data[at[i]:at[i + 1]] as binary for the rows to keep, null for the others."""
    sizes = np.where(keep, np.diff(at), 0)
    used = data[np.repeat(keep, np.diff(at))]
    offsets = np.append(0, np.cumsum(sizes * width)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(keep), [pa.py_buffer(np.packbits(keep, bitorder="little").tobytes()), pa.py_buffer(offsets.tobytes()), pa.py_buffer(used.tobytes())])


def _from_blobs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), np.uint32), np.append(0, np.cumsum([len(b) // 4 for b in blobs], dtype=np.int64))


SETS = "id long, rep long, doc_id long, digest long, node long, size int, features binary, bitmap binary"


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """The documents that have a doc_id, numbered in blocks; node is the set's hash (of size 0: 0).

    rep is the first row of the same set in the block; only it has features and bitmap.
    """

    def block(start: int, parts: list[tuple]) -> pa.RecordBatch:
        features = np.concatenate([p[0] for p in parts])
        sizes = np.concatenate([np.diff(p[1]) for p in parts])
        first = np.append(0, np.cumsum(sizes))
        node = np.where(sizes > 0, set_hashes(features, first), 0)
        _, lead, back = np.unique(node, return_index=True, return_inverse=True)
        ids = start + np.arange(len(node))
        keep = (lead[back] == np.arange(len(node))) & (sizes > 0)
        maps, at = partenum.bitmaps(features, first)
        rows = [pa.array(ids), pa.array(ids[lead[back]]), *(pa.concat_arrays([p[i] for p in parts]) for i in (2, 3)), pa.array(node), pa.array(sizes.astype(np.int32)), _blobs(features, first, 4, keep), _blobs(maps, at, 8, keep)]
        return pa.RecordBatch.from_arrays(rows, ["id", "rep", "doc_id", "digest", "node", "size", "features", "bitmap"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, parts, rows, volume = TaskContext.get().partitionId() << 36, [], 0, 0
        for chunk in chunks(batches, "text"):
            for part in (chunk.slice(i, 256) for i in range(0, chunk.num_rows, 256)):
                if parts and (rows + part.num_rows > 1 << BLOCK or volume > 4_000_000):
                    yield block(start, parts)
                    start, parts, rows, volume = start + (1 << BLOCK), [], 0, 0
                features, first = feature_sets(part.column("text"), n)
                parts.append((features, first, part.column("doc_id"), part.column("digest")))
                rows, volume = rows + part.num_rows, volume + len(features)
        if parts:
            yield block(start, parts)
        parts = []
        release()

    return docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(run, SETS)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, not more than a block has at a time."""
    for batch in batches:
        yield from (batch.slice(at, 1 << BLOCK) for at in range(0, batch.num_rows, 1 << BLOCK))


def _counts(reps: DataFrame) -> np.ndarray:
    """How many sets have the features of each cell: one table of 2 ** CELLS numbers, whatever the corpus.

    A task leaves out the cells that it counts once: what is rare needs no exact count, as counts decide cost only.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << partenum.CELLS, np.int64)
        for part in _parts(batches):
            np.add.at(total, partenum.cells(_from_blobs(part.column(0))[0]), 1)
        at = np.flatnonzero(total > 1)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])
        del total, at
        release()

    got = reps.select("features").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << partenum.CELLS, np.int64)
    counts[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return counts


def _dense(reps: DataFrame, order: Broadcast, threshold: float, lows: np.ndarray) -> np.ndarray:
    """Whether the features that a set would send occur DENSE times or more, by band, on average over one set of SAMPLE."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, times = np.zeros(len(lows)), np.zeros(len(lows))
        for part in _parts(batches):
            features, first = _from_blobs(part.column(0))
            band = partenum.band_of(np.diff(first), lows)
            value, which, _ = prefix.heads(features, first, order.value, threshold, np.ones(len(band), bool))
            sets += np.bincount(band, minlength=len(lows))
            times += np.bincount(band[which], prefix.counts(order.value, value), len(lows))
        at = np.flatnonzero(sets)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sets[at]), pa.array(times[at])], ["band", "sets", "times"])
        release()

    got = reps.where(F.pmod("id", F.lit(SAMPLE)) == 0).select("features").mapInArrow(measure, "band int, sets double, times double").groupBy("band").agg(F.sum("sets"), F.sum("times")).toArrow()
    dense = np.zeros(len(lows), bool)
    band, sets, times = (c.to_numpy() for c in got.columns)
    dense[band] = times >= DENSE * sets
    return dense


def _sent(threshold: float, order: Broadcast, dense: np.ndarray, lows: np.ndarray, buckets: int):
    """Packed first features by block and bucket, of sets that pairs of bands that aren't dense may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            features, first = _from_blobs(batch.column("features"))
            cuts = [0]
            for i in range(1, len(ids)):  # blocks, and parts of them of about 2,000,000 features
                if ids[i] >> BLOCK != ids[i - 1] >> BLOCK or first[i + 1] - first[cuts[-1]] > 2_000_000:
                    cuts.append(i)
            for lo, hi in zip(cuts, [*cuts[1:], len(ids)]):
                if hi == lo:
                    continue
                mine, start = first[lo : hi + 1] - first[lo], int(ids[lo]) >> BLOCK << BLOCK
                band = partenum.band_of(np.diff(mine), lows)
                value, which, place = prefix.heads(features[first[lo] : first[hi]], mine, order.value, threshold, ~(dense[band] & dense[band + 1]))
                rank = np.argsort(value)
                value, which, place = value[rank], which[rank], place[rank]
                maps = np.frombuffer(b"".join(batch.column("bitmap")[lo + i].as_py() for i in range(hi - lo)), U64)
                at = np.append(0, np.cumsum(partenum.bitmap_words(np.diff(mine))))
                bucket = ((value.astype(U64) * U64(buckets)) >> U64(32)).astype(np.int64)
                got, begin = [], 0
                for end in np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)) if len(bucket) else ():
                    data = prefix.pack(value[begin:end], which[begin:end], place[begin:end], ids[lo:hi] - start, maps, at, np.diff(mine))
                    got.append((int(bucket[begin]), start, len(data), codec.compress(data, asbytes=True)))
                    begin = end
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["bucket", "start", "length", "data"])
        release()

    return run


def _hang(threshold: float, dense: np.ndarray, lows: np.ndarray):
    """A forest of the sets of each bucket that possible pairs connect; rows lie side by side by bucket."""

    def bucket(parts: list[tuple]) -> pa.RecordBatch:
        value, of, place, ids, sizes, maps = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        n = len(ids)
        lists = prefix.Lists(value, of, place, sizes, maps, ~dense[partenum.band_of(sizes, lows)], threshold)
        del value, of, place
        none = np.zeros(0, np.int64)
        waiting, more = [(none, none)], 0
        for pair in lists.joined():
            waiting.append(pair)
            more += len(pair[0])
            if more > max(n, prefix.AT_ONCE):  # a forest has fewer than n, so these are twice as many at most
                waiting, more = [_forest(waiting, n)], 0
        i, j = _forest(waiting, n)
        return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        held, parts, sets = None, [], 0
        for batch in batches:
            for number, start, length, data in zip(*(c.to_pylist() for c in batch.columns)):
                if number != held and parts:
                    yield bucket(parts)
                    sets = 0
                held = number
                value, local, place, present, sizes, maps = prefix.unpack(codec.decompress(data, length, asbytes=True))
                parts.append((value, local + sets, place, present + start, sizes, maps))
                sets += len(present)
        if parts:
            yield bucket(parts)
        release()

    return run


def _forest(pairs: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    root = least_joined(*(np.concatenate(x) for x in zip(*pairs)), n)
    use = np.flatnonzero(root != np.arange(n))
    return use, root[use]


def near(reps: DataFrame, order: Broadcast, dense: np.ndarray, lows: np.ndarray, threshold: float, volume: int) -> DataFrame:
    """Pairs a, b by which all similar sets hang together whose larger one isn't of a dense band."""
    heads = int(volume * (1 - threshold)) + 1
    buckets = int(min(1 << 18, max(1, min(LEAST_BUCKETS, heads // 5_000), heads // BUCKET)))
    sent = reps.select("id", "features", "bitmap").mapInArrow(_sent(threshold, order, dense, lows, buckets), "bucket int, start long, length int, data binary")
    return sent.repartition(min(buckets, 20_000), "bucket").sortWithinPartitions("bucket").mapInArrow(_hang(threshold, dense, lows), "a long, b long")


MET = "tie boolean, a long, b long"


def _met(pairs: np.ndarray, ties: np.ndarray) -> pa.RecordBatch:
    both = np.concatenate([pairs, ties])
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(both)) >= len(pairs)), pa.array(both[:, 0]), pa.array(both[:, 1])], ["tie", "a", "b"])


def _signed(threshold: float, shared: Broadcast, buckets: int):
    """Packed signatures by block and bucket; rows without a bucket hold the ties made here."""

    def rows_of(block: int, features: np.ndarray, first: np.ndarray, places: np.ndarray) -> Iterator[tuple]:
        codec = pa.Codec("zstd", 1)
        sign, which, own = partenum.signatures(features, first, threshold, *shared.value)
        sketch = np.zeros(1 << BLOCK, np.uint16)
        sketch[places] = partenum.sketches(features, first)
        bucket = ((sign >> U64(VALUE + 6)) * U64(buckets)) >> U64(58 - VALUE)
        order = np.argsort((bucket << U64(VALUE)) | (sign & U64((1 << VALUE) - 1)))
        bucket, value, where, own = bucket[order].astype(np.int64), sign[order] & U64((1 << VALUE) - 1), places[which[order]], own[order]
        send, ties = partenum.cool(bucket.astype(U64) << U64(VALUE) | value, where, own, sketch)
        if len(ties):
            data = ((block << BLOCK) + ties).astype(np.int64).tobytes()
            yield -1 - block % buckets, block, len(data), codec.compress(data, asbytes=True)
        bucket, value, where, own = bucket[send], value[send], where[send], own[send]
        ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
        at = 0
        for end in ends if len(bucket) else ():
            data = partenum.pack(value[at:end], where[at:end], own[at:end], sketch)
            yield int(bucket[at]), block, len(data), codec.compress(data, asbytes=True)
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            features, first = _from_blobs(batch.column("features"))
            cuts = [0]
            for i in range(1, len(ids)):  # blocks, and parts of them of about 700,000 features
                if ids[i] >> BLOCK != ids[i - 1] >> BLOCK or first[i + 1] - first[cuts[-1]] > 700_000:
                    cuts.append(i)
            for lo, hi in zip(cuts, [*cuts[1:], len(ids)]):
                if hi > lo:
                    got = list(rows_of(int(ids[lo]) >> BLOCK, features[first[lo] : first[hi]], first[lo : hi + 1] - first[lo], ids[lo:hi] & ((1 << BLOCK) - 1)))
                    if not got:
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["bucket", "block", "length", "data"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs and ties of the sets of each bucket; rows lie side by side by bucket."""
    codec = pa.Codec("zstd", 1)
    none = np.zeros((0, 2), np.int64)
    found: list[np.ndarray] = [none, none]

    def bucket(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        value, ids, own, sketch = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(value, kind="stable")
        value = value[order]
        same = np.append(False, value[1:] == value[:-1])
        many = same | np.append(same[1:], False)  # most signatures are alone
        order = order[many]
        return partenum.meet(value[many], ids[order], own[order], sketch[order])

    def add(pairs: np.ndarray, ties: np.ndarray) -> Iterator[pa.RecordBatch]:
        found[0], found[1] = (partenum.distinct(np.concatenate([x, y])) for x, y in zip(found, (pairs, ties)))
        if len(found[0]) + len(found[1]) > 3_000_000:
            yield _met(*found)
            found[:] = none, none

    held, parts = None, []
    for batch in batches:
        for number, block, length, data in zip(*(c.to_pylist() for c in batch.columns)):
            raw = codec.decompress(data, length, asbytes=True)
            if number < 0:
                yield from add(none, np.frombuffer(raw, np.int64).reshape(-1, 2))
                continue
            if number != held and parts:
                yield from add(*bucket(parts))
                parts = []
            held = number
            value, where, own, sketch = partenum.unpack(raw)
            parts.append((value, where + (block << BLOCK), own, sketch))
    if parts:
        yield from add(*bucket(parts))
    if len(found[0]) + len(found[1]):
        yield _met(*found)


def candidates(reps: DataFrame, weights: Weights, dense: np.ndarray, lows: np.ndarray, threshold: float) -> DataFrame:
    """The distinct pairs and ties of the sets with features that share a signature of a dense band."""
    for_bands = [F.col("size").between(int(lows[i]), int(lows[i + 1]) - 1) for i in np.flatnonzero(dense | np.append(dense[1:], False)) if i + 1 < len(lows)]
    reps = reps.where(reduce(Column.__or__, for_bands, F.lit(False)))
    volume = reps.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = int(max(1, min(1 << 18, 3 * volume // BUCKET)))
    weights = reps.sparkSession.sparkContext.broadcast((weights, dense))
    signed = reps.select("id", "features").mapInArrow(_signed(threshold, weights, buckets), "bucket int, block long, length int, data binary")
    return signed.repartition(min(buckets, 20_000), "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, MET).distinct()


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a and the number of features in which the sets of rows (a, x, y) differ."""
    for batch in batches:
        out = [len(np.setxor1d(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), assume_unique=True)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("a"), pa.array(out, pa.int64())], ["id", "radius"])


def _possible(threshold: float):
    """The pairs that bitmaps, sizes and radii don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (batch.column(c).to_numpy().astype(np.int64) for c in ("sa", "sb"))
            reach = sum(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ra", "rb"))
            least = np.maximum(partenum.apart(batch.column("ma").to_pylist(), batch.column("mb").to_pylist()), np.abs(sa - sb)) - reach
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["doc_a", "doc_b"]).filter(pa.array(least <= partenum.differences(threshold, sa + sb + reach)))

    return run


def _groups(sets: DataFrame, threshold: float) -> DataFrame:
    """id and root of the rows (reps) that some chain of ties and possible pairs connects to another."""
    reps, context = sets.where("id = rep and size > 0"), sets.sparkSession.sparkContext
    n, volume, largest = reps.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(1))).first()
    lows, counts = partenum.bands(threshold, largest), _counts(reps)
    order = context.broadcast(prefix.ranks(counts))
    dense = _dense(reps, order, threshold, lows)
    edges = near(reps, order, dense, lows, threshold, volume).toDF("doc_a", "doc_b")
    if not dense.any():
        return _whole(components(edges), "id")
    met = stored(candidates(reps, Weights.of(counts, n), dense, lows, threshold), "met")
    settle(sets.sparkSession)
    ties, pairs = met.where("tie").select("a", "b"), met.where("not tie").select("a", "b")
    ends = limited_broadcast(stored(ties.select("a").union(ties.select("b")).distinct().toDF("id"), "tied"))
    bodies = reps.select("id", "features").join(ends, "id", "left_semi")
    both = ties.join(bodies.toDF("a", "x"), "a").join(bodies.toDF("b", "y"), "b")
    radii = stored(both.select("a", "x", "y").mapInArrow(_distances, "id long, radius long").groupBy("id").agg(F.max("radius").alias("radius")), "radii")
    maps = reps.select("id", "size", "bitmap").join(limited_broadcast(radii), "id", "left").select("id", "size", "bitmap", F.coalesce("radius", F.lit(0)).alias("radius"))
    wide = pairs.join(maps.toDF("a", "sa", "ma", "ra"), "a").join(maps.toDF("b", "sb", "mb", "rb"), "b")
    possible = wide.mapInArrow(_possible(threshold), "doc_a long, doc_b long")
    groups = _whole(components(edges.union(possible).union(ties)), "id")
    discard(met, ends, radii)
    return groups


def _whole(joined: DataFrame, name: str) -> DataFrame:
    """What components() gives, stored, the roots themselves too."""
    return stored(joined.union(joined.select("root", "root").distinct()).toDF(name, "root"), name)


VERIFIED = "node long, other long, links long"


def _verify(threshold: float):
    """Links of each set to those of the other block (or its own), and a forest of them."""

    def run(table: pa.Table) -> pa.Table:
        table = table.append_column("length", pa.compute.binary_length(table.column("features"))).sort_by([("main", "descending"), ("length", "ascending"), ("node", "ascending")])
        i, j = _alike(table, threshold)
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
        root = least_joined(i, j, len(node))
        use = np.flatnonzero((links > 0) | (root != np.arange(len(node))))
        return pa.table({"node": node[use], "other": node[root[use]], "links": links[use].astype(np.int64)})

    return run


def _alike(table: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i and j of the pairs of sets from threshold on: of all where the table has one block, else of one of each.

    If it has main rows, which come first, pairs are of one of these and one other.
    """
    features, first = _from_blobs(table.column("features"))
    size, block, main = np.diff(first), table.column("block").to_numpy(), pa.compute.sum(table.column("main")).as_py() or 0
    single = (block == block[0]).all() if len(block) else True
    _, codes = np.unique(features, return_inverse=True)
    mine = np.zeros(codes.max(initial=0) + 1, bool)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    others = size[:main] if main else size
    begin = np.searchsorted(others, np.ceil(size * threshold - 1e-9)) if main else np.arange(1, len(size) + 1)
    end = np.searchsorted(others, np.floor(size / threshold + 1e-9), "right")
    for i in range(main, len(size)):
        lo, hi = begin[i], end[i]
        if hi <= lo:
            continue
        own = codes[first[i] : first[i + 1]]
        mine[own] = True
        common = np.add.reduceat(mine[codes[first[lo] : first[hi]]], first[lo:hi] - first[lo], dtype=np.int64)
        mine[own] = False
        good = np.flatnonzero(common / (size[i] + size[lo:hi] - common) >= threshold) + lo
        if not single:
            good = good[block[good] != block[i]]
        found.append((np.full(len(good), i), good))
    return tuple(np.concatenate(x) for x in zip(*found))


def _bodies(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """node, doc (its smallest doc_id) and copies (its documents) of every set that has words; root, node, copies and features of those in groups."""
    groups = limited_broadcast(_groups(sets, threshold))
    settle(sets.sparkSession)
    names = stored(sets.where("size > 0").select("node", "doc_id").distinct().groupBy("node").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies")), "names")
    bodies = sets.where("features is not null").join(groups, "id").groupBy("root", "node").agg(F.first("features").alias("features"))
    return names, stored(bodies.join(names, "node").select("root", "node", "copies", "features"), "bodies")


def _verified(bodies: DataFrame, threshold: float) -> DataFrame:
    """node, other and links of the sets of bodies, by all pairs of a group but those of two sets that are both main."""
    sizes = bodies.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("main")).alias("rest")).where("n > 1 and rest > 0")
    blocks = sizes.select("root", F.ceil(F.col("rest") / BLOCK_SETS).alias("blocks"), F.ceil((F.col("n") - F.col("rest")) / BLOCK_SETS).alias("mains"))
    hashed = F.xxhash64("node")
    placed = bodies.join(blocks, "root").withColumn("block", F.when(F.col("main"), F.col("blocks") + F.pmod(hashed, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(hashed, F.col("blocks"))))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") + F.when(F.col("main"), 0).otherwise(F.col("mains")) - 1)))
    keys = [F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]
    found = placed.select("root", *keys, "block", "node", "copies", "main", "features").groupBy("root", "low", "high").applyInArrow(_verify(threshold), VERIFIED)
    return stored(found, "verified")


def _tied(bodies: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame] | None:
    """Links by CENTRES of each group of several blocks, and the sets of the group's largest part that hangs together by them."""
    large = bodies.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_SETS)
    large = stored(large.select("root", F.ceil(F.col("n") / BLOCK_SETS).alias("blocks")), "large")
    if large.isEmpty():
        return None
    hashed, mine = F.xxhash64("node"), bodies.join(limited_broadcast(large), "root")
    parts = mine.select("root", F.pmod(hashed, F.col("blocks")).alias("part"), "node", "features", F.lit(True).alias("main"))
    centres = mine.groupBy("root", "blocks", F.pmod(hashed, F.lit(CENTRES)).alias("turn")).agg(F.min("node").alias("node"), F.min_by("features", "node").alias("features"))
    centres = centres.select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"), "node", "features", F.lit(False).alias("main"))
    both = parts.union(centres).select("root", "part", "node", "features", "main", F.col("main").cast("long").alias("block"), F.lit(1).cast("long").alias("copies"))
    links = stored(both.groupBy("root", "part").applyInArrow(_verify(threshold), VERIFIED).select("node", "other"), "links")
    labels = _whole(components(links.toDF("doc_a", "doc_b")), "node").toDF("node", "label")
    held = stored(mine.select("root", "node").join(labels, "node"), "held")
    most = held.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("label"))
    return links, stored(held.join(most, ["root", "label"]).select("node", F.lit(True).alias("main")), "main")


def _named(names: DataFrame, links: DataFrame) -> DataFrame:
    """names with the class_id of the sets that links (node, other) connect, null for the others."""
    roots = _whole(components(links.toDF("doc_a", "doc_b")), "node")
    least = roots.join(names, "node").groupBy("root").agg(F.min("doc").alias("class_id"))
    return names.join(roots.join(least, "root").select("node", "class_id"), "node", "left")


def _linked(sets: DataFrame, join: Join) -> DataFrame:
    """node, doc (its smallest doc_id), copies (its documents), class_id and n_links of every set that has words."""
    names, bodies = _bodies(sets, join.threshold)
    found = _verified(bodies.withColumn("main", F.lit(False)), join.threshold)
    discard(bodies)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = _named(names, found.select("node", "other"))
    return named.join(links, "node", "left").select("node", "doc", "copies", F.coalesce("class_id", "doc").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))


def _shared(sets: DataFrame, join: Join) -> DataFrame:
    """node and class_id of every set whose class has other documents."""
    names, bodies = _bodies(sets, join.threshold)
    tied = _tied(bodies, join.threshold)
    if tied:
        flagged = bodies.join(limited_broadcast(tied[1]), "node", "left").withColumn("main", F.coalesce("main", F.lit(False)))
        links = _verified(flagged, join.threshold).select("node", "other").union(tied[0])
    else:
        links = _verified(bodies.withColumn("main", F.lit(False)), join.threshold).select("node", "other")
    discard(bodies)
    return _named(names, links).where("copies > 1 or class_id is not null").select("node", F.coalesce("class_id", "doc").alias("class_id"))


def classes(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, class_id and n_links of every document."""
    sets = stored(sets_of(docs, join.n), "sets")
    rows = sets.select("doc_id", "node").distinct().join(_linked(sets, join).select("node", "class_id", "n_links"), "node", "left")
    return rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def least_joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that the edges a, b join to each of the numbers below n."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], least)
        np.minimum.at(after, root[b], least)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.stack([batch.column(c).to_numpy() for c in range(2)]) for batch in batches]
    ids, place = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *parts], axis=1), return_inverse=True)
    a, b = place.reshape(2, -1)
    root = least_joined(a, b, len(ids))
    use = root != np.arange(len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[use]), pa.array(ids[root[use]])], ["doc_id", "root"])
    del parts, ids, place, a, b, root, use
    release()


def components(pairs: DataFrame) -> DataFrame:
    """doc_id and root (the smallest doc_id joined to it by pairs) of every document in a pair but the roots.

    Alternating large-star and small-star steps (Kiveris et al. 2014), until nothing changes; every step is one
    shuffle by document, and its result is stored, so that no step is repeated when executors are lost. Edges of
    ONE_TASK bytes or less are joined by one task, with the same result.
    """
    edges = stored(pairs.select(F.col("doc_a").alias("u"), F.col("doc_b").alias("v")).where("u <> v").distinct(), "edges")
    if size_in_bytes(edges) <= ONE_TASK:
        return edges.coalesce(1).mapInArrow(_joined, "doc_id long, root long")

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            ends = edges.union(edges.select("v", "u"))
        else:
            ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = ends.join(low, "u")
        linked = joined.where("v > u" if large else "true").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            linked = linked.union(low.select("u", F.col("m").alias("v")))
        return linked.where("u <> v").distinct()

    before = None
    while True:
        former, edges = edges, stored(star(star(edges, True), False), "edges")
        discard(former)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("root"))
        before = now


def keep_one(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """The rows of docs but for documents whose class has a document of smaller doc_id, and other texts of the one that stays."""
    sets = stored(sets_of(docs, join.n), "sets")
    rows = sets.where("size > 0").join(_shared(sets, join), "node")
    stays = rows.where("doc_id = class_id").groupBy("class_id").agg(F.min("digest").alias("stays"))
    mine, text = fresh(docs, "gone_id", "gone_text")
    gone = rows.join(stays, "class_id").where("doc_id <> class_id or digest <> stays").select(F.col("doc_id").alias(mine), F.col("digest").alias(text)).distinct()
    gone = limited_broadcast(stored(gone, "gone"))
    return docs.join(gone, (docs["doc_id"] == gone[mine]) & (F.xxhash64(docs["text"]) == gone[text]), "left_anti")
