"""Exact dedup against history through minimal perfect hashes.

History is reduced to its distinct digests (SHA-256 of the text), each with a winner, and cut into shards by
digest. For every shard a minimal perfect hash is built: a cascade of bit arrays, each taking the digests that
are alone in their cell, where the rank of a set bit is the slot. A slot holds the full digest and the winner's
locator. A new document looks up its slot and compares all bytes of the digest: equal, it is a repeat of the
winner; else it isn't in history, and such documents are grouped by digest among themselves.

Defined results: the winner of a text is its smallest doc_id in history, or else its smallest doc_id. A null
text equals no other, so each row with one is kept, also where doc_ids repeat; an empty text is a text like any
other. A null doc_id counts as larger than all others. Rows of one doc_id and text are copies, of which one is
kept. A doc_id of 2 ** 63 - 1 counts as null. Columns other than doc_id and text are ignored, or passed through by keep().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.llm.storage import fresh, limited_broadcast, stored
from sorrel.llm.textkit import U64, mix

SHARD_KEYS = 100_000
LEVELS = 64


def _cells(lanes: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = U64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    return (mix(lanes[:, 0] ^ (lanes[:, 1] * (seed | U64(1))) ^ seed) % U64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests, given as an array of shape (n, 4) of uint64."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.base = np.cumsum([0, *sizes])
        self.rank = np.append(0, np.cumsum(bits))

    @classmethod
    def build(cls, lanes: np.ndarray, gamma: float = 1.5) -> PerfectHash:
        sizes, levels, left = [], [], lanes
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(8, int(len(left) * gamma))
            cell = _cells(left, level, size)
            alone = np.bincount(cell, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[cell]]
        if len(left):
            raise ValueError("the digests aren't distinct")
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, lanes: np.ndarray) -> np.ndarray:
        """Slot of each digest; of one that isn't among the keys, any slot or -1."""
        out = np.full(len(lanes), -1, np.int64)
        left = np.arange(len(lanes))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self.base[level] + _cells(lanes[left], level, size)
            here = self.bits[at]
            out[left[here]] = self.rank[at[here]]
            left = left[~here]
        return out


def _lanes(digests: pa.Array) -> np.ndarray:
    digests = digests.combine_chunks() if isinstance(digests, pa.ChunkedArray) else digests
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 4)


def _last() -> Column:
    """Stands for a null doc_id."""
    return F.lit(2**63 - 1)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _build(table: pa.Table) -> pa.Table:
    """A shard's hash with its slots from rows of (shard, digest, winner)."""
    lanes = _lanes(table.column("digest"))
    found = PerfectHash.build(lanes)
    slot = found.slots(lanes)
    digests, winners = np.empty_like(lanes), np.empty(len(lanes), np.int64)
    digests[slot] = lanes
    winners[slot] = table.column("winner").to_numpy()
    return pa.table({"shard": table.column("shard")[:1], "sizes": pa.array([found.sizes], pa.list_(pa.int64())), "bits": pa.array([np.packbits(found.bits).tobytes()], pa.binary()), "digests": pa.array([digests.tobytes()], pa.binary()), "winners": pa.array([winners.tobytes()], pa.binary())})


def index(history: DataFrame, shards: int) -> DataFrame:
    """The perfect hash of each shard of history's distinct digests, from rows of (digest, winner)."""
    return history.select(_shard(shards), "digest", "winner").groupBy("shard").applyInArrow(_build, "shard int, sizes array<long>, bits binary, digests binary, winners binary")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


LOOKED_UP = "digest binary, doc_id long, winner long"


def _look_up(index: pa.Table, new: pa.Table) -> pa.Table:
    """The winner in history of each new row's digest, or null."""
    winner = pa.nulls(new.num_rows, pa.int64())
    if index.num_rows and new.num_rows:
        row = index.to_pylist()[0]
        size = sum(row["sizes"])
        found = PerfectHash(row["sizes"], np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=size).astype(bool))
        held = np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
        lanes = _lanes(new.column("digest"))
        slot = found.slots(lanes)
        same = (slot >= 0) & (held[slot] == lanes).all(axis=1)
        winner = pa.array(np.frombuffer(row["winners"], np.int64)[slot], mask=~same)
    return pa.table({"digest": new.column("digest"), "doc_id": new.column("doc_id"), "winner": winner})


def look_up(rows: DataFrame, built: DataFrame, shards: int) -> DataFrame:
    """digest, doc_id and winner (null for those not in history) of rows of (digest, doc_id)."""
    new = rows.select(_shard(shards), "digest", "doc_id")
    return built.groupBy("shard").cogroup(new.groupBy("shard")).applyInArrow(_look_up, LOOKED_UP)


def _digests(docs: DataFrame, history: Column) -> DataFrame:
    """digest, doc_id (nulls as the largest number) and before of the rows that have a text, stored."""
    rows = docs.select(F.coalesce("doc_id", _last()).alias("doc_id"), digest(F.col("text")).alias("digest"), F.coalesce(history, F.lit(False)).alias("before"))
    return stored(rows.where(F.col("digest").isNotNull()), "digests")


def _kept(rows: DataFrame, shards: int | None) -> DataFrame:
    """digest, winner and in_history for each distinct digest of the rows."""
    # copies meet by partial aggregation before the lookup, so that a text with many of them is one row of its shard
    old = rows.where("before").groupBy("digest").agg(F.min("doc_id").alias("winner"))
    new = rows.where(~F.col("before")).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    if shards is None:
        shards = max(1, -(-rows.count() // SHARD_KEYS))
    looked = look_up(new, index(old, shards), shards)
    others = looked.where(F.col("winner").isNull()).select("digest", F.col("doc_id").alias("winner"), F.lit(False).alias("in_history"))
    return old.withColumn("in_history", F.lit(True)).unionByName(others)


def groups(docs: DataFrame, history: Column, shards: int | None = None) -> DataFrame:
    """doc_id, winner (the doc_id that stays for its text) and in_history (whether that is a text of history) of every row of docs.

    history says which rows of docs came before. shards: by default, so many that each has about SHARD_KEYS
    digests of history and of new rows together. Repeats found in a shard and nonmembers grouped by digest get their
    winner by one join on the digest, in which Spark splits a text of very many copies.
    """
    back = lambda c: F.nullif(c, _last())
    rows = _digests(docs, history)
    found = rows.select("digest", "doc_id").join(_kept(rows, shards), "digest")
    alone = docs.where(F.col("text").isNull()).select("doc_id", F.col("doc_id").alias("winner"), F.coalesce(history, F.lit(False)).alias("in_history"))
    return found.select(back(F.col("doc_id")).alias("doc_id"), back(F.col("winner")).alias("winner"), "in_history").unionByName(alone)


def keep(docs: DataFrame, history: Column, shards: int | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows that go are told by digest and doc_id, so texts aren't shuffled while those are few; of rows that agree
    in both, one is taken.
    """
    rows = _digests(docs, history)
    kept = _kept(rows, shards).select("digest", F.col("winner").alias("doc_id"))
    counts = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    marks = counts.join(kept.withColumn("stays", F.lit(True)), ["digest", "doc_id"], "left").where("stays is null or n > 1")
    name, id_, stays = fresh(docs, "digest", "id", "stays")
    marks = limited_broadcast(stored(marks.select(F.col("digest").alias(name), F.col("doc_id").alias(id_), F.coalesce("stays", F.lit(False)).alias(stays)), "copies"))
    marked = docs.join(marks, (digest(docs["text"]) == marks[name]) & (F.coalesce(docs["doc_id"], _last()) == marks[id_]), "left")
    single = marked.where(F.col(stays).isNull()).select(*docs.columns)
    repeated = marked.where(F.col(stays)).dropDuplicates([name, id_]).select(*docs.columns)
    return single.unionByName(repeated)
