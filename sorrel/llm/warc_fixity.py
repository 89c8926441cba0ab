"""Merkle fixity audit of WARC replicas.

Each WARC file of a replica gets a tree. A leaf hashes a record's offset range and the SHA-256 sum of its bytes; a
node hashes the offset range that its children cover and their hashes, FANOUT of them in order. The audit compares
the roots of the files, then descends level by level through those nodes only whose hashes differ, down to the
records: corrupt (bytes differ), moved (same bytes, other offset), missing and extra ones.

Hashes of different levels are told apart by a prefix, so a node can't pass for a leaf.

Records come from WARC files (read_records) or are made of pages (page_records). Defined results: a file that one
replica lacks has all its records reported missing or extra; empty replicas have no trees. Records are matched by
file, record_id and, where several have the same, their order. A page with null page_id goes to file -1, null url
and html count as empty. Records of the same bytes at the same offsets match, whatever the order of the input rows.
Columns that aren't used are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.llm.storage import stored

FANOUT = 16
RECORDS_PER_FILE = 1000
RECORDS = "file long, record_id string, position long, bytes binary"
TREE = "file long, level int, node long, begin long, end long, hash binary, record_id string, copy int, digest binary"

_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)")
_ID = re.compile(rb"(?im)^warc-record-id:[ \t]*<?([^>\r\n]*)>?")


def page_records(pages: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """One WARC resource record for each page; a file holds a range of per_file page_ids, in order."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    record_id = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <"), record_id, F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    file = F.coalesce(F.floor(F.col("page_id") / F.lit(per_file)), F.lit(-1)).cast("long")
    return pages.select(file.alias("file"), record_id.alias("record_id"), F.coalesce("page_id", F.lit(-1)).cast("long").alias("position"), F.concat(head, html, F.lit("\r\n\r\n")).cast("binary").alias("bytes"))


def split_records(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each record of a WARC file, uncompressed (or compressed as a whole or by record)."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.GzipFile(fileobj=io.BytesIO(content)).read()
    at = 0
    while at < len(content):
        head = content.find(b"\r\n\r\n", at)
        length = _LENGTH.search(content, at, head + 2) if head >= 0 else None
        end = head + 4 + int(length[1]) + 4 if length else len(content)
        yield at, content[at:end]
        at = end


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files below a folder; file is a hash of the file's path from there.

    Spark reads each file whole, so one may have up to 2 GB. A record without Content-Length goes to the end of its
    file, one cut short is what is there of it, and an empty file has no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(file, (_ID.search(b) or [b"", b""])[1].decode(errors="replace"), at, b) for at, b in split_records(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.binary()))] if rows else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.int64(), pa.binary())], ["file", "record_id", "position", "bytes"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    name = F.substr("path", F.lit(len(whole) + 2))
    return files.select(F.xxhash64(name).alias("file"), "content").mapInArrow(run, RECORDS)


def _leaf(begin: int, size: int, digest: bytes) -> bytes:
    return hashlib.sha256(b"\0" + struct.pack(">QQ", begin, size) + digest).digest()


def _node(begin: int, end: int, children: list[bytes]) -> bytes:
    return hashlib.sha256(b"\1" + struct.pack(">QQ", begin, end) + b"".join(children)).digest()


def _grow(fanout: int):
    def grow(table: pa.Table) -> pa.Table:
        """All levels of one file's tree, from rows of (file, record_id, position, size, digest)."""
        table = table.sort_by([("position", "ascending"), ("record_id", "ascending"), ("digest", "ascending")])
        ids, digests, sizes = table.column("record_id").to_pylist(), table.column("digest").to_pylist(), table.column("size").to_numpy()
        ends = np.cumsum(sizes)
        begins = (ends - sizes).tolist()
        ends = ends.tolist()
        seen: dict[str, int] = {}
        copies = []
        for x in ids:
            seen[x] = seen.get(x, 0) + 1
            copies.append(seen[x])
        hashes = [_leaf(b, e - b, d) for b, e, d in zip(begins, ends, digests)]
        n = len(hashes)
        out = {"level": [0] * n, "node": list(range(n)), "begin": begins, "end": ends, "hash": hashes, "record_id": ids, "copy": copies, "digest": digests}
        level = 0
        while n > 1:
            level += 1
            groups = [range(i, min(n, i + fanout)) for i in range(0, n, fanout)]
            begins, ends = [begins[g[0]] for g in groups], [ends[g[-1]] for g in groups]
            hashes = [_node(b, e, hashes[g[0] : g[-1] + 1]) for b, e, g in zip(begins, ends, groups)]
            n = len(hashes)
            for name, values in (("level", [level] * n), ("node", list(range(n))), ("begin", begins), ("end", ends), ("hash", hashes), ("record_id", [None] * n), ("copy", [None] * n), ("digest", [None] * n)):
                out[name] = out[name] + values
        file = table.column("file")[0].as_py()
        types = {"level": pa.int32(), "node": pa.int64(), "begin": pa.int64(), "end": pa.int64(), "hash": pa.binary(), "record_id": pa.string(), "copy": pa.int32(), "digest": pa.binary()}
        return pa.table({"file": pa.array([file] * len(out["level"]), pa.int64())} | {k: pa.array(v, types[k]) for k, v in out.items()})

    return grow


def trees(records: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The nodes of every file's tree; leaves have level 0. Only digests and sizes are shuffled."""
    leaves = records.select("file", "record_id", "position", F.octet_length("bytes").cast("long").alias("size"), F.unhex(F.sha2("bytes", 256)).alias("digest"))
    return leaves.groupBy("file").applyInArrow(_grow(fanout), TREE)


def _differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """file and node where the hashes of two sets of nodes of one level differ, or one is absent."""
    a, b = ours.select("file", "node", F.col("hash").alias("__a")), theirs.select("file", "node", F.col("hash").alias("__b"))
    return a.join(b, ["file", "node"], "full").where(~F.col("__a").eqNullSafe(F.col("__b"))).select("file", "node")


def audit(ours: DataFrame, theirs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """file, record_id, copy, status and both offset ranges of every record that two replicas don't share.

    ours and theirs are trees(); a file's trees may differ in height, so its walk begins at the taller one's root.
    """
    ours, theirs = stored(ours, "tree"), stored(theirs, "tree")
    top = ours.select("level").union(theirs.select("level")).agg(F.max("level")).first()[0] or 0
    heights = ours.union(theirs).groupBy("file").agg(F.max("level").alias("height"))
    bad = None
    for level in range(top, -1, -1):
        # the roots of files of this height, and the children of differing nodes
        roots = heights.where(F.col("height") == level).select("file")

        def reached(tree: DataFrame) -> DataFrame:
            nodes = tree.where(F.col("level") == level)
            here = nodes.join(roots, "file", "left_semi")
            if bad is None:
                return here
            parents = bad.select("file", F.col("node").alias("__parent"))
            below = nodes.withColumn("__parent", F.floor(F.col("node") / F.lit(fanout))).join(parents, ["file", "__parent"], "left_semi")
            return here.unionByName(below.drop("__parent"))

        bad = stored(_differing(reached(ours), reached(theirs)), "differing")
    side = lambda t, s: t.where("level = 0").join(bad, ["file", "node"], "left_semi").select("file", "record_id", "copy", F.col("begin").alias(f"{s}begin"), F.col("end").alias(f"{s}end"), F.col("digest").alias(f"__{s}digest"))
    both = side(ours, "").join(side(theirs, "replica_"), ["file", "record_id", "copy"], "full")
    status = F.when(F.col("replica_begin").isNull(), "missing").when(F.col("begin").isNull(), "extra").when(F.col("__digest") != F.col("__replica_digest"), "corrupt").when((F.col("begin") != F.col("replica_begin")), "moved")
    return both.withColumn("status", status).where("status is not null").select("file", "record_id", "copy", "status", "begin", "end", "replica_begin", "replica_end")


def damaged(pages: DataFrame, often: int = 50, seldom: int = 1500) -> DataFrame:
    """Pages as a damaged replica has them, for drills: by a hash of page_id, one of often has its first character
    overwritten, one of seldom is cut short by a character, and one of seldom is missing."""
    draw: Column = F.conv(F.substring(F.md5(F.concat(F.lit("fault:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("long")
    html = F.coalesce("html", F.lit(""))
    hurt = F.when(draw % often == 0, F.concat(F.lit("~"), F.substr(html, F.lit(2)))).when(draw % seldom == 1, F.left(html, F.greatest(F.length(html) - 1, F.lit(0)))).otherwise(html)
    return pages.where(draw % seldom != 2).select("page_id", "url", hurt.alias("html"))
