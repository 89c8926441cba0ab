"""The four tables of a code catalog, and their upkeep on disk."""

from __future__ import annotations

import json
import os
import sys
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sorrel.plans import resolve
from sorrel.plans.cuts import cut, stored
from sorrel.sources import parser, scan

SCHEMA_VERSION = 2
FILE = "file_id long, rel_path string, abs_path string, module_path string, sha256 string, size_bytes long, mtime long, indexed_at long, parse_error string"
SYMBOL = "symbol_id long, file_id long, name string, qualified_name string, kind string, parent_qname string, lineno int, end_lineno int, col int, docstring string, signature string, is_private int, complexity int, line_count int"
IMPORT = "edge_id long, file_id long, imported_module string, imported_name string, alias string, lineno int, resolved_file_id long"
CALL = "edge_id long, caller_symbol_id long, callee_name string, resolved_symbol_id long, lineno int"
SOURCE = "rel_path string, content string, mtime long"
SPAN = 1 << 20  # ids of a file's parts are file_id * SPAN + their place in the file


@dataclass
class Catalog:
    """DataFrames of the tables; source (rel_path, content, mtime) is there where text operators are wanted."""

    file: DataFrame
    symbol: DataFrame
    import_edge: DataFrame
    call_edge: DataFrame
    source: DataFrame | None = None

    def cached(self) -> Catalog:
        """The same with its tables cached, for several queries in a row."""
        for table in (self.file, self.symbol, self.import_edge, self.call_edge, self.source):
            if table is not None:
                table.cache()
        return self

    def views(self) -> Catalog:
        """Registers the tables as temporary views of their names, for SQL."""
        for name in ("file", "symbol", "import_edge", "call_edge"):
            getattr(self, name).createOrReplaceTempView(name)
        return self


def numbered(files: DataFrame) -> DataFrame:
    """files with file_id by order of rel_path.

    Paths are range-sorted, and the sizes of the partitions before give each its first id, so no task holds all rows.
    The sorted paths are checkpointed, since both steps must see the same partitions.
    """
    ordered = cut(files.select("rel_path").repartitionByRange("rel_path").sortWithinPartitions("rel_path").select("rel_path", F.monotonically_increasing_id().alias("__id")))
    part, place = F.shiftright("__id", 33), F.col("__id") % (1 << 33)
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    ids = ordered.withColumn("__part", part).join(F.broadcast(before), "__part").select("rel_path", (F.col("__before") + place + 1).alias("file_id"))
    return files.join(ids, "rel_path")


def assemble(parsed: DataFrame, resolved: bool = True) -> Catalog:
    """The catalog of parsed files (see parser.parse), with edges resolved."""
    files = numbered(parsed)
    file = files.select("file_id", "rel_path", "abs_path", "module_path", "sha256", "size_bytes", "mtime", "indexed_at", "parse_error")
    part = lambda c: F.col("file_id") * SPAN + F.col(c)
    symbol = files.select("file_id", F.posexplode("symbols").alias("pos", "s")).select(part("pos").alias("symbol_id"), "file_id", *(f"s.{f.name}" for f in parser.SYMBOL_TYPE))
    imports = files.select("file_id", F.posexplode("imports").alias("pos", "i")).select(part("pos").alias("edge_id"), "file_id", *(f"i.{f.name}" for f in parser.IMPORT_TYPE))
    # of symbols of one qualified name in a file the last takes the calls; calls of others are dropped
    owner = symbol.groupBy("file_id", F.col("qualified_name").alias("caller_qname")).agg(F.max("symbol_id").alias("caller_symbol_id"))
    calls = files.select("file_id", F.posexplode("calls").alias("pos", "c")).select("file_id", "pos", "c.*").join(owner, ["file_id", "caller_qname"]).select(part("pos").alias("edge_id"), "caller_symbol_id", "callee_name", "lineno")
    out = Catalog(file, symbol, imports.withColumn("resolved_file_id", F.lit(None).cast("long")), calls.withColumn("resolved_symbol_id", F.lit(None).cast("long")), files.select("rel_path", "content", "mtime"))
    return resolve.resolved(out) if resolved else out


def from_source(source: DataFrame) -> Catalog:
    """The catalog of a table of sources (rel_path, content, mtime), each parsed once."""
    return assemble(stored(parser.parse(source), "parsed"))


def changes(file: DataFrame, on_disk: DataFrame) -> DataFrame:
    """rel_path and status (added, modified, removed, unchanged) from the index and (rel_path, sha256) on disk.

    A file that can't be read has a null sha256 on disk and counts as modified.
    """
    a = file.select("rel_path", F.col("sha256").alias("__was"), F.lit(True).alias("__indexed"))
    b = on_disk.select("rel_path", F.col("sha256").alias("__is"), F.lit(True).alias("__there"))
    status = F.when(F.col("__indexed").isNull(), "added").when(F.col("__there").isNull(), "removed").when(F.col("__was").eqNullSafe(F.col("__is")) & F.col("__is").isNotNull(), "unchanged").otherwise("modified")
    return a.join(b, "rel_path", "full").select("rel_path", status.alias("status"))


def change_report(file: DataFrame, on_disk: DataFrame) -> DataFrame:
    """One row: counts by status and what to do about them."""
    n = lambda s: F.count_if(F.col("status") == s)
    row = changes(file, on_disk).agg(n("added").alias("added"), n("modified").alias("modified"), n("removed").alias("removed"), n("unchanged").alias("unchanged_count"))
    row = row.withColumn("total_in_index", F.col("modified") + F.col("removed") + F.col("unchanged_count")).withColumn("total_on_disk", F.col("added") + F.col("modified") + F.col("unchanged_count"))
    some = F.col("added") + F.col("modified") + F.col("removed")
    advice = F.when(some == 0, "no_changes").when(F.col("total_in_index") == 0, "full").when(some > F.greatest(F.lit(20), F.floor(F.col("total_in_index") / 2)), "full").otherwise("incremental")
    return row.withColumn("recommendation", advice)


def reason(row) -> str:
    """A sentence for a row of change_report."""
    some = row["added"] + row["modified"] + row["removed"]
    if row["recommendation"] == "no_changes":
        return "the index matches the files"
    if row["total_in_index"] == 0:
        return "there is no index yet: run a full one"
    if row["recommendation"] == "full":
        return f"{some} of {row['total_in_index']} indexed files changed: a full run costs less"
    return f"{some} changes (added {row['added']}, modified {row['modified']}, removed {row['removed']}): an incremental run will do"


@dataclass
class IndexReport:
    files_seen: int = 0
    files_indexed: int = 0
    files_skipped_unchanged: int = 0
    files_removed: int = 0
    files_with_errors: int = 0
    symbols_total: int = 0
    imports_total: int = 0
    calls_total: int = 0
    elapsed_seconds: float = 0.0


class Store:
    """A catalog in a folder: snapshot directories of Parquet, the current one named in meta.json."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def meta(self) -> dict:
        try:
            with open(f"{self.path}/meta.json") as f:
                return json.load(f)
        except FileNotFoundError:
            return {}

    def _read(self, name: str, schema: str) -> DataFrame:
        snapshot = self.meta().get("snapshot")
        if not snapshot:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{snapshot}/{name}")
        # columns that later schema versions added are 0 or null in older snapshots
        wanted = T._parse_datatype_string(schema)
        zero = {"complexity", "line_count"}
        return found.select(*((F.col(f.name) if f.name in found.columns else F.lit(0 if f.name in zero else None)).cast(f.dataType).alias(f.name) for f in wanted))

    def open(self) -> Catalog:
        return Catalog(self._read("file", FILE), self._read("symbol", SYMBOL), self._read("import_edge", IMPORT), self._read("call_edge", CALL), self._read("source", SOURCE))

    def parsed(self) -> DataFrame:
        return self._read("parsed", parser.PARSED)

    def index(self, source: DataFrame, full: bool = False) -> IndexReport:
        """Brings the catalog up to the sources; files of the same content aren't parsed again."""
        began = time.time()
        hashed = source.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
        old = self.parsed() if not full else self.spark.createDataFrame([], parser.PARSED)
        same = old.join(hashed.select("rel_path", "sha256"), ["rel_path", "sha256"], "left_semi")
        new = parser.parse(hashed.join(old.select("rel_path", "sha256"), ["rel_path", "sha256"], "left_anti").select("rel_path", "content", "mtime"))
        snapshot = f"snapshot-{uuid.uuid4().hex[:12]}"
        folder = f"{self.path}/{snapshot}"
        columns = [f.name for f in T._parse_datatype_string(parser.PARSED)]
        same.select(columns).unionByName(new.select(columns)).write.parquet(f"{folder}/parsed")
        parsed = self.spark.read.schema(parser.PARSED).parquet(f"{folder}/parsed")
        built = assemble(parsed)
        for name in ("file", "symbol", "import_edge", "call_edge", "source"):
            getattr(built, name).write.parquet(f"{folder}/{name}")
        kept = same.count()
        fresh = parsed.join(old.select("rel_path", "sha256"), ["rel_path", "sha256"], "left_anti")
        totals = fresh.agg(F.count(F.lit(1)), F.count("parse_error"), *(F.coalesce(F.sum(F.size(c)), F.lit(0)) for c in ("symbols", "imports", "calls"))).first()
        removed = old.join(source.select("rel_path"), "rel_path", "left_anti").count()
        self._point_to(snapshot)
        return IndexReport(kept + totals[0], totals[0], kept, removed, *totals[1:], elapsed_seconds=time.time() - began)

    def _point_to(self, snapshot: str) -> None:
        meta = {"schema_version": SCHEMA_VERSION, "snapshot": snapshot, "last_indexed_at": int(time.time()), "python": sys.version.split()[0]}
        with open(f"{self.path}/meta.json.new", "w") as f:
            json.dump(meta, f, indent=2)
        os.replace(f"{self.path}/meta.json.new", f"{self.path}/meta.json")


def index_folder(spark: SparkSession, repo: str, store: str, full: bool = False) -> IndexReport:
    os.makedirs(store, exist_ok=True)
    return Store(spark, store).index(scan.read(spark, repo), full)
