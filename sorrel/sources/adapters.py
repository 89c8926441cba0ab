"""Catalogs made of the star-schema tables, so that all operators run at any scale factor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sorrel.plans.catalog import Catalog


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their place in the order and the part and supplier of the next line."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    cols = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return cols.select("*", F.row_number().over(w).alias("place"), F.lead("l_partkey").over(w).alias("next_part"), F.lead("l_suppkey").over(w).alias("next_supp"))


def _looked_up(lines: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """Lines with what found has of their key. Last lines of orders have none: by a second key they are dealt out, else one task has them all."""
    dealt = lines.withColumn("__key", F.coalesce(key, "l_orderkey"))
    return dealt.join(found.withColumn("__key", F.col(key)), [key, "__key"], "left").drop("__key")


def file_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    inner = F.concat(F.lit("pkg/n"), F.col("s_nationkey"), F.lit("/m"), k)
    path = F.when(k % 5 == 0, F.concat(F.lit("tests/test_m"), k)).when(k % 7 == 3, F.concat(F.lit("pkg/cli/m"), k)).when(k % 29 == 6, F.concat(inner, F.lit("/main"))).when(k % 31 == 8, F.concat(inner, F.lit("/manage"))).otherwise(inner)
    base = _read(spark, sf_dir, "supplier").select(k.alias("file_id"), F.concat(path, F.lit(".py")).alias("rel_path"), "s_acctbal")
    return base.select("file_id", "rel_path", F.concat(F.lit("/repo/"), "rel_path").alias("abs_path"), F.replace(F.regexp_replace("rel_path", r"\.py$", ""), F.lit("/"), F.lit(".")).alias("module_path"), F.sha2(F.col("rel_path").cast("binary"), 256).alias("sha256"), (F.col("file_id") * 131 % 9000 + 100).alias("size_bytes"), F.when(F.col("file_id") % 17 == 0, F.lit(0)).otherwise(F.lit(1_700_000_000) + F.col("file_id") * 7919 % 100_000).cast("long").alias("mtime"), F.lit(1_800_000_000).cast("long").alias("indexed_at"), F.when(F.col("s_acctbal") < -500, F.lit("SyntaxError: invalid syntax")).alias("parse_error"))


def symbol_table(spark: SparkSession, sf_dir: str, file: DataFrame) -> DataFrame:
    count = _read(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"), F.min("s_suppkey").alias("least"))
    k = F.col("p_partkey")
    parts = _read(spark, sf_dir, "part").crossJoin(F.broadcast(count)).select(k.alias("symbol_id"), (k % F.col("n") + F.col("least")).alias("file_id"), "p_name", "p_type", "p_size")
    base = parts.join(file.select("file_id", "module_path"), "file_id")
    k = F.col("symbol_id")
    stem = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), k)
    name = F.when(k % 13 == 0, F.concat(F.lit("__"), stem, F.lit("__"))).when(k % 11 == 0, F.concat(F.lit("_"), stem)).when(F.col("file_id") % 5 == 0, F.concat(F.lit("test_"), stem)).otherwise(stem)
    kind = F.when(k % 23 == 0, "constant").when(k % 4 < 2, "function").when(k % 4 == 2, "method").otherwise("class")
    base = base.select("*", kind.alias("kind"), name.alias("name"), F.concat("module_path", F.when((F.col("file_id") % 5 == 0) & (k % 3 == 0), F.lit(".TestK")).otherwise(F.lit(".K")), k % 7).alias("cls"))
    parent = F.when(F.col("kind") == "method", F.col("cls"))
    lines = (F.col("p_size") * 7 % 120 + 1).cast("int")
    flat = F.col("kind").isin("class", "constant")
    lineno = (k * 37 % 900 + 1).cast("int")
    return base.select("symbol_id", "file_id", "name", F.concat(F.coalesce(parent, "module_path"), F.lit("."), "name").alias("qualified_name"), "kind", parent.alias("parent_qname"), lineno.alias("lineno"), (lineno + lines - 1).alias("end_lineno"), F.lit(0).alias("col"), F.when(k % 6 != 0, F.col("p_type")).alias("docstring"), F.when(~flat, F.concat(F.lit("("), F.when(F.col("kind") == "method", F.lit("self, ")).otherwise(F.lit("")), F.lit("a"), k % 3, F.lit(", *, b=1)"))).alias("signature"), F.col("name").startswith("_").cast("int").alias("is_private"), F.when(flat, 0).otherwise(F.col("p_size")).cast("int").alias("complexity"), lines.alias("line_count"))


def tables(spark: SparkSession, sf_dir: str) -> Catalog:
    """Suppliers as files, parts as symbols, and every order line as a call and an import of what the next line has."""
    file = file_table(spark, sf_dir)
    symbol = symbol_table(spark, sf_dir, file)
    lines = _lines(spark, sf_dir)
    edge_id = F.col("l_orderkey") * 1000 + F.col("place")
    callee = symbol.select(F.col("symbol_id").alias("next_part"), F.when(F.col("kind") == "method", F.concat(F.element_at(F.split("parent_qname", r"\."), -1), F.lit("."), "name")).otherwise(F.col("name")).alias("callee"))
    calls = _looked_up(lines, "next_part", callee).select(edge_id.alias("edge_id"), F.col("l_partkey").alias("caller_symbol_id"), F.coalesce("callee", F.concat(F.lit("ext.f"), F.col("l_partkey") % 50)).alias("callee_name"), F.col("next_part").alias("resolved_symbol_id"), (F.col("l_partkey") * 11 % 900 + 1).cast("int").alias("lineno"))
    target = file.select(F.col("file_id").alias("next_supp"), "module_path")
    imports = _looked_up(lines, "next_supp", target)
    imports = imports.select(edge_id.alias("edge_id"), F.col("l_suppkey").alias("file_id"), F.coalesce("module_path", F.concat(F.lit("lib"), F.col("l_partkey") % 9)).alias("imported_module"), F.when(edge_id % 3 != 0, F.concat(F.lit("name"), edge_id % 10)).alias("imported_name"), F.when(edge_id % 4 == 0, F.concat(F.lit("al"), edge_id % 10)).alias("alias"), (edge_id % 40 + 1).cast("int").alias("lineno"), F.col("next_supp").alias("resolved_file_id"))
    return Catalog(file, symbol, imports, calls)


def _tasks(spark: SparkSession) -> int:
    """Partitions of modules to parse: the tables are small files, which one task would read, and the text is long only when it is written."""
    return 4 * spark.sparkContext.defaultParallelism


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python source written from the tables: for each supplier a module with a function or class for each of its parts.

    Every supplier has one module; each part one definition with p_size % 12 branches, a call of the next part's
    function where the order lines have one, imports (every third unused), and comments with tags.
    """
    count = _read(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"), F.min("s_suppkey").alias("least"))
    part = _read(spark, sf_dir, "part").crossJoin(F.broadcast(count)).select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % F.col("n") + F.col("least")).alias("s"), (F.col("p_size") % 12).cast("int").alias("b"), "n", "least").repartition(_tasks(spark), "s")
    k = F.col("k")
    branch = F.when(F.col("b") > 0, F.concat(F.lit("\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.col("b"), F.lit(1))), lambda i: F.concat(F.lit("    if x > "), i, F.lit(":\n        x -= 1"))), "\n"))).otherwise(F.lit(""))
    note = F.when(k % 9 == 0, F.concat(F.lit("  # TODO: part "), k)).when(k % 14 == 0, F.concat(F.lit("  # HACK part "), k)).otherwise(F.lit(""))
    call = F.when(k % 4 == 1, F.concat(F.lit("    f"), k + F.col("n"), F.lit("(x)\n"))).when(k % 4 == 2, F.lit("    os.getcwd()\n")).when(k % 4 == 3, F.concat(F.lit("    m"), F.col("least") + (k + 1) % F.col("n"), F.lit(".f"), k + 1, F.lit("(x)\n"))).otherwise(F.lit(""))
    body = F.concat(F.lit("def f"), k, F.lit("(x, y=0):"), note, F.lit('\n    """part '), k, F.lit('"""'), branch, F.lit("\n"), call, F.lit("    return x\n"))
    modules = part.select("s", "k", "n", "least", body.alias("body")).groupBy("s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "body"))), lambda e: e["body"]), "\n\n").alias("bodies"), F.first("n").alias("n"), F.first("least").alias("least"))
    s = F.col("s")
    head = F.concat(F.lit("import os\n"), F.when(s % 3 == 0, F.lit("import json\n")).otherwise(F.lit("")), F.when(s % 4 == 0, F.lit("import re  # noqa: F401\n")).otherwise(F.lit("")), F.lit("import m"), F.col("least") + (s - F.col("least") + 1) % F.col("n"), F.lit("\n\nLIMIT = "), s, F.lit("\n\n\n"))
    return modules.select(F.concat(F.lit("m"), s, F.lit(".py")).alias("rel_path"), F.concat(head, "bodies").alias("content"), F.lit(1_700_000_000).cast("long").alias("mtime"))


#: A module with a class: {s} stands for its own number, {n} for that of the next module.
CLASSES = '''"""Module {s}."""
from __future__ import annotations

from pkg.x{n} import Widget{n}, helper{n}
from pkg.x{n} import (
    shared{n} as renamed,
    spare{n},
)
import pkg.x{n} as other
import x{n}
from . import sibling
from pkg.x{n} import (
    LIMIT as bound,
    _HIDDEN as hidden,  # noqa: F401
)

LIMIT = {s}
_HIDDEN = 1


class Widget{s}:
    """Widget {s}."""

    SIZE = 1

    def __init__(self, owner):
        self.owner = owner

    def draw(self, x, /, y=1, *, z=2):
        """Draws {s}."""
        self.refresh()
        for i in range(x):
            if i and y or z:
                return i
        return _private{s}(x)

    def refresh(self):
        while self.owner:
            try:
                self.owner.pop()
            except ValueError:
                assert self.owner


def helper{s}(x):
    return Widget{s}.draw(x)


def shared{s}(x, *rest, key=None, **more):
    w = Widget{n}(x)
    w.draw(x)
    helper{n}(x)
    renamed(x)
    other.helper{n}(x)
    Widget{n}.refresh(x)
    helper{s}(x)
    x{n}.spare{n}(x)
    return x.y.z(key)


def spare{n}(x):
    spare{n}(x)
    return [a for a in x if a]


def _private{s}(x):
    return x if x else 0


def spare{s}(x):
    return x


def spare{s}(x):
    return helper{s}(x)
'''


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier the module CLASSES, which uses that of the next supplier by every kind of import and call."""
    count = _read(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"), F.min("s_suppkey").alias("least"))
    s = F.col("s_suppkey")
    after = F.col("least") + (s - F.col("least") + 1) % F.col("n")
    body = F.replace(F.replace(F.lit(CLASSES), F.lit("{s}"), s.cast("string")), F.lit("{n}"), after.cast("string"))
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey").repartition(_tasks(spark)).crossJoin(F.broadcast(count))
    return rows.select(F.concat(F.lit("pkg/x"), s, F.lit(".py")).alias("rel_path"), body.alias("content"), F.lit(1_700_000_000).cast("long").alias("mtime"))
