"""Stubs of tests for a function, method or class."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.functions.columns import CALLABLE, import_path, pascal_case, signature_params
from sorrel.plans.catalog import Catalog


@dataclass
class Skeleton:
    qualified_name: str
    kind: str
    module: str
    name: str
    filename: str
    body: str


def _stub(name: Column, call: Column) -> Column:
    """One test method that fails until it is written."""
    return F.concat(F.lit("    def test_"), name, F.lit("_smoke(self) -> None:\n        # result = "), call, F.lit("\n        raise NotImplementedError(\"write test_"), name, F.lit('_smoke")\n'))


def _call(name: Column, params: Column) -> Column:
    return F.concat(name, F.lit("("), F.array_join(params, ", "), F.lit(")"))


def skeletons(c: Catalog) -> DataFrame:
    """symbol_id, qualified_name, kind, module, name, filename and body of the stub of every callable.

    A class gets a setUp with its constructor's parameters and a test for each public method in order of line, or
    one test of the constructor where it has none.
    """
    rows = c.symbol.where(F.col("kind").isin(*CALLABLE)).join(c.file.select("file_id", "rel_path", "module_path"), "file_id")
    member = c.symbol.where("kind = 'method'").select(F.col("parent_qname").alias("qualified_name"), "lineno", "symbol_id", F.col("name").alias("m"), signature_params(F.col("signature")).alias("params"))
    entry = F.struct("lineno", "symbol_id", _stub(F.col("m"), _call(F.col("m"), F.col("params"))).alias("stub"))
    made = member.groupBy("qualified_name").agg(F.array_sort(F.collect_list(F.when(~F.col("m").startswith("_"), entry))).alias("tests"), F.min_by("params", F.when(F.col("m") == "__init__", F.col("symbol_id"))).alias("init"))
    rows = rows.join(made, "qualified_name", "left")
    name, module = F.col("name"), import_path(F.col("rel_path"), F.col("module_path"))
    none = F.array().cast("array<string>")
    own = _stub(name, _call(name, signature_params(F.col("signature"))))
    bare = F.lit("    def test_constructs(self) -> None:\n        self.assertIsNotNone(self.subject)\n")
    tests = F.transform(F.coalesce("tests", F.array()), lambda t: t["stub"])
    setup = F.concat(F.lit("    def setUp(self) -> None:\n        # self.subject = "), _call(name, F.coalesce("init", none)), F.lit("\n        self.subject = None\n\n"))
    body = F.when(F.col("kind") == "class", F.concat(setup, F.when(F.size(tests) > 0, F.array_join(tests, "\n")).otherwise(bare))).otherwise(own)
    text = F.concat(F.lit('"""Test stubs for '), module, F.lit("."), name, F.lit('; each fails until it is written."""\n\nfrom __future__ import annotations\n\nimport unittest\n\nfrom '), module, F.lit(" import "), name, F.lit("\n\n\nclass "), pascal_case(name), F.lit("Tests(unittest.TestCase):\n"), body, F.lit('\n\nif __name__ == "__main__":\n    unittest.main()\n'))
    return rows.select("symbol_id", "qualified_name", "kind", module.alias("module"), "name", F.concat(F.lit("test_"), F.lower(name), F.lit("_skeleton.py")).alias("filename"), text.alias("body"))


def skeleton_index(c: Catalog) -> DataFrame:
    """qualified_name, module, test_class, filename and parameters of every callable."""
    rows = c.symbol.where(F.col("kind").isin(*CALLABLE)).join(c.file.select("file_id", "rel_path", "module_path"), "file_id")
    return rows.select("symbol_id", "qualified_name", import_path(F.col("rel_path"), F.col("module_path")).alias("module"), F.concat(pascal_case(F.col("name")), F.lit("Tests")).alias("test_class"), F.concat(F.lit("test_"), F.lower("name"), F.lit("_skeleton.py")).alias("filename"), F.array_join(signature_params(F.col("signature")), ",").alias("params"))


def generate(c: Catalog, target: str) -> Skeleton | None:
    """The stub of one symbol, by qualified name or else by bare name (the smallest id of several)."""
    exact = c.symbol.where(F.col("kind").isin(*CALLABLE) & ((F.col("qualified_name") == target) | (F.col("name") == target)))
    hit = exact.orderBy(F.col("qualified_name") != target, "symbol_id").select("symbol_id").first()
    if hit is None:
        return None
    row = skeletons(c).where(F.col("symbol_id") == hit[0]).first()
    return Skeleton(*(row[x] for x in ("qualified_name", "kind", "module", "name", "filename", "body")))


def write(made: Skeleton, path: str, force: bool = False) -> None:
    """Into a file, which must not be there unless force."""
    if os.path.exists(path) and not force:
        raise FileExistsError(path)
    with open(path, "w", encoding="utf-8") as f:
        f.write(made.body)
