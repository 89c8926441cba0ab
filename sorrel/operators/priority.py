"""A composite ranking of what to refactor first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.functions.columns import test_path_priority
from sorrel.operators.graph import call_pairs, test_entry_points, test_reachability
from sorrel.plans.catalog import Catalog


def complexity_score(complexity: Column) -> Column:
    return F.bround(F.least(complexity / 50.0, F.lit(1.0)) * 100.0, 1)


def size_score(lines: Column) -> Column:
    return F.bround(F.least(lines / 500.0, F.lit(1.0)) * 100.0, 1)


def caller_score(callers: Column) -> Column:
    return F.bround(F.least(F.log2(callers + 1.0) * 25.0, F.lit(100.0)), 1)


def reasons() -> Column:
    """Why a row with complexity, line_count, caller_count and is_untested ranks where it does."""
    cx, lines, callers = F.col("complexity"), F.col("line_count"), F.col("caller_count")
    text = lambda before, c, after: F.concat(F.lit(before), c.cast("string"), F.lit(after))
    found = F.array_compact(
        F.array(
            F.when(cx >= 20, text("complexity ", cx, ": extreme")).when(cx >= 10, text("complexity ", cx, ": high")),
            F.when(lines >= 200, text("", lines, " lines: very long")).when(lines >= 80, text("", lines, " lines: long")),
            F.when(F.col("is_untested"), F.lit("no test reaches it")),
            F.when(callers >= 10, text("", callers, " calls depend on it")).when(callers >= 3, text("", callers, " calls")).when(callers == 0, F.lit("nothing calls it")),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("on the border: can wait")))


def _pool(c: Catalog, include_classes: bool) -> DataFrame:
    """All callables with skipped: test, name, trivial, or null."""
    kinds = ("function", "method", "class")[: 2 + include_classes]
    rows = c.symbol.where(F.col("kind").isin(*kinds)).join(c.file.select("file_id", "rel_path"), "file_id")
    name = F.col("name")
    hidden = (name.startswith("__") & name.endswith("__")) | (F.col("is_private") == 1)
    skipped = F.when(test_path_priority(F.col("rel_path")), "test").when(hidden, "name").when((F.col("complexity") < 3) & (F.col("line_count") < 20), "trivial")
    return rows.withColumn("skipped", skipped)


def refactor_priority(c: Catalog, min_priority: float = 50.0, limit: int | None = 30, include_classes: bool = False, reached: DataFrame | None = None) -> DataFrame:
    """Functions and methods by complexity, length, missing tests and calls; the last two weigh as the first two allow.

    caller_count counts calls, not callers. Where there are no tests at all, everything is untested.
    """
    reached = test_reachability(c) if reached is None else reached
    calls = call_pairs(c).groupBy(F.col("dst").alias("symbol_id")).agg(F.count(F.lit(1)).alias("caller_count"))
    rows = _pool(c, include_classes).where("skipped is null").join(calls, "symbol_id", "left").join(reached.select("symbol_id", F.lit(False).alias("is_untested")), "symbol_id", "left").na.fill(0, ["caller_count"])
    rows = rows.withColumn("is_untested", F.coalesce("is_untested", F.lit(True)))
    rows = rows.withColumn("complexity_score", complexity_score(F.col("complexity"))).withColumn("size_score", size_score(F.col("line_count")))
    weight = (F.col("complexity_score") + F.col("size_score")) / 200.0
    rows = rows.withColumn("untested_penalty", F.when(F.col("is_untested"), weight * 100.0).otherwise(0.0)).withColumn("caller_score", caller_score(F.col("caller_count")) * weight)
    rows = rows.withColumn("priority", F.bround(F.col("complexity_score") + 0.5 * F.col("size_score") + F.col("untested_penalty") + 0.5 * F.col("caller_score"), 1))
    rows = rows.where(F.col("priority") >= min_priority).select("symbol_id", "qualified_name", "kind", "rel_path", "lineno", "complexity", "line_count", "caller_count", "is_untested", "complexity_score", "size_score", "untested_penalty", "caller_score", "priority", reasons().alias("reasons"))
    rows = rows.orderBy(F.desc("priority"), "symbol_id")
    return rows if limit is None else rows.limit(limit)


def refactor_stats(c: Catalog, include_classes: bool = False) -> DataFrame:
    """One row: rows before any filter, and those skipped as tests or as trivial."""
    n = lambda x: F.count_if(F.col("skipped") == x)
    return _pool(c, include_classes).agg(F.count(F.lit(1)).alias("total_evaluated"), n("test").alias("skipped_test"), n("trivial").alias("skipped_trivial"))


def note(c: Catalog) -> str:
    return "no tests were found, so everything counts as untested" if test_entry_points(c).isEmpty() else ""
