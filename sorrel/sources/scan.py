"""Folders of Python files as tables: noise directories and ignored paths left out."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOISE = (".git", ".hg", ".svn", ".venv", "venv", "env", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", "node_modules", "build", "dist", ".idea", ".vs", ".vscode", "site-packages")


def visible(rel_path: Column) -> Column:
    """Whether no directory of the path is a noise directory or hidden, and the file is a .py file."""
    folders = F.slice(F.split(rel_path, "/"), 1, F.greatest(F.size(F.split(rel_path, "/")) - 1, F.lit(0)))
    return rel_path.endswith(".py") & ~F.exists(folders, lambda d: d.isin(*NOISE) | d.startswith("."))


def glob_to_regex(pattern: str) -> str:
    """Regular expression (not anchored) of an ignore pattern's body: * ? ** and classes."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif pattern[i] == "*":
            out.append("[^/]*")
            i += 1
        elif pattern[i] == "?":
            out.append("[^/]")
            i += 1
        elif pattern[i] == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]")
            i = end + 1
        else:
            out.append(re.escape(pattern[i]))
            i += 1
    return "".join(out)


def compile_rule(line: str) -> dict | None:
    """regex, negate, dir_only and anchored of one line of an ignore file; None of blanks, comments and bad patterns."""
    text = line.rstrip()
    if not text or text.startswith("#"):
        return None
    negate = text.startswith("!")
    body = text[1:] if negate else text
    dir_only = body.endswith("/")
    body = body.rstrip("/") if dir_only else body
    anchored = body.startswith("/") or "/" in body.removeprefix("**/")
    if not body:
        return None
    regex = glob_to_regex(body.lstrip("/"))
    try:
        re.compile(regex)
    except re.error:
        return None
    return {"regex": regex, "negate": negate, "dir_only": dir_only, "anchored": anchored}


RULES = "anchor string, rule_no int, regex string, negate boolean, dir_only boolean, anchored boolean"


def compile_rules(spark: SparkSession, lines: list[tuple[str, str]]) -> DataFrame:
    """Rule table from (folder of the ignore file, line) in order; the folder is "" at the top."""
    found = [(anchor, n, compile_rule(line)) for n, (anchor, line) in enumerate(lines)]
    return spark.createDataFrame([(a, n, r["regex"], r["negate"], r["dir_only"], r["anchored"]) for a, n, r in found if r], RULES)


def verdicts(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """rel_path, is_dir and ignored (true, false, or null if no rule matches) of every path.

    The last matching rule wins, rules of inner folders after those of outer ones. Anchored rules also match by an
    ancestor of the path, others by any segment; directory rules need a directory or a path below one.
    """
    depth = F.when(F.col("anchor") == "", 0).otherwise(F.size(F.split("anchor", "/")))
    pairs = paths.crossJoin(F.broadcast(rules.withColumn("depth", depth))).where((F.col("anchor") == "") | F.col("rel_path").startswith(F.concat("anchor", F.lit("/"))))
    inner = F.when(F.col("anchor") == "", F.col("rel_path")).otherwise(F.substr("rel_path", F.length("anchor") + 2))
    parts = F.split(inner, "/")
    n = F.size(parts)
    last = lambda i: i == n
    usable = lambda i: ~last(i) | ~F.col("dir_only") | F.col("is_dir")
    prefix = F.exists(F.sequence(F.lit(1), n), lambda i: usable(i) & F.rlike(F.array_join(F.slice(parts, 1, i), "/"), F.concat(F.lit("^(?:"), F.col("regex"), F.lit(")$"))))
    segment = F.exists(F.sequence(F.lit(1), n), lambda i: usable(i) & F.rlike(F.get(parts, i - 1), F.concat(F.lit("^(?:"), F.col("regex"), F.lit(")$"))))
    hit = F.when(F.col("anchored"), prefix).otherwise(segment)
    best = pairs.where(hit).groupBy("rel_path", "is_dir").agg(F.max_by(~F.col("negate"), F.struct("depth", "rule_no")).alias("ignored"))
    return paths.join(best, ["rel_path", "is_dir"], "left")


def kept(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """rel_path of the files that a walk visits: neither they nor a directory above them is ignored."""
    parts = F.split("rel_path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("rel_path"), (i < F.size(parts)).alias("is_dir")))
    steps = paths.select(F.col("rel_path").alias("file"), F.explode(ups).alias("s")).select("file", "s.*")
    judged = verdicts(steps.select("rel_path", "is_dir").distinct(), rules).where("ignored")
    bad = steps.join(judged, ["rel_path", "is_dir"], "left_semi").select(F.col("file").alias("rel_path")).distinct()
    return paths.select("rel_path").join(bad, "rel_path", "left_anti")


def _walk(repo: str) -> tuple[list[tuple[str]], list[tuple[str, str]]]:
    """Paths of the Python files that a walk meets, and the lines of the ignore files with their folders."""
    paths, lines = [], []
    for folder, names, files in os.walk(repo):
        names[:] = sorted(n for n in names if n not in NOISE and not n.startswith("."))
        inner = os.path.relpath(folder, repo).replace(os.sep, "/")
        inner = "" if inner == "." else inner
        paths += [(f"{inner}/{f}".lstrip("/"),) for f in sorted(files) if f.endswith(".py")]
        if ".gitignore" in files:
            with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                lines += [(inner, line) for line in f.read().splitlines()]
    return paths, lines


FILES = "rel_path string, abs_path string, content string, mtime long"


def _read_files(repo: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rel in batch.rel_path:
                path = os.path.join(repo, rel)
                try:
                    with open(path, "rb") as f:
                        rows.append((rel, path, f.read().decode("utf-8", "replace").removeprefix("\ufeff"), int(os.stat(path).st_mtime)))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["rel_path", "abs_path", "content", "mtime"])

    return run


def read(spark: SparkSession, repo: str, respect_ignore: bool = True) -> DataFrame:
    """rel_path, abs_path, content and mtime of the Python files below a folder that all executors can reach.

    The driver lists paths only; executors read the files. (Spark's own file sources pass over names that begin with
    an underscore, such as __init__.py.) Files that can't be read are left out; bytes that aren't UTF-8 are replaced.
    """
    repo = os.path.abspath(repo)
    paths, lines = _walk(repo)
    files = spark.createDataFrame(paths, "rel_path string")
    if lines and respect_ignore:
        files = kept(files, compile_rules(spark, lines))
    return files.repartition(max(1, min(10_000, len(paths) // 50))).mapInPandas(_read_files(repo), FILES)
