"""Every operator as a query over the star-schema tables: (spark, folder of a scale factor) to a DataFrame.

Relational and graph operators run on the catalog made of suppliers, parts and order lines; those that need source
text run on modules written from the same tables and parsed again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.functions import columns
from sorrel.operators import drift, graph, lexical, metrics, neighbours, priority, report, skeleton, text
from sorrel.plans import catalog, resolve
from sorrel.plans.catalog import Catalog
from sorrel.sources import adapters, parser, scan

QUESTION = "where is the red ring of economy"
#: Lines of an ignore file, by folder.
IGNORED = [("", "# generated"), ("", "tests/"), ("", "*m1?.py"), ("", "/pkg/cli/"), ("", "!m12.py"), ("pkg", "n[1-3]/*"), ("pkg/n2", "!m*2.py")]
Query = Callable[[SparkSession, str], DataFrame]


def _on_tables(f: Callable[[Catalog], DataFrame], **options) -> Query:
    return lambda spark, sf_dir: f(adapters.tables(spark, sf_dir), **options)


def corpus(spark: SparkSession, sf_dir: str) -> Catalog:
    return catalog.from_source(adapters.sources(spark, sf_dir))


def _on_corpus(f: Callable[[Catalog], DataFrame], **options) -> Query:
    return lambda spark, sf_dir: f(corpus(spark, sf_dir), **options)


def parse_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols that the parser finds."""
    parsed = parser.parse(adapters.sources(spark, sf_dir))
    return parsed.select("rel_path", F.explode("symbols").alias("s")).select("rel_path", "s.qualified_name", "s.kind", "s.lineno", "s.end_lineno", "s.complexity", "s.line_count", "s.signature", "s.docstring")


def parsed_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parser.parse(adapters.sources(spark, sf_dir))
    return parsed.select("rel_path", F.explode("imports").alias("i")).select("rel_path", "i.imported_module", "i.lineno")


def index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of totals of a full index."""
    parsed = parser.parse(adapters.sources(spark, sf_dir))
    total = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long")
    return parsed.agg(F.count(F.lit(1)).alias("files"), F.count("parse_error").alias("files_with_errors"), total("symbols").alias("symbols"), total("imports").alias("imports"), total("calls").alias("calls"))


def _named_imports(c: Catalog) -> DataFrame:
    """Imports by path and line, with the path that they resolve to."""
    target = c.file.select(F.col("file_id").alias("resolved_file_id"), F.col("rel_path").alias("resolved"))
    return c.import_edge.join(c.file.select("file_id", "rel_path"), "file_id").join(target, "resolved_file_id", "left").select("rel_path", "imported_module", "lineno", "resolved")


def _named_calls(c: Catalog) -> DataFrame:
    s = c.symbol.select("symbol_id", "qualified_name")
    by = s.select(F.col("symbol_id").alias("caller_symbol_id"), F.col("qualified_name").alias("caller"))
    to = s.select(F.col("symbol_id").alias("resolved_symbol_id"), F.col("qualified_name").alias("resolved"))
    return c.call_edge.join(by, "caller_symbol_id").join(to, "resolved_symbol_id", "left").select("caller", "callee_name", "resolved")


def resolve_imports_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.tables(spark, sf_dir)
    return resolve.imports_exact(c.file, c.import_edge)


def resolve_imports_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports as if without their first package, so that only suffixes match."""
    c = adapters.tables(spark, sf_dir)
    return resolve.imports_suffix(c.file, c.import_edge.withColumn("imported_module", F.regexp_replace("imported_module", r"^[^.]*\.", "")))


def detect_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's files against a later state in which some are gone, others changed and others new."""
    file = adapters.file_table(spark, sf_dir)
    k = F.col("file_id")
    later = file.where(k % 11 != 0).select("rel_path", F.when(k % 7 != 0, F.col("sha256")).otherwise(F.lit("changed")).alias("sha256"))
    new = file.where(k % 9 == 0).select(F.concat(F.lit("new/"), "rel_path").alias("rel_path"), "sha256")
    return catalog.changes(file, later.unionByName(new))


def change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = adapters.file_table(spark, sf_dir)
    return catalog.change_report(file, file.where(F.col("file_id") % 11 != 0).select("rel_path", "sha256"))


def _odd_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the catalog's files, some moved into folders that a walk skips, or to __init__.py."""
    k = F.col("file_id")
    name = F.substring_index("rel_path", "/", -1)
    path = F.when(k % 6 == 0, F.concat(F.lit(".venv/"), name)).when(k % 6 == 1, F.concat(F.lit("pkg/build/"), name)).when(k % 6 == 2, F.concat(F.lit("pkg/.hidden/"), name)).when(k % 6 == 3, F.concat(F.lit("Lib/Tests/"), name)).when(k % 6 == 4, F.concat(F.lit("lib/p"), k, F.lit("/__init__.py"))).otherwise(F.regexp_replace("rel_path", "py$", "pyi"))
    return adapters.file_table(spark, sf_dir).select(F.explode(F.array("rel_path", path)).alias("rel_path"))


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _odd_paths(spark, sf_dir).where(scan.visible(F.col("rel_path")))


def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.kept(adapters.file_table(spark, sf_dir).select("rel_path"), scan.compile_rules(spark, IGNORED))


def module_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _odd_paths(spark, sf_dir).select("rel_path", parser.module_path_of("rel_path").alias("module_path"))


def test_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("rel_path")
    return _odd_paths(spark, sf_dir).select("rel_path", columns.test_path_coverage(p).alias("coverage"), columns.test_path_priority(p).alias("priority"), columns.test_path_comments(p).alias("comments"))


def _variants(spark: SparkSession, sf_dir: str, *forms: str) -> DataFrame:
    """k and text of every part: one of the forms, % standing for the part's name and key."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k, named = F.col("p_partkey"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey"))
    form = F.element_at(F.array(*map(F.lit, forms)), (k % len(forms) + 1).cast("int"))
    return part.select(k.alias("k"), F.replace(form, F.lit("%"), named).alias("text"))


NOQA_FORMS = ("import %", "import %  # noqa", "import %  # noqa: F401", "import %  # NOQA:E501", "import %  #noqa: E501, F401 because", "import %  # noqa: whatever", "import %  # noqable")
TAG_FORMS = ("# TODO: %", "# see FIXME(%)", "# todo %", "# X.XXX %", "#HACK %", "# [BUG] % TODO", "# a_TODO %", "# -XXX %")
SIGNATURE_FORMS = ("()", "(self, %)", "(cls, a, /, %, *args, k, **kw)", "(%: dict[str, int] = {1: 2}, *, b=f(1, 2))", "(a: tuple[list[int], int], %)")


def noqa_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir, *NOQA_FORMS).select("k", columns.noqa_covers_import(F.col("text")).alias("suppressed"))


def todo_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir, *TAG_FORMS).select("k", columns.first_tag(F.col("text")).alias("tag"))


def signature_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir, *SIGNATURE_FORMS).select("k", F.array_join(columns.signature_params(F.col("text")), ",").alias("params"))


def pascal_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir, "%", "_%", "get_%__x", "XMLThing_%").select("k", columns.pascal_case(F.col("text")).alias("pascal"))


def resolve_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names, qualified names without their package, paths, parts of paths and unknown names as targets."""
    c = adapters.tables(spark, sf_dir)
    names = c.symbol.select(F.explode(F.array("name", "qualified_name", F.regexp_replace("qualified_name", r"^[^.]*\.", ""), F.concat("name", F.lit("?")))).alias("target"))
    paths = c.file.select(F.explode(F.array("rel_path", "module_path", F.concat(F.substring_index(F.col("module_path"), ".", -1), F.lit(".py")))).alias("target"))
    return lexical.resolve_targets(c, names.union(paths))


def enclosing_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost symbol around the line of every call."""
    c = adapters.tables(spark, sf_dir)
    at = c.call_edge.select("edge_id", F.col("caller_symbol_id").alias("symbol_id"), "lineno").join(c.symbol.select("symbol_id", "file_id"), "symbol_id").select("file_id", "lineno", "edge_id")
    return text.enclosing(c, at).select("edge_id", "symbol_id", "qualified_name")


def reached_depths(c: Catalog) -> DataFrame:
    return graph.test_reachability(c).select("symbol_id", F.col("depth").cast("int").alias("depth"))


def paths_between_some(c: Catalog) -> DataFrame:
    """Call paths from every symbol whose id is divisible by 50 to every such symbol."""
    return graph.find_paths_among(c, c.symbol.where(F.col("symbol_id") % 50 == 0).select("symbol_id"))


def parse_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of modules with classes."""
    parsed = parser.parse(adapters.classes(spark, sf_dir))
    return parsed.select("rel_path", F.explode("symbols").alias("s")).select("rel_path", "s.qualified_name", "s.kind", "s.parent_qname", "s.lineno", "s.end_lineno", "s.complexity", "s.line_count", "s.signature", "s.docstring", F.col("s.is_private").cast("int").alias("is_private"))


def class_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From-imports, aliases, bracketed and relative imports, with the paths that they resolve to."""
    c = catalog.from_source(adapters.classes(spark, sf_dir))
    target = c.file.select(F.col("file_id").alias("resolved_file_id"), F.col("rel_path").alias("resolved"))
    return c.import_edge.join(c.file.select("file_id", "rel_path"), "file_id").join(target, "resolved_file_id", "left").select("rel_path", "imported_module", "imported_name", "alias", "lineno", "resolved")


def class_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by every rule of resolution, and such as two rules or none fit; from_line is that of the calling symbol."""
    c = catalog.from_source(adapters.classes(spark, sf_dir))
    by = c.symbol.select(F.col("symbol_id").alias("caller_symbol_id"), F.col("qualified_name").alias("caller"), F.col("lineno").alias("from_line"))
    to = c.symbol.select(F.col("symbol_id").alias("resolved_symbol_id"), F.col("qualified_name").alias("resolved"), F.col("lineno").alias("to_line"))
    return c.call_edge.join(by, "caller_symbol_id").join(to, "resolved_symbol_id", "left").select("caller", "from_line", "callee_name", "lineno", "resolved", "to_line")


def unused_class_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of imports by name, one isn't used, and two are covered by a noqa within their brackets."""
    return text.unused_imports(catalog.from_source(adapters.classes(spark, sf_dir))).select("rel_path", "lineno", "imported_module", "binding")


def source_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and size of every module."""
    return parser.unparsed(adapters.classes(spark, sf_dir)).select("rel_path", "module_path", "sha256", F.col("size_bytes").cast("long").alias("size_bytes"))


#: Two snapshots for the drift queries: what has them differ is bounded, so they are written out.
BEFORE = {"headline": {"files": 10, "symbols": 50, "imports_resolution_pct": 70.0}, "complexity": {"average": 3.5, "high": 4, "extreme": 1, "hotspots": [{"qname": "a.f"}, {"qname": "a.g"}]}, "dead_code": {"count": 3, "symbols": [{"qname": "d.x"}]}, "coverage": {"coverage_pct": 40.0}, "cycles": {"count": 1, "groups": [{"files": ["b.py", "a.py"]}]}, "god_files": []}
AFTER = {"headline": {"files": 12, "symbols": 50, "imports_resolution_pct": 85.0}, "complexity": {"average": 3.25, "high": 7, "extreme": 3, "hotspots": [{"qname": "a.g"}, {"qname": "b.h"}]}, "dead_code": {"count": 3, "symbols": [{"qname": "d.x"}]}, "cycles": {"count": 1, "groups": [{"files": ["c.py", "a.py"]}]}, "god_files": []}


def drift_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift_scalars(drift.flat(spark, BEFORE)[0], drift.flat(spark, AFTER)[0])


def _entries(spark: SparkSession) -> DataFrame:
    (_, l1, i1), (_, l2, i2) = drift.flat(spark, BEFORE), drift.flat(spark, AFTER)
    return drift.drift_entries(i1, i2, l1.join(l2, "name"))


def drift_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = lambda c: F.array_join(c, ",").alias(c)
    return drift.drift_sets(_entries(spark)).select("name", j("regressions"), j("improvements"), "unchanged", "baseline_size", "current_size")


def drift_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift_counts(drift_scalars(spark, sf_dir), _entries(spark))


def queries() -> dict[str, Query]:
    on_tables = {
        "complexity_hotspots": metrics.complexity_hotspots,
        "complexity_stats": metrics.complexity_stats,
        "long_functions": metrics.long_functions,
        "long_functions_stats": metrics.long_functions_stats,
        "god_files": metrics.god_files,
        "headline_stats": metrics.headline_stats,
        "repo_summary": metrics.repo_summary,
        "most_imported": metrics.most_imported,
        "largest_files": metrics.largest_files,
        "entrypoints": metrics.entrypoints,
        "callers": neighbours.callers,
        "importers": neighbours.importers,
        "second_order_callers": neighbours.second_order_callers,
        "impact_all": neighbours.impact_all,
        "impact_file": neighbours.impact_files,
        "context_file": neighbours.file_cards,
        "context_symbol": neighbours.symbol_cards,
        "test_entry_points": graph.test_entry_points,
        "test_reachability": reached_depths,
        "coverage_gaps": graph.coverage_gaps,
        "coverage_summary": graph.coverage_summary,
        "find_path": paths_between_some,
        "circular_deps": graph.circular_deps,
        "import_graph_stats": graph.import_graph_stats,
        "recency_bonus": lambda c: lexical.recency_bonus(c.file),
        "refactor_stats": priority.refactor_stats,
        "skeleton_index": skeleton.skeleton_index,
        "health_summary": report.health_summary,
    }
    on_corpus = {
        "resolve_imports": _named_imports,
        "resolve_calls": _named_calls,
        "token_counts": lambda c: text.token_counts(c).join(c.file.select("file_id", "rel_path"), "file_id").select("rel_path", "token", "n"),
        "dead_code": lambda c: text.dead_code(c).drop("symbol_id"),
        "dead_code_stats": text.dead_code_stats,
        "unused_imports": lambda c: text.unused_imports(c).select("rel_path", "lineno", "imported_module", "binding"),
        "todo_comments": text.todo_comments,
        "todo_by_tag": text.todo_by_tag,
        "todo_by_bucket": text.todo_by_bucket,
        "todo_stats": text.todo_stats,
        "skeletons": lambda c: skeleton.skeletons(c).drop("symbol_id"),
    }
    plain = (parse_corpus, parsed_imports, index_report, resolve_imports_exact, resolve_imports_suffix, detect_changes, change_report, scan_files, ignore_filter, module_paths, test_paths, noqa_rules, todo_tags, signature_params, pascal_case, resolve_target, enclosing_symbol, parse_classes, class_imports, class_calls, unused_class_imports, source_hashes, drift_scalars, drift_sets, drift_counts)
    out = {name: _on_tables(f) for name, f in on_tables.items()} | {name: _on_corpus(f) for name, f in on_corpus.items()} | {f.__name__: f for f in plain}
    limited = {"fan_out": (metrics.fan_out, {"threshold": 1, "limit": None}), "refactor_priority": (priority.refactor_priority, {"min_priority": 30.0, "limit": None})}
    out |= {name: _on_tables(f, **options) for name, (f, options) in limited.items()}
    out["lexical_query"] = _on_tables(lexical.search, question=QUESTION, limit=None)
    out["lexical_query_and"] = _on_tables(lexical.search, question=QUESTION, limit=None, match_all=True)
    return out
