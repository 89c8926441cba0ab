"""Command line: index a folder, then ask about it."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel import __version__
from sorrel.operators import drift, graph, lexical, metrics, neighbours, priority, report, skeleton, text
from sorrel.plans import catalog
from sorrel.plans.catalog import Catalog, Store
from sorrel.shipping import ship
from sorrel.sources import scan

DATA = ".sorrel"
#: Threads of a session started here; 0: as Spark is configured.
_threads = 0


def _session() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        builder = SparkSession.builder.appName("sorrel").config("spark.ui.showConsoleProgress", "false")
        spark = (builder.master(f"local[{_threads}]") if _threads else builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def _store(a: argparse.Namespace) -> Store:
    return Store(_session(), os.path.join(os.path.abspath(a.repo), DATA))


def _open(a: argparse.Namespace) -> Catalog:
    store = _store(a)
    if not store.meta():
        raise FileNotFoundError(f"{a.repo} has no index: run `index` first")
    return store.open()


def _show(a: argparse.Namespace, value) -> None:
    """JSON, or a line for each entry, names of fields dimmed where the output has colours."""
    if a.json:
        print(report.to_json(value))
        return
    colour = sys.stdout.isatty() and "NO_COLOR" not in os.environ if a.color is None else a.color
    name = "\033[2m{}=\033[0m" if colour else "{}="
    for row in value if isinstance(value, list) else [value]:
        print("  ".join(name.format(k) + str(v) for k, v in row.items()) if isinstance(row, dict) else row)


def _listed(df: DataFrame, limit: int | None = None) -> list[dict]:
    return [r.asDict(recursive=True) for r in (df if limit is None else df.limit(limit)).collect()]


def index(a: argparse.Namespace) -> int:
    """--no-parallel and --workers set the threads of a session that starts here."""
    global _threads
    _threads = 1 if a.no_parallel else a.workers or _threads
    _show(a, vars(catalog.index_folder(_session(), a.repo, os.path.join(os.path.abspath(a.repo), DATA), a.full)))
    return 0


def query(a: argparse.Namespace) -> int:
    _show(a, _listed(lexical.search(_open(a), a.question, a.limit, a.match_all)))
    return 0


def context(a: argparse.Namespace) -> int:
    card = neighbours.context(_open(a), a.target)
    _show(a, card)
    return int(card["kind"] == "not_found")


def impact(a: argparse.Namespace) -> int:
    card = neighbours.impact(_open(a), a.target)
    _show(a, card)
    return int(card["kind"] == "not_found")


def find_path(a: argparse.Namespace) -> int:
    c = _open(a)
    ends = [lexical.resolve_target(c, t) for t in (a.source, a.target)]
    missing = [t for t, e in zip((a.source, a.target), ends) if e is None or e["kind"] != "symbol"]
    if missing:
        _show(a, {"found": False, "notes": [f"no symbol is called {t}" for t in missing]})
        return 1
    steps, summary = graph.find_path(c, ends[0]["id"], ends[1]["id"], a.max_depth)
    names = steps.join(c.symbol.select("symbol_id", "qualified_name"), "symbol_id").orderBy("depth").select("depth", "qualified_name", "lineno")
    _show(a, summary | {"steps": _listed(names)})
    return int(not summary["found"])


def detect_changes(a: argparse.Namespace) -> int:
    store = _store(a)
    here = scan.read(store.spark, a.repo).select("rel_path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    file = store.open().file
    row = catalog.change_report(file, here).first()
    changed = catalog.changes(file, here).where("status <> 'unchanged'").orderBy("status", "rel_path")
    _show(a, row.asDict() | {"reason": catalog.reason(row), "files": [tuple(r) for r in changed.select("status", "rel_path").collect()]})
    return 0


def summary(a: argparse.Namespace) -> int:
    c = _open(a)
    _show(a, _listed(metrics.repo_summary(c))[0] | {"most_imported": _listed(metrics.most_imported(c)), "largest_files": _listed(metrics.largest_files(c)), "entrypoints": _listed(metrics.entrypoints(c))})
    return 0


def find_dead_code(a: argparse.Namespace) -> int:
    c = _open(a)
    _show(a, {"stats": _listed(text.dead_code_stats(c))[0], "dead": _listed(text.dead_code(c), a.limit)})
    return 0


def find_coverage_gaps(a: argparse.Namespace) -> int:
    c = _open(a)
    reached = graph.test_reachability(c).cache()
    head = _listed(graph.coverage_summary(c, reached))[0]
    none = not head["test_entry_points"]
    _show(a, head | ({"note": "no tests were found", "gaps": []} if none else {"gaps": _listed(graph.coverage_gaps(c, a.limit, a.min_complexity, reached))}))
    return int(none)


def generate_test_skeleton(a: argparse.Namespace) -> int:
    made = skeleton.generate(_open(a), a.target)
    if made is None:
        print(f"no function, method or class is called {a.target}", file=sys.stderr)
        return 1
    if a.out:
        try:
            skeleton.write(made, a.out, a.force)
        except FileExistsError:
            print(f"{a.out} is there already; --force overwrites it", file=sys.stderr)
            return 1
    _show(a, vars(made) if a.json or a.out else made.body)
    return 0


def find_unused_imports(a: argparse.Namespace) -> int:
    _show(a, _listed(text.unused_imports(_open(a)), a.limit))
    return 0


def find_circular_deps(a: argparse.Namespace) -> int:
    _show(a, _listed(graph.circular_deps(_open(a)), a.limit))
    return 0


def find_complexity(a: argparse.Namespace) -> int:
    c = _open(a)
    _show(a, _listed(metrics.complexity_stats(c))[0] | {"hotspots": _listed(metrics.complexity_hotspots(c, a.threshold, a.limit))})
    return 0


def find_long_functions(a: argparse.Namespace) -> int:
    c = _open(a)
    _show(a, _listed(metrics.long_functions_stats(c, a.threshold))[0] | {"functions": _listed(metrics.long_functions(c, a.threshold, a.limit))})
    return 0


def find_god_files(a: argparse.Namespace) -> int:
    _show(a, _listed(metrics.god_files(_open(a), a.limit)))
    return 0


def find_high_fan_out(a: argparse.Namespace) -> int:
    _show(a, _listed(metrics.fan_out(_open(a), a.threshold, a.limit)))
    return 0


def find_todo_comments(a: argparse.Namespace) -> int:
    _show(a, _listed(text.todo_comments(_open(a), a.limit, a.min_risk, a.include_tests)))
    return 0


def refactor_priority(a: argparse.Namespace) -> int:
    c = _open(a)
    _show(a, _listed(priority.refactor_stats(c, a.include_classes))[0] | {"note": priority.note(c), "candidates": _listed(priority.refactor_priority(c, a.min_priority, a.limit, a.include_classes))})
    return 0


def health_report(a: argparse.Namespace) -> int:
    try:
        baseline = drift.load_baseline(a.baseline) if a.baseline else None
    except (OSError, ValueError) as e:
        print(f"baseline: {e}", file=sys.stderr)
        return 2
    made = report.health_report(_open(a), baseline, complexity_threshold=a.complexity_threshold, long_threshold=a.long_threshold, top_n=a.top_n, fan_out_threshold=a.fan_out_threshold, coverage_min_complexity=a.coverage_min_complexity)
    if a.save_baseline:
        with open(a.save_baseline, "w", encoding="utf-8") as f:
            f.write(report.to_json({"repo_path": os.path.abspath(a.repo), "summary": made["summary"]}))
    body = report.to_json(made["summary"]) if a.json else made["markdown"]
    if a.out:
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(body)
    else:
        print(body)
    return 0


#: Arguments of each command: positional ones, and options with their defaults (False: a flag).
COMMANDS = {
    index: ([], {"full": False, "parallel": False, "no_parallel": False, "workers": 0}),
    query: (["question"], {"limit": 20, "match_all": False}),
    context: (["target"], {}),
    impact: (["target"], {}),
    find_path: (["source", "target"], {"max_depth": 8}),
    detect_changes: ([], {}),
    summary: ([], {}),
    find_dead_code: ([], {"limit": 50}),
    find_coverage_gaps: ([], {"limit": 50, "min_complexity": 1}),
    generate_test_skeleton: (["target"], {"out": "", "force": False}),
    find_unused_imports: ([], {"limit": 50}),
    find_circular_deps: ([], {"limit": 20}),
    find_complexity: ([], {"threshold": 10, "limit": 30}),
    find_long_functions: ([], {"threshold": 50, "limit": 30}),
    find_god_files: ([], {"limit": 20}),
    find_high_fan_out: ([], {"threshold": 5, "limit": 20}),
    find_todo_comments: ([], {"limit": 50, "min_risk": 0.0, "include_tests": False}),
    refactor_priority: ([], {"min_priority": 50.0, "limit": 30, "include_classes": False}),
    health_report: ([], {"complexity_threshold": 10, "long_threshold": 50, "top_n": 15, "fan_out_threshold": 8, "coverage_min_complexity": 5, "out": "", "baseline": "", "save_baseline": ""}),
}
OTHER_NAMES = {"find_todo_comments": ["ptc"]}
OTHER_FLAGS = {"match_all": ["--and"]}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sorrel")
    top.add_argument("--version", action="version", version=__version__)
    top.add_argument("--color", action=argparse.BooleanOptionalAction, default=None)
    commands = top.add_subparsers(dest="command", required=True)
    for run, (places, options) in COMMANDS.items():
        sub = commands.add_parser(run.__name__, aliases=OTHER_NAMES.get(run.__name__, []))
        sub.set_defaults(run=run)
        sub.add_argument("repo")
        sub.add_argument("--json", action="store_true")
        for name in places:
            sub.add_argument(name)
        for name, default in options.items():
            flags = [f"--{name.replace('_', '-')}", *OTHER_FLAGS.get(name, [])]
            if default is False:
                sub.add_argument(*flags, action="store_true", dest=name)
            else:
                sub.add_argument(*flags, type=type(default), default=default, dest=name)
    return top


def _log(a: argparse.Namespace, code: int) -> None:
    """A line of the operations log, where the repository has an index: time, command, and what it was asked and gave."""
    folder = os.path.join(os.path.abspath(a.repo), DATA)
    if os.path.isdir(folder):
        given = " ".join(f"{k}={v}" for k, v in vars(a).items() if k not in ("run", "command", "repo") and v not in (None, False, ""))
        with open(os.path.join(folder, "operations.log"), "a", encoding="utf-8") as f:
            f.write("\t".join([datetime.now(timezone.utc).isoformat(timespec="seconds"), a.command, f"{given} exit={code}".replace("\t", " ").replace("\n", " ").strip()]) + "\n")


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        code = a.run(a)
        _log(a, code)
        return code
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
