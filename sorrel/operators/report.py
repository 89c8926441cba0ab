"""The health report: a snapshot of all rankings, and its Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sorrel.operators import drift, graph, metrics, text
from sorrel.plans.catalog import Catalog


def unused_by_file(c: Catalog, limit: int | None = 15, unused: DataFrame | None = None) -> DataFrame:
    unused = text.unused_imports(c) if unused is None else unused
    rows = unused.groupBy("rel_path").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "rel_path")
    return rows if limit is None else rows.limit(limit)


def _rows(df: DataFrame, **names: str) -> list[dict]:
    """Rows of a ranking that is already cut to its top, columns renamed."""
    return [{k: v for k, v in r.asDict().items()} for r in df.select(*(F.col(c).alias(n) for n, c in names.items())).collect()]


def snapshot(c: Catalog, complexity_threshold: int = 10, long_threshold: int = 50, top_n: int = 15, fan_out_threshold: int = 8, coverage_min_complexity: int = 5) -> dict:
    """All figures as one nested dict; lists hold at most top_n entries, cycles aside."""
    c = c.cached()
    reached = graph.test_reachability(c).cache()
    same = dict(rel_path="rel_path", lineno="lineno")
    cx = _rows(metrics.complexity_hotspots(c, complexity_threshold, top_n), qname="qualified_name", **same, complexity="complexity", line_count="line_count")
    long = _rows(metrics.long_functions(c, long_threshold, top_n), qname="qualified_name", **same, line_count="line_count", complexity="complexity")
    god = _rows(metrics.god_files(c, top_n), path="rel_path", score="score", symbols="symbol_count", loc="loc", fan_in="fan_in")
    hubs = _rows(metrics.fan_out(c, fan_out_threshold, top_n), path="rel_path", fan_out="fan_out", imports_total="imports_total", imports_resolved="imports_resolved", risk="risk")
    dead = text.dead_code(c).cache()
    gaps = _rows(graph.coverage_gaps(c, top_n, coverage_min_complexity, reached), qname="qualified_name", **same, kind="kind", complexity="complexity", line_count="line_count", caller_count="caller_count")
    coverage = graph.coverage_summary(c, reached).first().asDict()
    coverage.pop("public_reached")
    if not coverage["test_entry_points"]:
        gaps = []
    unused = (text.unused_imports(c) if c.source is not None else c.import_edge.limit(0).withColumn("rel_path", F.lit(""))).cache()
    cycles = [{"size": r["size"], "files": r["files"]} for r in graph.circular_deps(c).collect()]
    x, n = metrics.complexity_stats(c).first().asDict(), metrics.long_functions_stats(c, long_threshold).first().asDict()
    n_dead, n_unused = dead.count(), unused.count()
    return {
        "headline": metrics.headline_stats(c).first().asDict(),
        "complexity": x | {"hotspot_count": len(cx), "hotspots": cx},
        "long_functions": n | {"functions": long},
        "god_files": god,
        "fan_out": {"count": len(hubs), "threshold": fan_out_threshold, "files": hubs},
        "dead_code": {"count": n_dead, "symbols": _rows(dead.limit(top_n), qname="qualified_name", **same, kind="kind")},
        "coverage": coverage | {"min_complexity": coverage_min_complexity, "gap_count": len(gaps), "gaps": gaps},
        "unused_imports": {"count": n_unused, "top_files": _rows(unused_by_file(c, top_n, unused), path="rel_path", count="count")},
        "cycles": {"count": len(cycles), "groups": cycles},
        "dead_code_count": n_dead,
        "unused_import_count": n_unused,
        "cycle_count": len(cycles),
    }


def health_summary(c: Catalog, complexity_threshold: int = 10, long_threshold: int = 50) -> DataFrame:
    """The snapshot's scalars as one row."""
    rename = lambda df, **names: df.select(*(F.col(a).alias(b) for b, a in names.items()))
    x = rename(metrics.complexity_stats(c), callables="total", avg_complexity="average", high="high", extreme="extreme")
    n = rename(metrics.long_functions_stats(c, long_threshold), avg_lines="average_lines", over_threshold="over_threshold")
    return metrics.headline_stats(c).crossJoin(x).crossJoin(n).crossJoin(graph.coverage_summary(c).select("test_entry_points", "reached_count", "coverage_pct"))


def _table(title: str, rows: list[dict], columns: list[str]) -> list[str]:
    out = [f"## {title}", ""]
    if not rows:
        return out + ["_None._", ""]
    out += ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return out + ["| " + " | ".join(str(r[x]) for x in columns) + " |" for r in rows] + [""]


def markdown(s: dict, changes: dict | None = None) -> str:
    """A snapshot as Markdown, with a last section on drift where a baseline was given."""
    h, x, n, v = s["headline"], s["complexity"], s["long_functions"], s["coverage"]
    out = ["# Health report", "", "## 1. Overview", ""]
    out += [f"- {h['files']} files, {h['files_with_parse_errors']} of them with parse errors", f"- {h['symbols']} symbols: {h['functions']} functions, {h['classes']} classes, {h['methods']} methods", f"- {h['imports']} imports, {h['imports_resolution_pct']} % resolved", f"- {h['calls']} calls, {h['calls_resolution_pct']} % resolved", ""]
    out += _table(f"2. Complexity (mean {x['average']}, {x['high']} high, {x['extreme']} extreme of {x['total']})", x["hotspots"], ["qname", "complexity", "line_count", "rel_path", "lineno"])
    out += _table(f"3. Long functions ({n['over_threshold']} of {n['total']}, mean {n['average_lines']} lines)", n["functions"], ["qname", "line_count", "complexity", "rel_path", "lineno"])
    out += _table("4. God files", s["god_files"], ["path", "score", "symbols", "loc", "fan_in"])
    out += _table(f"5. Client hubs (at least {s['fan_out']['threshold']} imports)", s["fan_out"]["files"], ["path", "fan_out", "imports_total", "imports_resolved", "risk"])
    out += _table(f"6. Dead code ({s['dead_code']['count']} candidates)", s["dead_code"]["symbols"], ["qname", "kind", "rel_path", "lineno"])
    if v["test_entry_points"]:
        out += _table(f"7. Test reach ({v['coverage_pct']} % of {v['total_public_symbols']} public symbols)", v["gaps"], ["qname", "kind", "complexity", "line_count", "caller_count", "rel_path", "lineno"])
    else:
        out += ["## 7. Test reach", "", "_No tests were found._", ""]
    out += _table(f"8. Unused imports ({s['unused_imports']['count']})", s["unused_imports"]["top_files"], ["path", "count"])
    out += [f"## 9. Import cycles ({s['cycles']['count']})", ""] + ([f"- {g['size']} files: " + " → ".join(g["files"]) for g in s["cycles"]["groups"]] or ["_None._"]) + [""]
    if changes is not None:
        out += ["## 10. Drift", "", drift.markdown(changes)]
    return "\n".join(out)


def health_report(c: Catalog, baseline: dict | None = None, **thresholds) -> dict:
    """summary, drift and markdown."""
    summary = snapshot(c, **thresholds)
    changes = drift.compute(c.file.sparkSession, baseline, summary) if baseline is not None else None
    if changes is not None:
        summary = summary | {"drift": changes}
    return {"summary": summary, "drift": changes, "markdown": markdown(summary, changes)}


def to_json(value) -> str:
    return json.dumps(value, indent=2, default=lambda x: x.asDict() if isinstance(x, Row) else str(x), ensure_ascii=False)
