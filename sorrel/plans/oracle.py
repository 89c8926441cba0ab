"""DuckDB SQL with the results of the queries, written apart from the operators.

CATALOG makes the four tables of the star schema; facts about the written modules come from arithmetic on the parts,
without any parsing.
"""

from __future__ import annotations

from sorrel.plans.queries import AFTER, BEFORE, IGNORED, NOQA_FORMS, SIGNATURE_FORMS, TAG_FORMS

CATALOG = r"""WITH RECURSIVE
cnt AS (SELECT count(*) AS n, min(s_suppkey) AS least FROM supplier),
file AS (SELECT *, replace(regexp_replace(rel_path, '\.py$', ''), '/', '.') AS module_path,
    CASE WHEN file_id % 17 = 0 THEN 0 ELSE 1700000000 + file_id * 7919 % 100000 END AS mtime
  FROM (SELECT s_suppkey AS file_id, s_acctbal, CASE WHEN s_suppkey % 5 = 0 THEN 'tests/test_m' || s_suppkey
    WHEN s_suppkey % 7 = 3 THEN 'pkg/cli/m' || s_suppkey ELSE 'pkg/n' || s_nationkey || '/m' || s_suppkey
    || CASE WHEN s_suppkey % 29 = 6 THEN '/main' WHEN s_suppkey % 31 = 8 THEN '/manage' ELSE '' END END || '.py' AS rel_path FROM supplier)),
raw AS (SELECT p_partkey AS k, p_partkey % n + least AS file_id, replace(p_name, ' ', '_') || '_' || p_partkey AS stem, p_type, p_size FROM part, cnt),
typed AS (SELECT raw.*, f.module_path, CASE WHEN k % 23 = 0 THEN 'constant' WHEN k % 4 < 2 THEN 'function' WHEN k % 4 = 2 THEN 'method' ELSE 'class' END AS kind,
    CASE WHEN k % 13 = 0 THEN '__' || stem || '__' WHEN k % 11 = 0 THEN '_' || stem WHEN raw.file_id % 5 = 0 THEN 'test_' || stem ELSE stem END AS name,
    CASE WHEN raw.file_id % 5 = 0 AND k % 3 = 0 THEN 'TestK' ELSE 'K' END || (k % 7) AS cls FROM raw JOIN file f USING (file_id)),
symbol AS (SELECT k AS symbol_id, file_id, name, module_path || CASE WHEN kind = 'method' THEN '.' || cls ELSE '' END || '.' || name AS qualified_name, kind,
    CASE WHEN kind = 'method' THEN module_path || '.' || cls END AS parent_qname, CASE WHEN kind = 'method' THEN cls END AS cls, (k * 37 % 900 + 1)::INT AS lineno,
    CASE WHEN k % 6 <> 0 THEN p_type END AS docstring, (name[1] = '_')::INT AS is_private,
    CASE WHEN kind IN ('class', 'constant') THEN 0 ELSE p_size END::INT AS complexity, (p_size * 7 % 120 + 1)::INT AS line_count,
    CASE WHEN kind NOT IN ('class', 'constant') THEN 'a' || (k % 3) || ',b' ELSE '' END AS params FROM typed),
line AS (SELECT *, row_number() OVER w AS place, lead(l_partkey) OVER w AS next_part, lead(l_suppkey) OVER w AS next_supp
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
one AS (SELECT *, l_orderkey * 1000 + place AS edge_id FROM line),
call_edge AS (SELECT edge_id, l_partkey AS caller_symbol_id, coalesce(CASE WHEN s.kind = 'method' THEN s.cls || '.' || s.name ELSE s.name END, 'ext.f' || (l_partkey % 50)) AS callee_name,
    next_part AS resolved_symbol_id, (l_partkey * 11 % 900 + 1)::INT AS lineno FROM one LEFT JOIN symbol s ON s.symbol_id = next_part),
import_edge AS (SELECT edge_id, l_suppkey AS file_id, coalesce(f.module_path, 'lib' || (l_partkey % 9)) AS imported_module, next_supp AS resolved_file_id
  FROM one LEFT JOIN file f ON f.file_id = next_supp),
pairs AS (SELECT DISTINCT caller_symbol_id AS src, resolved_symbol_id AS dst FROM call_edge WHERE resolved_symbol_id IS NOT NULL),
imports AS (SELECT DISTINCT file_id AS src, resolved_file_id AS dst FROM import_edge WHERE resolved_file_id IS NOT NULL),
called AS (SELECT e.resolved_symbol_id AS symbol_id, e.caller_symbol_id, s.qualified_name AS caller, f.rel_path, e.lineno, e.edge_id
  FROM call_edge e JOIN symbol s ON s.symbol_id = e.caller_symbol_id JOIN file f USING (file_id) WHERE e.resolved_symbol_id IS NOT NULL),
second AS (SELECT DISTINCT a.symbol_id, b.caller FROM called a JOIN called b ON b.symbol_id = a.caller_symbol_id WHERE b.caller <> a.caller),
entries AS (SELECT s.symbol_id, s.qualified_name, f.rel_path FROM symbol s JOIN file f USING (file_id) WHERE f.rel_path LIKE 'tests/%'
  AND ((s.kind IN ('function', 'method') AND s.name LIKE 'test\_%' ESCAPE '\') OR (s.kind = 'method' AND s.cls LIKE 'Test%'))),
walked AS (SELECT symbol_id AS node, 0 AS depth FROM entries UNION SELECT p.dst, w.depth + 1 FROM walked w JOIN pairs p ON p.src = w.node WHERE w.depth < 60),
reached AS (SELECT node AS symbol_id, min(depth) AS depth FROM walked GROUP BY node),
pool AS (SELECT s.*, f.rel_path FROM symbol s JOIN file f USING (file_id) WHERE s.kind IN ('function', 'method', 'class') AND s.is_private = 0 AND f.rel_path NOT LIKE 'tests/%'),
plain AS (SELECT s.*, f.rel_path FROM symbol s JOIN file f USING (file_id) WHERE s.kind IN ('function', 'method') AND s.name[1:2] <> '__')
"""

MODULES = r"""WITH
cnt AS (SELECT count(*) AS n, min(s_suppkey) AS least FROM supplier),
fn AS (SELECT p_partkey AS k, p_partkey % n + least AS s, p_size % 12 AS b, n, least FROM part, cnt),
laid AS (SELECT *, (3 + 2 * b + (k % 4 <> 0)::INT)::BIGINT AS len, 7 + (s % 3 = 0)::INT + (s % 4 = 0)::INT AS head,
    'm' || s AS module, 'm' || s || '.py' AS rel_path FROM fn),
def AS (SELECT *, (head + coalesce(sum(len + 2) OVER (PARTITION BY s ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS top FROM laid),
mod AS (SELECT s, any_value(n) AS n, any_value(least) AS least, any_value(rel_path) AS rel_path, any_value(module) AS module, any_value(head) AS head,
    bool_or(k % 4 = 2) AS uses_os, bool_or(k % 4 = 3) AS uses_next, 'm' || (any_value(least) + (s - any_value(least) + 1) % any_value(n)) AS next FROM def GROUP BY s),
imp AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY i)::INT AS lineno FROM (
  SELECT s, 1 AS i, 'os' AS name FROM mod UNION ALL SELECT s, 2, 'json' FROM mod WHERE s % 3 = 0
  UNION ALL SELECT s, 3, 're' FROM mod WHERE s % 4 = 0 UNION ALL SELECT s, 4, next FROM mod)),
called AS (SELECT k AS by, s, CASE k % 4 WHEN 1 THEN 'f' || (k + n) WHEN 2 THEN 'os.getcwd' ELSE 'm' || (least + (k + 1) % n) || '.f' || (k + 1) END AS callee,
    CASE k % 4 WHEN 1 THEN k + n WHEN 3 THEN k + 1 END AS target FROM def WHERE k % 4 <> 0),
note AS (SELECT *, CASE WHEN k % 9 = 0 THEN 'todo' ELSE 'hack' END AS tag, CASE WHEN k % 9 = 0 THEN 'TODO: part ' ELSE 'HACK part ' END || k AS text,
    CASE WHEN k % 9 = 0 THEN 2 ELSE 4 END + 1 + b + 0.1::DOUBLE * len AS risk FROM def WHERE k % 9 = 0 OR k % 14 = 0),
body AS (SELECT *, 'def f' || k || '(x, y=0):' || CASE WHEN k % 9 = 0 THEN '  # TODO: part ' || k WHEN k % 14 = 0 THEN '  # HACK part ' || k ELSE '' END || chr(10) || '    docstring = part ' || k || chr(10)
    || repeat('    if x > 0: x ', b::INT) || CASE k % 4 WHEN 1 THEN 'f' || (k + n) || '(x)' WHEN 2 THEN 'os.getcwd()' WHEN 3 THEN 'm' || (least + (k + 1) % n) || '.f' || (k + 1) || '(x)' ELSE '' END || ' return x' AS words FROM def)
"""


def _values(rows: list[tuple]) -> str:
    sql = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(sql, r)) + ")" for r in rows)


def _variants(forms: tuple[str, ...], results: tuple) -> str:
    """k and the hand-written result of each part's form, % standing for its name."""
    return f"v(i, r) AS (VALUES {_values(list(enumerate(results)))}), named AS (SELECT p_partkey AS k, replace(r, '%', replace(p_name, ' ', '_') || '_' || p_partkey) AS r FROM part JOIN v ON i = p_partkey % {len(forms)})"


ODD = r"""odd AS (SELECT unnest([rel_path, CASE file_id % 6 WHEN 0 THEN '.venv/' || name WHEN 1 THEN 'pkg/build/' || name WHEN 2 THEN 'pkg/.hidden/' || name
  WHEN 3 THEN 'Lib/Tests/' || name WHEN 4 THEN 'lib/p' || file_id || '/__init__.py' ELSE rel_path || 'i' END]) AS rel_path FROM (SELECT *, string_split(rel_path, '/')[-1] AS name FROM file))"""
LEVEL = "CASE WHEN complexity <= 5 THEN 'low' WHEN complexity <= 10 THEN 'moderate' WHEN complexity <= 20 THEN 'high' ELSE 'extreme' END"
RISK = "CASE WHEN d >= 10 OR d + second_order >= 25 THEN 'high' WHEN d >= 3 OR d + second_order >= 8 THEN 'medium' ELSE 'low' END"


def _pct(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN round_even(100.0::DOUBLE * {a} / {b}, 1) ELSE 0.0::DOUBLE END"


KINDS = "count(*) AS symbols, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind = 'method') AS methods"
HEADLINE = f"""headline AS (SELECT *, {_pct('imports_resolved', 'imports')} AS imports_resolution_pct, {_pct('calls_resolved', 'calls')} AS calls_resolution_pct
FROM (SELECT count(*) AS files, count(*) FILTER (s_acctbal < -500) AS files_with_parse_errors FROM file), (SELECT {KINDS} FROM symbol),
  (SELECT count(*) AS imports, count(resolved_file_id) AS imports_resolved FROM import_edge), (SELECT count(*) AS calls, count(resolved_symbol_id) AS calls_resolved FROM call_edge))"""
COVERAGE = f"""SELECT *, {_pct('public_reached', 'total_public_symbols')} AS coverage_pct FROM (SELECT count(*) AS test_entry_points FROM entries),
  (SELECT count(*) AS reached_count FROM reached), (SELECT count(*) AS total_public_symbols, count(r.symbol_id) AS public_reached FROM pool LEFT JOIN reached r USING (symbol_id))"""


def _lexical(match_all: bool) -> str:
    words = ("red", "ring", "economy")
    name = lambda w: f"CASE WHEN lower(name) = '{w}' THEN 100 WHEN starts_with(lower(name), '{w}') THEN 75 WHEN contains(lower(name), '{w}') THEN 55 ELSE 0 END"
    qname = lambda w: f"CASE WHEN lower(qualified_name) = '{w}' THEN 90 WHEN ends_with(lower(qualified_name), '.{w}') THEN 65 WHEN contains(lower(qualified_name), '{w}') THEN 40 ELSE 0 END"
    doc = lambda w: f"CASE WHEN contains(lower(docstring), '{w}') THEN 20 ELSE 0 END"
    scores = ", ".join(f"{name(w)} + {qname(w)} + {doc(w)} AS s{i}" for i, w in enumerate(words))
    paths = ", ".join(f"CASE WHEN contains(lower(rel_path), '{w}') THEN 35 ELSE 0 END AS s{i}" for i, w in enumerate(words))
    total = "round_even((s0 + s1 + s2) * (0.5::DOUBLE + 0.5::DOUBLE * (((s0 > 0)::INT + (s1 > 0)::INT + (s2 > 0)::INT) / 3)), 0)::INT + bonus"
    good = "s0 > 0 AND s1 > 0 AND s2 > 0" if match_all else "s0 + s1 + s2 > 0"
    return f"""{CATALOG}, {BONUS},
hits AS (SELECT {total} AS score, kind, name, qualified_name, rel_path, lineno, docstring AS snippet FROM (SELECT *, {scores} FROM symbol) JOIN file f USING (file_id) JOIN bonus USING (file_id) WHERE {good})
SELECT * FROM hits UNION ALL SELECT {total}, 'file', module_path, module_path, rel_path, NULL, NULL FROM (SELECT *, {paths} FROM file) JOIN bonus USING (file_id) WHERE {good} AND rel_path NOT IN (SELECT rel_path FROM hits)"""


BONUS = "bonus AS (SELECT file_id, CASE WHEN mtime = 0 OR lo = hi THEN 0 ELSE round_even((mtime - lo) / greatest(1, hi - lo) * 8, 0) END::INT AS bonus FROM file, (SELECT min(mtime) AS lo, max(mtime) AS hi FROM file))"


def _refactor() -> str:
    # on the digits of the sum, as round_even() of doubles multiplies before it looks
    tenths = "(complexity_score + 0.5::DOUBLE * size_score + untested_penalty + 0.5::DOUBLE * caller_score)::VARCHAR::DECIMAL(30, 15) * 10"
    even = f"((floor({tenths}) + CASE WHEN {tenths} - floor({tenths}) > 0.5 OR ({tenths} - floor({tenths}) = 0.5 AND floor({tenths}) % 2 = 1) THEN 1 ELSE 0 END) / 10)::DOUBLE"
    return f"""{CATALOG},
calls AS (SELECT resolved_symbol_id AS symbol_id, count(*) AS n FROM call_edge WHERE resolved_symbol_id IS NOT NULL GROUP BY 1),
base AS (SELECT s.symbol_id, s.qualified_name, s.kind, f.rel_path, s.lineno, s.complexity, s.line_count, coalesce(c.n, 0) AS caller_count, r.symbol_id IS NULL AS is_untested,
    round_even(least(s.complexity / 50, 1) * 100, 1) AS complexity_score, round_even(least(s.line_count / 500, 1) * 100, 1) AS size_score
  FROM symbol s JOIN file f USING (file_id) LEFT JOIN calls c USING (symbol_id) LEFT JOIN reached r USING (symbol_id)
  WHERE s.kind IN ('function', 'method') AND f.rel_path NOT LIKE 'tests/%' AND s.is_private = 0 AND NOT (s.complexity < 3 AND s.line_count < 20)),
w AS (SELECT *, (complexity_score + size_score) / 200 AS w FROM base),
p AS (SELECT * EXCLUDE (w), CASE WHEN is_untested THEN w * 100 ELSE 0 END::DOUBLE AS untested_penalty, round_even(least(log2(caller_count + 1) * 25, 100), 1) * w AS caller_score FROM w),
q AS (SELECT *, {even} AS priority FROM p)
SELECT * EXCLUDE (r), CASE WHEN len(r) > 0 THEN r ELSE ['on the border: can wait'] END AS reasons FROM (SELECT *, list_filter([
  CASE WHEN complexity >= 20 THEN 'complexity ' || complexity || ': extreme' WHEN complexity >= 10 THEN 'complexity ' || complexity || ': high' END,
  CASE WHEN line_count >= 200 THEN line_count || ' lines: very long' WHEN line_count >= 80 THEN line_count || ' lines: long' END,
  CASE WHEN is_untested THEN 'no test reaches it' END,
  CASE WHEN caller_count >= 10 THEN caller_count || ' calls depend on it' WHEN caller_count >= 3 THEN caller_count || ' calls' WHEN caller_count = 0 THEN 'nothing calls it' END], lambda x: x IS NOT NULL) AS r FROM q) WHERE priority >= 30"""


def _paths(max_depth: int = 8) -> str:
    """Queues of all sources, level by level; every row has its path as text."""
    levels = ["l0 AS (SELECT symbol_id AS source, symbol_id AS node, NULL::BIGINT AS parent, 1::BIGINT AS place, symbol_id || '@' || lineno AS path FROM chosen)"]
    for d in range(1, max_depth + 1):
        seen = " UNION ALL ".join(f"SELECT source, node FROM l{i}" for i in range(d))
        step = f"SELECT l.source, e.resolved_symbol_id AS node, arg_min({{'parent': l.node, 'place': l.place, 'edge': e.edge_id, 'path': l.path, 'line': e.lineno}}, (l.place, e.edge_id)) AS b FROM l{d - 1} l JOIN call_edge e ON e.caller_symbol_id = l.node WHERE e.resolved_symbol_id IS NOT NULL GROUP BY ALL"
        levels.append(f"l{d} AS MATERIALIZED (SELECT source, node, b.parent AS parent, row_number() OVER (PARTITION BY source ORDER BY b.place, b.edge) AS place, b.path || '>' || node || '@' || b.line AS path FROM ({step}) WHERE (source, node) NOT IN ({seen}))")
    tree = " UNION ALL ".join(f"SELECT *, {d} AS depth FROM l{d}" for d in range(max_depth + 1))
    return f""", chosen AS (SELECT symbol_id, lineno FROM symbol WHERE symbol_id % 50 = 0), {", ".join(levels)},
tree AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY depth, place) AS taken, count(*) OVER (PARTITION BY source) AS nodes FROM ({tree}))
SELECT a.symbol_id AS source, b.symbol_id AS target, t.depth::INT AS depth, coalesce(p.taken, CASE WHEN t.depth = 0 THEN 1 END, n.nodes)::BIGINT AS nodes_explored, t.path
FROM chosen a CROSS JOIN chosen b JOIN (SELECT DISTINCT source, nodes FROM tree) n ON n.source = a.symbol_id
LEFT JOIN tree t ON t.source = a.symbol_id AND t.node = b.symbol_id LEFT JOIN tree p ON p.source = a.symbol_id AND p.node = t.parent"""


def _resolve_target() -> str:
    """Levels in turn; in these tables no symbol is a module, and dotted suffixes go up to two segments."""
    return rf"""{CATALOG},
t AS (SELECT DISTINCT target FROM (SELECT unnest([name, qualified_name, regexp_replace(qualified_name, '^[^.]*\.', ''), name || '?']) AS target FROM symbol
  UNION ALL SELECT unnest([rel_path, module_path, string_split(module_path, '.')[-1] || '.py']) FROM file)),
ends AS (SELECT symbol_id, length(qualified_name) AS n, array_to_string(string_split(qualified_name, '.')[i:], '.') AS target FROM (SELECT *, unnest(range(2, len(string_split(qualified_name, '.')) + 1)) AS i FROM symbol) WHERE len(string_split(qualified_name, '.')) > 2),
got AS (
  SELECT target, 'symbol' AS kind, symbol_id AS id, 1 AS level, is_private::VARCHAR AS k0, '' AS k1 FROM t JOIN symbol ON qualified_name = target
  UNION ALL SELECT target, 'symbol', symbol_id, 4, lpad(n::VARCHAR, 8, '0'), '' FROM t JOIN ends USING (target) WHERE contains(target, '.')
  UNION ALL SELECT target, 'symbol', symbol_id, 6, is_private::VARCHAR, kind FROM t JOIN symbol ON name = target
  UNION ALL SELECT target, 'file', file_id, 7, '', '' FROM t JOIN file ON rel_path = target OR module_path = target),
best AS (SELECT target, arg_min({{'kind': kind, 'id': id, 'level': level}}, (level, k0, k1, id)) AS b FROM got GROUP BY target),
rest AS (SELECT t.target, min(file_id) AS id FROM t JOIN file ON contains(rel_path, t.target) OR contains(module_path, t.target) WHERE t.target NOT IN (SELECT target FROM best) GROUP BY t.target)
SELECT target, b.kind AS kind, b.id AS id, b.level AS level FROM best UNION ALL SELECT target, 'file', id, 8 FROM rest"""


#: By hand from the text of adapters.CLASSES; {s} and {n} as there.
CLASS_SYMBOLS = [
    ("", "module", None, 1, None, 0, 0, None, "Module {s}.", 0),
    (".LIMIT", "constant", None, 17, 17, 0, 0, None, None, 0),
    ("._HIDDEN", "constant", None, 18, 18, 0, 0, None, None, 1),
    (".Widget{s}", "class", None, 21, 42, 0, 22, None, "Widget {s}.", 0),
    (".Widget{s}.__init__", "method", ".Widget{s}", 26, 27, 1, 2, "(self, owner)", None, 1),
    (".Widget{s}.draw", "method", ".Widget{s}", 29, 35, 5, 7, "(self, x, /, y, *, z)", "Draws {s}.", 0),
    (".Widget{s}.refresh", "method", ".Widget{s}", 37, 42, 5, 6, "(self)", None, 0),
    (".helper{s}", "function", None, 45, 46, 1, 2, "(x)", None, 0),
    (".shared{s}", "function", None, 49, 58, 1, 10, "(x, *rest, key, **more)", None, 0),
    (".spare{n}", "function", None, 61, 63, 2, 3, "(x)", None, 0),
    ("._private{s}", "function", None, 66, 67, 2, 2, "(x)", None, 1),
    (".spare{s}", "function", None, 70, 71, 1, 2, "(x)", None, 0),
    (".spare{s}", "function", None, 74, 75, 1, 2, "(x)", None, 0),
]
CLASS_IMPORTS = [
    ("__future__", "annotations", None, 2, None),
    *(("pkg.x{n}", name, alias, line, "pkg/x{n}.py") for name, alias, line in (("Widget{n}", None, 4), ("helper{n}", None, 4), ("shared{n}", "renamed", 5), ("spare{n}", None, 5), (None, "other", 9), ("LIMIT", "bound", 12), ("_HIDDEN", "hidden", 12))),
    ("x{n}", None, None, 10, "pkg/x{n}.py"),
    (".", "sibling", None, 11, None),
]
#: Caller and its line, callee, line, what it resolves to and the line of that.
CLASS_CALLS = [
    (".Widget{s}.draw", 29, "Widget{s}.refresh", 31, "pkg.x{s}.Widget{s}.refresh", 37),
    (".Widget{s}.draw", 29, "range", 32, None, None),
    (".Widget{s}.draw", 29, "_private{s}", 35, "pkg.x{s}._private{s}", 66),
    (".Widget{s}.refresh", 37, "Widget{s}.owner.pop", 40, None, None),
    (".helper{s}", 45, "Widget{s}.draw", 46, "pkg.x{s}.Widget{s}.draw", 29),
    (".shared{s}", 49, "Widget{n}", 50, "pkg.x{n}.Widget{n}", 21),
    (".shared{s}", 49, "Widget{n}.draw", 51, "pkg.x{n}.Widget{n}.draw", 29),
    (".shared{s}", 49, "helper{n}", 52, "pkg.x{n}.helper{n}", 45),
    (".shared{s}", 49, "renamed", 53, None, None),
    (".shared{s}", 49, "other.helper{n}", 54, "pkg.x{n}.helper{n}", 45),
    (".shared{s}", 49, "Widget{n}.refresh", 55, "pkg.x{n}.Widget{n}.refresh", 37),
    (".shared{s}", 49, "helper{s}", 56, "pkg.x{s}.helper{s}", 45),
    (".shared{s}", 49, "x{n}.spare{n}", 57, "pkg.x{n}.spare{n}", 70),
    (".shared{s}", 49, "x.y.z", 58, None, None),
    (".spare{n}", 61, "spare{n}", 62, "pkg.x{s}.spare{n}", 61),
    (".spare{s}", 74, "helper{s}", 75, "pkg.x{s}.helper{s}", 45),
]


def _classes() -> dict[str, str]:
    from sorrel.sources.adapters import CLASSES

    head = "WITH cnt AS (SELECT count(*) AS n, min(s_suppkey) AS least FROM supplier), m AS (SELECT s_suppkey AS s, least + (s_suppkey - least + 1) % n AS n FROM supplier, cnt)"
    put = lambda c: f"replace(replace({c}, '{{s}}', s::VARCHAR), '{{n}}', n::VARCHAR)"
    rows = lambda values, names: f"{head}, v({names}) AS (VALUES {_values(values)}) "
    text = "'" + CLASSES.replace("'", "''") + "'"
    return {
        "parse_classes": rows(CLASS_SYMBOLS, "q, kind, parent, lineno, end_lineno, complexity, line_count, signature, docstring, is_private") + f"SELECT 'pkg/x' || s || '.py' AS rel_path, 'pkg.x' || s || {put('q')} AS qualified_name, kind, 'pkg.x' || s || {put('parent')} AS parent_qname, lineno::INT AS lineno, end_lineno::INT AS end_lineno, complexity::INT AS complexity, line_count::INT AS line_count, signature, {put('docstring')} AS docstring, is_private::INT AS is_private FROM m, v",
        "class_imports": rows(CLASS_IMPORTS, "module, name, alias, lineno, target") + f"SELECT 'pkg/x' || s || '.py' AS rel_path, {put('module')} AS imported_module, {put('name')} AS imported_name, alias, lineno::INT AS lineno, {put('target')} AS resolved FROM m, v",
        "class_calls": rows(CLASS_CALLS, "q, from_line, callee, lineno, target, to_line") + f"SELECT 'pkg.x' || s || {put('q')} AS caller, from_line::INT AS from_line, {put('callee')} AS callee_name, lineno::INT AS lineno, {put('target')} AS resolved, to_line::INT AS to_line FROM m, v",
        "unused_class_imports": f"{head} SELECT 'pkg/x' || s || '.py' AS rel_path, 11::INT AS lineno, '.' AS imported_module, 'sibling' AS binding FROM m",
        "source_hashes": f"{head}, t AS (SELECT s, {put(text)} AS body FROM m) SELECT 'pkg/x' || s || '.py' AS rel_path, 'pkg.x' || s AS module_path, sha256(body) AS sha256, strlen(body)::BIGINT AS size_bytes FROM t",
    }


def _drift() -> tuple[str, str, str]:
    """BEFORE and AFTER written out by hand as rows."""
    old = [("files", "neutral", 10.0), ("symbols", "neutral", 50.0), ("imports resolved, %", "up", 70.0), ("average complexity", "down", 3.5), ("callables of high complexity", "down", 4.0), ("callables of extreme complexity", "down", 1.0), ("dead symbols", "down", 3.0), ("public symbols reached, %", "up", 40.0), ("cycles of imports", "down", 1.0)]
    new = [("files", 12.0), ("symbols", 50.0), ("imports resolved, %", 85.0), ("average complexity", 3.25), ("callables of high complexity", 7.0), ("callables of extreme complexity", 3.0), ("dead symbols", 3.0), ("cycles of imports", 1.0)]
    was = [("most complex", "a.f"), ("most complex", "a.g"), ("dead", "d.x"), ("cycles of imports", "a.py ↔ b.py")]
    now = [("most complex", "a.g"), ("most complex", "b.h"), ("dead", "d.x"), ("cycles of imports", "a.py ↔ c.py")]
    assert len(BEFORE) == 6 and len(AFTER) == 5
    scalars = f"""o(name, spec, a) AS (VALUES {_values(old)}), c(name, b) AS (VALUES {_values(new)}),
sc AS (SELECT name, a::DOUBLE AS baseline, b::DOUBLE AS current, round_even((b - a)::DOUBLE, 4) AS delta, CASE WHEN a = b THEN 'unchanged' WHEN spec = 'neutral' THEN 'neutral' WHEN (spec = 'down') = (b < a) THEN 'improved' ELSE 'worsened' END AS direction FROM o JOIN c USING (name))"""
    sets = f"""w(name, id) AS (VALUES {_values(was)}), n(name, id) AS (VALUES {_values(now)}),
ch AS (SELECT name, id, 'regression' AS change FROM (FROM n EXCEPT FROM w) UNION ALL SELECT name, id, 'improvement' FROM (FROM w EXCEPT FROM n) UNION ALL SELECT name, id, 'unchanged' FROM (FROM n INTERSECT FROM w))"""
    by_name = "SELECT name, coalesce(string_agg(id, ',' ORDER BY id) FILTER (change = 'regression'), '') AS regressions, coalesce(string_agg(id, ',' ORDER BY id) FILTER (change = 'improvement'), '') AS improvements, count(*) FILTER (change = 'unchanged') AS unchanged, count(*) FILTER (change <> 'regression') AS baseline_size, count(*) FILTER (change <> 'improvement') AS current_size FROM ch GROUP BY name"
    return f"WITH {scalars} SELECT * FROM sc", f"WITH {sets} {by_name}", f"WITH {scalars}, {sets}, v AS (SELECT direction AS v FROM sc UNION ALL SELECT change FROM ch) SELECT count(*) FILTER (v IN ('worsened', 'regression')) AS regression_count, count(*) FILTER (v IN ('improved', 'improvement')) AS improvement_count FROM v"


def oracle_sql() -> dict[str, str]:
    on_tables = {
        "complexity_hotspots": f"SELECT symbol_id, qualified_name, kind, rel_path, lineno, complexity, line_count, {LEVEL} AS bucket FROM plain WHERE complexity >= 10 ORDER BY complexity DESC, rel_path, lineno, symbol_id LIMIT 30",
        "complexity_stats": "SELECT count(*) AS total, round_even(coalesce(avg(complexity), 0), 2) AS average, count(*) FILTER (complexity BETWEEN 11 AND 20) AS high, count(*) FILTER (complexity > 20) AS extreme FROM plain",
        "long_functions": "SELECT symbol_id, qualified_name, kind, rel_path, lineno, line_count, complexity FROM plain WHERE line_count >= 50 ORDER BY line_count DESC, rel_path, lineno, symbol_id LIMIT 30",
        "long_functions_stats": "SELECT count(*) AS total, round_even(coalesce(avg(line_count), 0), 2) AS average_lines, count(*) FILTER (line_count >= 50) AS over_threshold FROM plain",
        "headline_stats": f", {HEADLINE} SELECT * FROM headline",
        "repo_summary": f"SELECT * FROM (SELECT count(*) AS files FROM file), (SELECT {KINDS}, count(*) FILTER (kind = 'constant') AS constants FROM symbol), (SELECT count(*) AS imports, count(resolved_file_id) AS imports_resolved FROM import_edge), (SELECT count(*) AS calls, count(resolved_symbol_id) AS calls_resolved FROM call_edge)",
        "most_imported": "SELECT f.rel_path, count(*) AS imports FROM import_edge e JOIN file f ON f.file_id = e.resolved_file_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
        "largest_files": "SELECT f.rel_path, count(symbol_id) AS symbols FROM file f LEFT JOIN symbol USING (file_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
        "entrypoints": "SELECT rel_path FROM file WHERE rel_path LIKE '%__main__.py' OR rel_path LIKE '%cli.py' OR rel_path LIKE '%/main.py' OR rel_path = 'main.py' OR rel_path LIKE '%/manage.py' ORDER BY 1 LIMIT 20",
        "callers": "SELECT * FROM called",
        "importers": "SELECT dst AS file_id, src AS importer_id, rel_path AS importer FROM imports JOIN file ON file_id = src",
        "second_order_callers": "SELECT * FROM second",
        "impact_all": f"SELECT * EXCLUDE (d), {RISK} AS risk FROM (SELECT *, direct_callers + direct_importers AS d FROM (SELECT symbol_id, qualified_name, (SELECT count(*) FROM called c WHERE c.symbol_id = s.symbol_id) AS direct_callers, (SELECT count(*) FROM imports i WHERE i.dst = s.file_id) AS direct_importers, (SELECT count(*) FROM second x WHERE x.symbol_id = s.symbol_id) AS second_order FROM symbol s))",
        "impact_file": f"SELECT * EXCLUDE (d), {RISK} AS risk FROM (SELECT *, direct_callers + direct_importers AS d FROM (SELECT rel_path, (SELECT count(DISTINCT (c.caller, c.rel_path, c.lineno)) FROM called c JOIN symbol s USING (symbol_id) WHERE s.file_id = f.file_id AND c.rel_path <> f.rel_path) AS direct_callers, (SELECT count(*) FROM imports i WHERE i.dst = f.file_id) AS direct_importers, (SELECT count(DISTINCT j.src) FROM imports i JOIN imports j ON j.dst = i.src WHERE i.dst = f.file_id AND j.src <> f.file_id) AS second_order FROM file f))",
        "context_symbol": "SELECT symbol_id, qualified_name, kind, (SELECT count(*) FROM called c WHERE c.symbol_id = s.symbol_id) AS callers, (SELECT count(*) FROM call_edge e WHERE e.caller_symbol_id = s.symbol_id) AS callees, (SELECT count(resolved_symbol_id) FROM call_edge e WHERE e.caller_symbol_id = s.symbol_id) AS callees_resolved, (SELECT count(*) - 1 FROM symbol x WHERE x.file_id = s.file_id) AS siblings FROM symbol s",
        "context_file": "SELECT rel_path, module_path, imports_in, imports_out, symbols, coalesce(nullif(concat_ws('; ', CASE WHEN rel_path LIKE '%/cli/%' THEN 'command line' END, CASE WHEN rel_path LIKE '%test\\_%' ESCAPE '\\' THEN 'tests' END, CASE WHEN imports_in >= 10 THEN 'imported by many' WHEN imports_in >= 3 THEN 'imported by some' END), ''), 'plain module') AS role_note FROM (SELECT rel_path, module_path, (SELECT count(*) FROM imports i WHERE i.dst = f.file_id) AS imports_in, (SELECT count(*) FROM import_edge e WHERE e.file_id = f.file_id) AS imports_out, (SELECT count(*) FROM symbol s WHERE s.file_id = f.file_id) AS symbols FROM file f)",
        "test_entry_points": "SELECT * FROM entries",
        "test_reachability": "SELECT symbol_id, depth FROM reached",
        "coverage_gaps": "SELECT symbol_id, qualified_name, rel_path, lineno, kind, complexity, line_count, (SELECT count(*) FROM pairs WHERE dst = symbol_id) AS caller_count FROM pool WHERE complexity >= 1 AND symbol_id NOT IN (SELECT symbol_id FROM reached)",
        "coverage_summary": COVERAGE,
        "find_path": _paths(),
        "circular_deps": ", far AS (SELECT src, dst FROM imports UNION SELECT f.src, i.dst FROM far f JOIN imports i ON i.src = f.dst), tied AS (SELECT a.src AS node, min(a.dst) AS part FROM far a JOIN far b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src) SELECT count(*)::INT AS size, list(rel_path ORDER BY rel_path) AS files FROM tied JOIN file ON file_id = node GROUP BY part",
        "import_graph_stats": "SELECT count(*) AS total_edges, count(*) FILTER (src = dst) AS self_edges FROM imports",
        "recency_bonus": f", {BONUS} SELECT * FROM bonus",
        "refactor_stats": "SELECT count(*) AS total_evaluated, count(*) FILTER (rel_path LIKE 'tests/%') AS skipped_test, count(*) FILTER (rel_path NOT LIKE 'tests/%' AND is_private = 0 AND complexity < 3 AND line_count < 20) AS skipped_trivial FROM symbol JOIN file USING (file_id) WHERE kind IN ('function', 'method')",
        "skeleton_index": "SELECT symbol_id, qualified_name, module_path AS module, (SELECT string_agg(upper(x[1]) || x[2:], '' ORDER BY i) FROM (SELECT unnest(string_split(name, '_')) AS x, unnest(range(20)) AS i) WHERE x <> '') || 'Tests' AS test_class, 'test_' || lower(name) || '_skeleton.py' AS filename, params FROM symbol JOIN file USING (file_id) WHERE kind IN ('function', 'method', 'class')",
        "health_summary": f", {HEADLINE} SELECT * FROM headline, (SELECT count(*) AS callables, round_even(avg(complexity), 2) AS avg_complexity, count(*) FILTER (complexity BETWEEN 11 AND 20) AS high, count(*) FILTER (complexity > 20) AS extreme, round_even(avg(line_count), 2) AS avg_lines, count(*) FILTER (line_count >= 50) AS over_threshold FROM plain), (SELECT test_entry_points, reached_count, coverage_pct FROM ({COVERAGE}))",
        "god_files": ", g AS (SELECT rel_path, (SELECT count(*) FROM symbol s WHERE s.file_id = f.file_id) AS symbol_count, coalesce((SELECT sum(line_count) FROM symbol s WHERE s.file_id = f.file_id), 0)::BIGINT AS loc, (SELECT count(*) FROM imports i WHERE i.dst = f.file_id) AS fan_in FROM file f) SELECT rel_path, symbol_count, loc, fan_in, round_even((symbol_count / (SELECT greatest(max(symbol_count), 1) FROM g) + loc / (SELECT greatest(max(loc), 1) FROM g) + fan_in / (SELECT greatest(max(fan_in), 1) FROM g)) / 3, 3) AS score FROM g WHERE symbol_count > 0 ORDER BY score DESC, symbol_count DESC, rel_path LIMIT 20",
        "fan_out": ", g AS (SELECT file_id, count(DISTINCT resolved_file_id) FILTER (resolved_file_id <> file_id) AS fan_out, count(*) AS imports_total, count(resolved_file_id) AS imports_resolved FROM import_edge GROUP BY 1) SELECT *, CASE WHEN share >= 0.2 OR fan_out >= 30 THEN 'high' WHEN share >= 0.08 OR fan_out >= 12 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT rel_path, fan_out, imports_total, imports_resolved, round_even(fan_out / (SELECT count(*) FROM file), 4) AS share FROM g JOIN file USING (file_id) WHERE fan_out >= 1)",
        "resolve_imports_exact": "SELECT edge_id, min(f.file_id) AS target FROM import_edge e JOIN file f ON module_path = imported_module GROUP BY edge_id",
        "resolve_imports_suffix": r", e AS (SELECT edge_id, regexp_replace(imported_module, '^[^.]*\.', '') AS m FROM import_edge) SELECT edge_id, min(file_id) AS target FROM e JOIN file ON module_path = m OR ends_with(module_path, '.' || m) GROUP BY edge_id HAVING count(*) = 1",
        "enclosing_symbol": ", c AS (SELECT e.edge_id, e.lineno, s.file_id FROM call_edge e JOIN symbol s ON s.symbol_id = e.caller_symbol_id), b AS (SELECT c.edge_id, arg_max(s.symbol_id, (s.lineno, s.symbol_id)) AS symbol_id FROM c JOIN symbol s ON s.file_id = c.file_id AND s.lineno <= c.lineno AND s.lineno + s.line_count - 1 >= c.lineno GROUP BY c.edge_id) SELECT edge_id, symbol_id, coalesce(qualified_name, '') AS qualified_name FROM c LEFT JOIN b USING (edge_id) LEFT JOIN symbol USING (symbol_id)",
        "detect_changes": "SELECT rel_path, CASE WHEN file_id % 11 = 0 THEN 'removed' WHEN file_id % 7 = 0 THEN 'modified' ELSE 'unchanged' END AS status FROM file UNION ALL SELECT 'new/' || rel_path, 'added' FROM file WHERE file_id % 9 = 0",
        "change_report": ", x AS (SELECT count(*) FILTER (file_id % 11 = 0) AS removed, count(*) AS n FROM file) SELECT 0::BIGINT AS added, 0::BIGINT AS modified, removed, n - removed AS unchanged_count, n AS total_in_index, n - removed AS total_on_disk, CASE WHEN removed = 0 THEN 'no_changes' WHEN removed > greatest(20, n // 2) THEN 'full' ELSE 'incremental' END AS recommendation FROM x",
        "scan_files": f", {ODD} SELECT rel_path FROM odd WHERE rel_path LIKE '%.py' AND rel_path NOT LIKE '.venv/%' AND rel_path NOT LIKE '%/build/%' AND rel_path NOT LIKE '%/.hidden/%'",
        "module_paths": f", {ODD} SELECT rel_path, replace(CASE WHEN rel_path LIKE '%/\\_\\_init\\_\\_.py' ESCAPE '\\' THEN rel_path[:-13] WHEN rel_path LIKE '%.py' THEN rel_path[:-4] ELSE rel_path END, '/', '.') AS module_path FROM odd",
        "test_paths": f", {ODD} SELECT rel_path, rel_path LIKE 'tests/%' OR (rel_path LIKE '%/test\\_%' ESCAPE '\\' AND rel_path LIKE '%.py') AS coverage, lower(rel_path) LIKE 'tests/%' OR lower(rel_path) LIKE '%/tests/%' OR (rel_path LIKE '%/test\\_%' ESCAPE '\\' AND rel_path LIKE '%.py') AS priority, priority AS comments FROM odd",
        "ignore_filter": "SELECT rel_path FROM file WHERE rel_path NOT LIKE 'tests/%' AND rel_path NOT LIKE 'pkg/cli/%' AND (NOT regexp_matches(rel_path, 'm1[^/]\\.py$') OR ends_with(rel_path, '/m12.py')) AND NOT regexp_matches(rel_path, '^pkg/n[13]/') AND (NOT starts_with(rel_path, 'pkg/n2/') OR regexp_matches(rel_path, 'm[^/]*2\\.py$'))",
    }
    symbols = """SELECT rel_path, module AS qualified_name, 'module' AS kind, 1::INT AS lineno, NULL::INT AS end_lineno, 0::INT AS complexity, 0::INT AS line_count, NULL AS signature, NULL AS docstring FROM mod
UNION ALL SELECT rel_path, module || '.LIMIT', 'constant', head - 3, head - 3, 0, 0, NULL, NULL FROM mod
UNION ALL SELECT rel_path, module || '.f' || k, 'function', top, (top + len - 1)::INT, (1 + b)::INT, len::INT, '(x, y)', 'part ' || k FROM def"""
    alive = "k IN (SELECT target FROM called WHERE target IS NOT NULL)"
    todo = "SELECT rel_path, top AS lineno, tag, text, module || '.f' || k AS qualified_name, (1 + b)::INT AS complexity, len::INT AS line_count, round_even(risk, 1) AS risk, CASE WHEN risk >= 20 THEN 'critical' WHEN risk >= 10 THEN 'high' WHEN risk >= 5 THEN 'medium' ELSE 'low' END AS bucket FROM note"
    stub = lambda name: f"'    def test_' || {name} || '_smoke(self) -> None:' || chr(10) || '        # result = ' || {name} || '(x, y)' || chr(10) || '        raise NotImplementedError(\"write test_' || {name} || '_smoke\")' || chr(10)"
    on_modules = {
        "parse_corpus": symbols,
        "parsed_imports": "SELECT rel_path, name AS imported_module, lineno FROM imp JOIN mod USING (s)",
        "index_report": "SELECT (SELECT count(*) FROM mod) AS files, 0::BIGINT AS files_with_errors, (SELECT count(*) FROM def) + 2 * (SELECT count(*) FROM mod) AS symbols, (SELECT count(*) FROM imp) AS imports, (SELECT count(*) FROM called) AS calls",
        "resolve_imports": "SELECT m.rel_path, name AS imported_module, lineno, t.rel_path AS resolved FROM imp JOIN mod m USING (s) LEFT JOIN mod t ON t.module = name",
        "resolve_calls": "SELECT d.module || '.f' || d.k AS caller, callee AS callee_name, t.module || '.f' || t.k AS resolved FROM called c JOIN def d ON d.k = c.by LEFT JOIN def t ON t.k = c.target",
        "dead_code": f"SELECT module || '.f' || k AS qualified_name, 'f' || k AS name, 'function' AS kind, rel_path, top AS lineno FROM def WHERE NOT {alive}",
        "dead_code_stats": f"SELECT count(*) AS total_checked, 0::BIGINT AS excluded_private, 0::BIGINT AS excluded_dunder, 0::BIGINT AS excluded_entrypoint, 0::BIGINT AS excluded_test, 0::BIGINT AS excluded_textual, count(*) FILTER (NOT coalesce({alive}, false)) AS dead FROM def",
        "unused_imports": "SELECT rel_path, lineno, name AS imported_module, name AS binding FROM imp JOIN mod USING (s) WHERE (name = 'os' AND NOT uses_os) OR name = 'json' OR (name[1] = 'm' AND NOT uses_next)",
        "todo_comments": todo,
        "todo_by_bucket": f"SELECT bucket, count(*) AS hits FROM ({todo}) GROUP BY bucket",
        "todo_stats": f"SELECT (SELECT count(*) FROM mod) AS total_files_scanned, count(DISTINCT rel_path) AS files_with_todos, count(*) AS total_hits FROM ({todo})",
        "todo_by_tag": f"SELECT tag, count(*) AS hits FROM ({todo}) GROUP BY tag",
        "token_counts": ", tok AS (SELECT s, unnest(regexp_extract_all(words, '\\b[A-Za-z_]\\w*\\b')) AS token FROM body UNION ALL SELECT s, unnest(['import', name]) FROM imp UNION ALL SELECT s, unnest(['noqa', 'F401']) FROM imp WHERE name = 're' UNION ALL SELECT s, 'LIMIT' FROM mod UNION ALL SELECT s, 'x' FROM body WHERE b > 0 AND false) SELECT rel_path, token, count(*) AS n FROM tok JOIN mod USING (s) WHERE token NOT IN ('docstring') GROUP BY 1, 2",
        "skeletons": f"SELECT module || '.f' || k AS qualified_name, 'function' AS kind, module, 'f' || k AS name, 'test_f' || k || '_skeleton.py' AS filename, '\"\"\"Test stubs for ' || module || '.f' || k || '; each fails until it is written.\"\"\"' || chr(10) || chr(10) || 'from __future__ import annotations' || chr(10) || chr(10) || 'import unittest' || chr(10) || chr(10) || 'from ' || module || ' import f' || k || chr(10) || chr(10) || chr(10) || 'class F' || k || 'Tests(unittest.TestCase):' || chr(10) || {stub(chr(39) + 'f' + chr(39) + ' || k')} || chr(10) || chr(10) || 'if __name__ == \"__main__\":' || chr(10) || '    unittest.main()' || chr(10) AS body FROM def",
    }
    joined = lambda head, sql: head + (sql if sql.startswith(",") else " " + sql)
    out = {name: joined(CATALOG, sql) for name, sql in on_tables.items()} | {name: joined(MODULES, sql) for name, sql in on_modules.items()}
    out["lexical_query"], out["lexical_query_and"] = _lexical(False), _lexical(True)
    out["refactor_priority"], out["resolve_target"] = _refactor(), _resolve_target()
    out |= _classes()
    out["drift_scalars"], out["drift_sets"], out["drift_counts"] = _drift()
    out["noqa_rules"] = f"WITH {_variants(NOQA_FORMS, ('n', 'y', 'y', 'n', 'y', 'y', 'n'))} SELECT k, r = 'y' AS suppressed FROM named"
    out["todo_tags"] = f"WITH {_variants(TAG_FORMS, ('todo', 'fixme', None, None, 'hack', 'bug', None, 'xxx'))} SELECT k, r AS tag FROM named"
    out["signature_params"] = f"WITH {_variants(SIGNATURE_FORMS, ('', '%', 'a,%,args,k,kw', '%,b', 'a,%'))} SELECT k, r AS params FROM named"
    camel = "(SELECT string_agg(upper(x[1]) || x[2:], '' ORDER BY i) FROM (SELECT unnest(string_split(r, '_')) AS x, unnest(range(20)) AS i) WHERE x <> '')"
    out["pascal_case"] = f"WITH {_variants(('',) * 4, ('%', '%', 'get_%_x', 'XMLThing_%'))} SELECT k, {camel} AS pascal FROM named"
    assert IGNORED[1:] == [("", "tests/"), ("", "*m1?.py"), ("", "/pkg/cli/"), ("", "!m12.py"), ("pkg", "n[1-3]/*"), ("pkg/n2", "!m*2.py")]
    return out
