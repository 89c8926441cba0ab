"""Python source to facts: one row for each file with its symbols, imports and calls as arrays.

Only this and the tokenizer need Python; rows cross in Arrow batches and are otherwise handled by Spark.
"""

from __future__ import annotations

import ast
import time
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType()}


def struct(fields: str) -> T.StructType:
    """A struct of plain fields, made without a session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in fields.split(", "))])


SYMBOL_TYPE = struct("name string, qualified_name string, kind string, parent_qname string, lineno int, end_lineno int, col int, docstring string, signature string, is_private int, complexity int, line_count int")
IMPORT_TYPE = struct("imported_module string, imported_name string, alias string, lineno int")
CALL_TYPE = struct("caller_qname string, callee_name string, lineno int")
_s = lambda t: "struct<" + ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in t) + ">"
FACTS = f"rel_path string, content string, mtime long, parse_error string, symbols array<{_s(SYMBOL_TYPE)}>, imports array<{_s(IMPORT_TYPE)}>, calls array<{_s(CALL_TYPE)}>"
PARSED = FACTS.replace("parse_error", "abs_path string, module_path string, sha256 string, size_bytes long, indexed_at long, parse_error")

_ONE_EACH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.IfExp, ast.Assert, ast.comprehension)
_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)


_children: dict[type, list[str]] = {}


def walk(*top: ast.AST) -> list[ast.AST]:
    """The nodes of ast.walk() from each of some nodes in turn, without contexts and operators, which have no parts and no lines."""
    whole = []
    for start in top:
        out = [start]
        for node in out:
            kind = type(node)
            if (fields := _children.get(kind)) is None:
                fields = _children[kind] = [f for f in kind._fields if f not in ("ctx", "op", "ops")]
            for field in fields:
                value = getattr(node, field, None)
                if isinstance(value, ast.AST):
                    out.append(value)
                elif isinstance(value, list):
                    out += [x for x in value if isinstance(x, ast.AST)]
        whole += out
    return whole


def complexity(node: ast.AST) -> int:
    """1 and the branches below node; conditions of comprehensions don't count."""
    total = 1
    for sub in walk(node):
        match sub:
            case ast.BoolOp(values=values):
                total += len(values) - 1
            case ast.Match(cases=cases):
                total += len(cases)
            case _ if isinstance(sub, _ONE_EACH):
                total += 1
    return total


def signature(a: ast.arguments) -> str:
    names = [x.arg for x in a.posonlyargs] + ["/"] * bool(a.posonlyargs) + [x.arg for x in a.args]
    if a.vararg:
        names.append(f"*{a.vararg.arg}")
    elif a.kwonlyargs:
        names.append("*")
    names += [x.arg for x in a.kwonlyargs]
    if a.kwarg:
        names.append(f"**{a.kwarg.arg}")
    return "(" + ", ".join(names) + ")"


def dotted(node: ast.AST) -> str | None:
    """a.b.c of a chain of attributes that begins with a name; None of all else."""
    names: deque[str] = deque()
    while isinstance(node, ast.Attribute):
        names.appendleft(node.attr)
        node = node.value
    if not isinstance(node, ast.Name):
        return None
    names.appendleft(node.id)
    return ".".join(names)


def calls_in(body: list[ast.stmt], caller: str, cls: str | None = None) -> list[dict]:
    """Calls below the statements; names of local instances, and self, are replaced by their class."""
    nodes = walk(*body)
    classes = {}
    for node in nodes:
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Call):
            made = (dotted(node.value.func) or "").split(".")[-1]
            if made[:1].isupper():
                classes |= {t.id: made for t in node.targets if isinstance(t, ast.Name)}
    if cls:
        classes = {"self": cls} | classes
    out = []
    for node in nodes:
        name = dotted(node.func) if isinstance(node, ast.Call) else None
        if name:
            head, dot, rest = name.partition(".")
            out.append({"caller_qname": caller, "callee_name": classes.get(head, head) + dot + rest if dot else name, "lineno": node.lineno})
    return out


def _symbol(node: ast.stmt | None, name: str, qname: str, kind: str, parent: str | None = None, **more) -> dict:
    base = {"name": name, "qualified_name": qname, "kind": kind, "parent_qname": parent, "lineno": node.lineno if node else 1, "end_lineno": node.end_lineno if node else None, "col": node.col_offset if node else 0, "docstring": None, "signature": None, "is_private": int(name.startswith("_")), "complexity": 0, "line_count": 0}
    return base | more


def _lines(node: ast.stmt) -> int:
    return max(0, (node.end_lineno or node.lineno) - node.lineno + 1)


def _callable(node: ast.stmt, qname: str, kind: str, parent: str | None) -> dict:
    return _symbol(node, node.name, qname, kind, parent, docstring=ast.get_docstring(node), signature=signature(node.args), complexity=complexity(node), line_count=_lines(node))


def module_path(rel_path: str) -> str:
    parts = rel_path.removesuffix(".py").split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


def parse_text(rel_path: str, text: str) -> dict:
    """parse_error, symbols, imports and calls of one file; whatever ast can't take becomes a parse_error."""
    try:
        tree = ast.parse(text, filename=rel_path)
        return _facts(rel_path, tree)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return {"parse_error": f"{type(e).__name__}: {e}", "symbols": [], "imports": [], "calls": []}


def _facts(rel_path: str, tree: ast.Module) -> dict:
    module = module_path(rel_path)
    whole, inside = module or rel_path, (lambda name: f"{module}.{name}" if module else name)
    symbols, calls = [_symbol(None, "<module>", whole, "module", is_private=0, docstring=ast.get_docstring(tree))], []
    imports = []
    for node in walk(tree):
        if isinstance(node, ast.Import):
            imports += [{"imported_module": a.name, "imported_name": None, "alias": a.asname, "lineno": node.lineno} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            origin = "." * node.level + (node.module or "")
            imports += [{"imported_module": origin, "imported_name": a.name, "alias": a.asname, "lineno": node.lineno} for a in node.names]
    script = [n for n in tree.body if not isinstance(n, (*_DEF, ast.ClassDef, ast.Import, ast.ImportFrom))]
    calls += calls_in(script, whole)
    for node in tree.body:
        if isinstance(node, _DEF):
            symbols.append(_callable(node, inside(node.name), "function", None))
            calls += calls_in(node.body, inside(node.name))
        elif isinstance(node, ast.ClassDef):
            qname = inside(node.name)
            symbols.append(_symbol(node, node.name, qname, "class", docstring=ast.get_docstring(node), line_count=_lines(node)))
            for member in node.body:
                if isinstance(member, _DEF):
                    symbols.append(_callable(member, f"{qname}.{member.name}", "method", qname))
                    calls += calls_in(member.body, f"{qname}.{member.name}", node.name)
        elif isinstance(node, ast.Assign):
            symbols += [_symbol(node, t.id, inside(t.id), "constant") for t in node.targets if isinstance(t, ast.Name) and t.id.isupper()]
    return {"parse_error": None, "symbols": symbols, "imports": imports, "calls": calls}


#: Files of which a worker holds the facts at a time.
SLICE = 100
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE rows at most: Spark's have up to 10,000 whole texts, and what is made of a text is larger than it."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = [("parse_error", pa.string())]
    for name, kind in (("symbols", SYMBOL_TYPE), ("imports", IMPORT_TYPE), ("calls", CALL_TYPE)):
        made.append((name, pa.list_(pa.struct([(f.name, _ARROW[{"bigint": "long"}.get(f.dataType.simpleString(), f.dataType.simpleString())]) for f in kind]))))
    for batch in slices(batches):
        facts = [parse_text(p, t or "") for p, t in zip(batch.column("rel_path").to_pylist(), batch.column("content").to_pylist())]
        columns = [*batch.columns, *(pa.array([f[name] for f in facts], kind) for name, kind in made)]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *(name for name, _ in made)])


def _identified(files: DataFrame, *facts: str) -> DataFrame:
    return files.select("rel_path", "content", "mtime", "abs_path", module_path_of("rel_path").alias("module_path"), F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), F.octet_length("content").cast("long").alias("size_bytes"), F.lit(int(time.time())).cast("long").alias("indexed_at"), *facts)


def _kept(source: DataFrame) -> DataFrame:
    path = "abs_path" if "abs_path" in source.columns else "rel_path"
    return source.select("rel_path", "content", F.col("mtime").cast("long").alias("mtime"), F.col(path).alias("abs_path"))


def unparsed(source: DataFrame) -> DataFrame:
    """parse() without what needs a parser."""
    return _identified(_kept(source))


def parse(source: DataFrame) -> DataFrame:
    """PARSED rows of sources (rel_path, content, mtime and, if there, abs_path)."""
    keep = _kept(source)
    facts = keep.select("rel_path", "content", "mtime").mapInArrow(_run, FACTS)
    if "abs_path" in source.columns:
        facts = facts.join(keep.select("rel_path", "abs_path"), "rel_path")
    else:
        facts = facts.withColumn("abs_path", F.col("rel_path"))
    return _identified(facts, "parse_error", "symbols", "imports", "calls")


def module_path_of(c: str):
    """module_path() as a Column."""
    stem = F.regexp_replace(F.regexp_replace(c, r"\.py$", ""), r"(^|/)__init__$", "")
    return F.replace(stem, F.lit("/"), F.lit("."))
