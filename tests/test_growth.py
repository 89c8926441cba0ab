"""What grows with the input only: rows shuffled, rows of one task, and rows that cross to Python at once."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sorrel.operators import graph, lexical, neighbours, text, twostep, walks
from sorrel.plans import queries
from sorrel.plans.catalog import CALL, FILE, IMPORT, SOURCE, SYMBOL, Catalog, from_source
from sorrel.sources import adapters, parser
from tests.test_graph import queue_path


def shuffled(spark, run):
    """Result of run(), and the rows that its stages shuffled."""
    sc = spark.sparkContext
    gateway, jsc = sc._gateway, sc._jsc.sc()

    def stages():
        jsc.listenerBus().waitUntilEmpty(30_000)
        found = jsc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    out = run()
    return out, sum(n for stage, n in stages().items() if stage not in before)


def table(spark, schema, rows):
    """Rows of some columns, the others null."""
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def catalog(spark, n, calls, imports=(), names=None):
    """n files with a symbol each, of the same id."""
    files = [{"file_id": i, "rel_path": f"f{i}.py", "module_path": f"f{i}"} for i in range(n)]
    symbols = [{"symbol_id": i, "file_id": i, "name": f"s{i}", "qualified_name": (names or {}).get(i, f"f{i}.s{i}"), "kind": "function", "lineno": i * 10} for i in range(n)]
    edges = [{"edge_id": i, "caller_symbol_id": a, "resolved_symbol_id": b, "callee_name": f"s{b}", "lineno": i % 97} for i, (a, b) in enumerate(calls)]
    imported = [{"edge_id": i, "file_id": a, "resolved_file_id": b, "imported_module": f"f{b}", "lineno": 1} for i, (a, b) in enumerate(imports)]
    return Catalog(table(spark, FILE, files), table(spark, SYMBOL, symbols), table(spark, IMPORT, imported), table(spark, CALL, edges))


@pytest.mark.parametrize("part", [walks.PART, 100, -1])
def test_paths_in_parts_of_a_graph(spark, monkeypatch, part):
    r = random.Random(5)
    calls = [(r.randrange(30), r.randrange(30)) for _ in range(150)] + [(30 + r.randrange(20), 30 + r.randrange(20)) for _ in range(40)] + [(52, 52)]
    monkeypatch.setattr(walks, "PART", part)
    monkeypatch.setattr(walks, "WORK", 500)
    c, some = catalog(spark, 54, calls), [3, 7, 8, 31, 44, 52, 53]
    rows = {(x["source"], x["target"]): x for x in graph.find_paths_among(c, c.symbol.where(F.col("symbol_id").isin(some)), 3).collect()}
    assert set(rows) == {(a, b) for a in some for b in some}
    for (a, b), row in rows.items():
        path, taken = queue_path(calls, a, b, 3)
        assert (row["path"], row["nodes_explored"]) == (path and ">".join(f"{n}@{line}" for n, line in path), taken)


def test_paths_are_not_shuffled(spark):
    r = random.Random(6)
    c = catalog(spark, 60, [(r.randrange(60), r.randrange(60)) for _ in range(900)])
    rows, n = shuffled(spark, lambda: graph.find_paths_among(c, c.symbol).count())
    assert rows == 3600 and n < 12_000


@pytest.fixture(scope="module")
def hub(spark):
    """400 nodes that call or import one that calls or imports 300."""
    edges = [(i, 400) for i in range(400)] + [(400, 401 + i) for i in range(300)]
    return catalog(spark, 701, edges, edges)


@pytest.mark.parametrize(("query", "rows"), [(neighbours.second_order_callers, 300 * 400), (neighbours.impact_all, 701), (neighbours.impact_files, 701)])
def test_paths_of_two_steps_are_not_shuffled(spark, hub, query, rows):
    found, n = shuffled(spark, lambda: query(hub).count())
    assert found == rows and n < 30_000


def test_two_steps(spark, monkeypatch):
    """Several ranges, chunks of nodes and of paths; symbols of one name count once, a caller of its own name not at all."""
    for name, n in (("RANGE", 40), ("MARKS", 50), ("PATHS", 7)):
        monkeypatch.setattr(twostep, name, n)
    r = random.Random(8)
    edges = [(r.randrange(25), r.randrange(25)) for _ in range(120)]
    names = {3: "same", 4: "same", 9: "same"}
    name = lambda i: names.get(i, f"f{i}.s{i}")
    c = catalog(spark, 25, edges, edges, names)
    second = {(s, name(w)) for v, s in edges for w, x in edges if x == v and name(w) != name(v)}
    assert sorted((x["symbol_id"], x["caller"]) for x in neighbours.second_order_callers(c).collect()) == sorted(second)
    assert {x["symbol_id"]: x["second_order"] for x in neighbours.impact_all(c).collect()} == {i: sum(s == i for s, _ in second) for i in range(25)}
    files = {f"f{i}.py": (len({(name(a), a, k % 97) for k, (a, b) in enumerate(edges) if b == i != a}), len({w for v, f in edges if f == i for w, x in edges if x == v and w != i})) for i in range(25)}
    assert {x["rel_path"]: (x["direct_callers"], x["second_order"]) for x in neighbours.impact_files(c).collect()} == files


def test_last_lines_of_orders_are_dealt_out(spark, tmp_path):
    spark.range(3).selectExpr("id AS s_suppkey", "1 AS s_nationkey", "0.0D AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(9).selectExpr("id AS p_partkey", "'a b' AS p_name", "'T' AS p_type", "5 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(400).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "id % 9 AS l_partkey", "id % 3 AS l_suppkey", "1.0D AS l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    was = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        c = adapters.tables(spark, str(tmp_path))
        for edges in (c.call_edge, c.import_edge):
            sizes = [x["count"] for x in edges.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 400 and max(sizes) < 200
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hashes_without_a_parser(spark, sf_dir):
    assert "MapIn" not in plan(queries.source_hashes(spark, sf_dir)) and "MapIn" in plan(queries.parse_classes(spark, sf_dir))


@pytest.mark.parametrize("run", [parser._run, text._comments, text._import_lines])
def test_python_holds_few_files_at_a_time(run):
    n = 10 * parser.SLICE + 1
    batch = pa.RecordBatch.from_pydict({"rel_path": [f"m{i}.py" for i in range(n)], "content": [None if run is parser._run and i == 5 else "import os  # TODO: x\nos\n" for i in range(n)], "file_id": list(range(n)), "linenos": pa.array([[1]] * n, pa.list_(pa.int32()))})
    sizes = [b.num_rows for b in run(iter([batch]))]
    assert sum(sizes) == n and max(sizes) <= parser.SLICE


def test_comments_are_tokenised_once(spark):
    c = from_source(table(spark, SOURCE, [{"rel_path": "m.py", "content": "def f():\n    pass  # TODO: x\n", "mtime": 1}]))
    found = text.todo_comments(c)
    assert "MapIn" not in plan(found) and [(x["lineno"], x["qualified_name"]) for x in found.collect()] == [(2, "m.f")]


@pytest.mark.parametrize("made", [adapters.classes, adapters.sources])
def test_modules_to_parse_are_dealt_out(spark, sf_dir, made):
    assert made(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_common_tokens_are_counted_before_they_are_sent(spark):
    c = from_source(table(spark, SOURCE, [{"rel_path": f"m{i}.py", "content": f"def f{i}():\n    pass\n" + "x = x + x\n" * 500, "mtime": 1} for i in range(20)]))
    names = spark.createDataFrame([("x",), ("f3",)], "token string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, n = shuffled(spark, lambda: text.token_counts(c, names).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sorted((x["token"], x["n"]) for x in rows) == [("f3", 1)] + [("x", 1500)] * 20 and n < 5000


def test_a_line_is_looked_up_once(spark):
    """2000 calls of one line in a file of 50 symbols."""
    c = catalog(spark, 1, [])
    c.symbol = table(spark, SYMBOL, [{"symbol_id": i, "file_id": 0, "qualified_name": f"s{i}", "kind": "function", "lineno": i, "end_lineno": 100 - i} for i in range(50)])
    lines = spark.range(2000).selectExpr("0L AS file_id", "30 AS lineno", "id AS edge_id")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, n = shuffled(spark, lambda: text.enclosing(c, lines).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert len(rows) == 2000 and {(x["symbol_id"], x["qualified_name"]) for x in rows} == {(30, "s30")} and n < 4000


def test_parts_of_texts(spark):
    r = random.Random(9)
    word = lambda n: "".join(r.choice("ab/") for _ in range(n))
    texts = [(i, word(r.randrange(0, 30))) for i in range(60)]
    parts = [""] + [t[a : a + r.randrange(1, 20)] for _, t in texts for a in (0, 3)] + [word(r.randrange(1, 14)) for _ in range(60)] + ["abab?", "aabbaabba?"]
    found = lexical.within(spark.createDataFrame([(f"t{i}", p) for i, p in enumerate(parts)] + [("none", None)], "target string, text string"), spark.createDataFrame(texts, "file_id long, text string"))
    want = {f"t{i}": min(k for k, t in texts if p in t) for i, p in enumerate(parts) if any(p in t for _, t in texts)}
    assert {x["target"]: x["file_id"] for x in found.collect()} == want


def test_targets_are_not_tried_against_all_files(spark):
    c = catalog(spark, 5, [])
    assert "Contains(rel_path" not in plan(lexical.resolve_targets(c, spark.createDataFrame([("zebra",)], "target string")))
