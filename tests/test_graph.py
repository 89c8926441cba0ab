"""Walks of the graph operators against plain Python on random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from sorrel.operators import graph
from sorrel.plans.catalog import Catalog


def queue_path(edges, source, target, max_depth):
    """The first path a queue finds, with the lines of its calls, and the nodes taken from the queue."""
    if source == target:
        return [(source, source * 10)], 1
    parent, queue, depth, taken = {source: None}, [source], {source: 0}, 0
    while queue:
        node = queue.pop(0)
        taken += 1
        if depth[node] == max_depth:
            continue
        for edge, (src, dst) in enumerate(edges):
            if src == node and dst not in parent:
                parent[dst], depth[dst] = (node, edge), depth[node] + 1
                queue.append(dst)
                if dst == target:
                    path = []
                    while parent[dst]:
                        path.append((dst, parent[dst][1] % 97))
                        dst = parent[dst][0]
                    return [(source, source * 10), *path[::-1]], taken
    return None, taken


@pytest.fixture(scope="module")
def calls(spark):
    r = random.Random(3)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(70)]
    symbol = spark.range(40).select(F.col("id").alias("symbol_id"), (F.col("id") * 10).cast("int").alias("lineno"))
    rows = [(i, s, d, i % 97) for i, (s, d) in enumerate(edges)]
    call_edge = spark.createDataFrame(rows, "edge_id long, caller_symbol_id long, resolved_symbol_id long, lineno int")
    return edges, Catalog(None, symbol, None, call_edge)


@pytest.mark.parametrize("max_depth", [2, 8])
def test_find_paths(spark, calls, max_depth):
    edges, c = calls
    some = [3, 5, 8, 21, 34]
    pairs = spark.createDataFrame([(a, b) for a in some for b in some], "source long, target long")
    for row in graph.find_paths(c, pairs, max_depth).collect():
        path, taken = queue_path(edges, row["source"], row["target"], max_depth)
        assert row["path"] == (path and ">".join(f"{n}@{line}" for n, line in path)) and row["nodes_explored"] == taken
        assert row["depth"] == (None if path is None else len(path) - 1)
    steps, summary = graph.find_path(c, 3, 21, max_depth)
    path, taken = queue_path(edges, 3, 21, max_depth)
    assert [(s["symbol_id"], s["lineno"]) for s in steps.collect()] == (path or []) and summary["nodes_explored"] == taken


def brute_components(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {d for s, d in edges if s == n} for n in nodes}
    while True:
        more = {n: set().union(reach[n], *(reach[m] for m in reach[n])) for n in nodes}
        if more == reach:
            return {(n, min(m for m in nodes if m in reach[n] and n in reach[m])) for n in nodes if n in reach[n]}
        reach = more


@pytest.mark.parametrize("one_task", [True, False])
def test_components(spark, monkeypatch, one_task):
    r = random.Random(7)
    edges = [(r.randrange(30), r.randrange(30)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(12)] + [(112, 100), (200, 200), (201, 202)]
    if not one_task:
        monkeypatch.setattr(graph, "ONE_TASK", -1)
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {(x["node"], x["component"]) for x in graph.components(df).collect()} == brute_components(edges)
    assert graph.components(df.limit(0)).count() == 0
