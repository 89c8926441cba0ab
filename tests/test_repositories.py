"""Small repositories whose results were worked out by hand."""

import json
import os
import textwrap
from datetime import datetime

import pytest

from sorrel import cli
from sorrel.operators import drift, graph, lexical, metrics, neighbours, priority, report, skeleton, text
from sorrel.plans import catalog
from sorrel.streaming import ingest

SHOP = {
    "shop/__init__.py": "from shop.cart import Cart\n",
    "shop/tools.py": '''
        """Helpers."""
        from __future__ import annotations
        RATE = 3

        def price(x):
            return x * RATE

        def lonely(x):
            return x
        ''',
    "shop/cart.py": '''
        import json
        import os  # noqa: F401
        from shop.tools import price, RATE

        class Cart:
            """A cart of goods."""
            def __init__(self, owner: str, size=1):
                self.owner = owner

            def total(self, goods):
                if goods:
                    for g in goods:
                        if g and g.ok:
                            self.add(g)
                return price(1)

            def add(self, g):  # TODO: check g
                return g
        ''',
    "shop/main.py": '''
        import shop.tools
        import shop.tools as st
        from shop.cart import Cart

        def main():
            c = Cart("me")
            c.total([])
            st.price(2)
            run_later()

        def run_later():
            shop.tools.price(1)
            print("x")
        ''',
    "shop/loop_a.py": "import shop.loop_b\n",
    "shop/loop_b.py": "import shop.loop_a\n",
    "tests/test_cart.py": '''
        from shop.cart import Cart

        class CartTests:
            def setUp(self):
                self.c = Cart("x")

            def test_total(self):
                c = Cart("x")
                c.total([1])
        ''',
    "broken.py": "def f(:\n",
}
CHAIN = {"chain.py": "def entry():\n    level_one()\n    alt()\ndef level_one():\n    level_two()\ndef level_two():\n    level_three()\ndef level_three():\n    pass\ndef alt():\n    pass\ndef lonely():\n    pass\n"}


def sources(spark, files):
    return spark.createDataFrame([(p, textwrap.dedent(t), 100 + i) for i, (p, t) in enumerate(sorted(files.items()))], catalog.SOURCE)


def make(spark, files):
    return catalog.from_source(sources(spark, files)).cached()


def names(df, *cols):
    return sorted(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect())


@pytest.fixture(scope="module")
def shop(spark):
    return make(spark, SHOP)


@pytest.fixture(scope="module")
def chain(spark):
    return make(spark, CHAIN)


def test_every_rule_of_resolution(shop):
    s = shop.symbol
    calls = shop.call_edge.join(s.selectExpr("symbol_id AS caller_symbol_id", "qualified_name AS caller"), "caller_symbol_id").join(s.selectExpr("symbol_id AS resolved_symbol_id", "qualified_name AS to"), "resolved_symbol_id", "left")
    to = {(r["caller"], r["callee_name"]): r["to"] for r in calls.collect()}
    assert to["shop.main.main", "run_later"] == "shop.main.run_later"  # same file
    assert to["shop.cart.Cart.total", "price"] == "shop.tools.price"  # imported name
    assert to["shop.main.main", "Cart.total"] == "shop.cart.Cart.total"  # method of an imported class
    assert to["shop.cart.Cart.total", "Cart.add"] == "shop.cart.Cart.add"  # method of a class of the same file
    assert to["shop.main.main", "st.price"] == "shop.tools.price"  # imported module
    assert to["shop.main.run_later", "shop.tools.price"] is None and to["shop.main.run_later", "print"] is None


def test_import_resolution(spark):
    c = make(spark, {"a/x/json.py": "", "b/util.py": "", "c/util.py": "", "m.py": "import json\nimport util\nfrom . import util\nimport b.util\nimport b_util\n"})
    rows = c.import_edge.join(c.file.selectExpr("file_id AS resolved_file_id", "rel_path"), "resolved_file_id")
    assert names(rows, "imported_module", "rel_path") == [("b.util", "b/util.py"), ("json", "a/x/json.py")]


def test_quirks_of_calls(spark):
    c = make(spark, {"t.py": "def f():\n    pass\n", "m.py": "from t import f as g\nclass K:\n    def only(self):\n        pass\ndef twice():\n    only()\ndef twice():\n    g()\n    only()\n"})
    rows = c.call_edge.join(c.symbol.selectExpr("symbol_id AS caller_symbol_id", "lineno AS at"), "caller_symbol_id")
    found = {(r["at"], r["callee_name"], r["resolved_symbol_id"] is not None) for r in rows.collect()}
    assert found == {(7, "only", True), (7, "g", False)}


def test_counts(shop):
    h = metrics.headline_stats(shop).first()
    assert (h["files"], h["files_with_parse_errors"], h["classes"], h["methods"]) == (8, 1, 2, 5)


def test_find_path(chain):
    ids = {r["name"]: r["symbol_id"] for r in chain.symbol.collect()}
    steps, s = graph.find_path(chain, ids["entry"], ids["level_three"])
    assert s["found"] and s["depth"] == 3
    assert [(r["depth"], r["lineno"]) for r in steps.orderBy("depth").collect()] == [(0, 1), (1, 2), (2, 5), (3, 7)]
    assert graph.find_path(chain, ids["entry"], ids["alt"])[1]["depth"] == 1
    assert graph.find_path(chain, ids["entry"], ids["entry"])[1] == {"found": True, "depth": 0, "nodes_explored": 1}
    assert not graph.find_path(chain, ids["entry"], ids["lonely"])[1]["found"]
    assert graph.find_path(chain, ids["entry"], ids["level_three"], 1)[1]["found"] is False


def test_cycles(shop):
    assert [(r["size"], r["files"]) for r in graph.circular_deps(shop).collect()] == [(2, ["shop/loop_a.py", "shop/loop_b.py"])]


def test_nested_cycles(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1), (5, 8), (9, 10), (10, 11)]
    found = graph.components(spark.createDataFrame(edges, "src long, dst long"))
    assert names(found, "node", "component") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)]


def test_coverage(shop):
    row = graph.coverage_summary(shop).first()
    assert (row["test_entry_points"], row["total_public_symbols"], row["public_reached"]) == (2, 7, 4)
    assert row["coverage_pct"] == 57.1
    assert names(graph.coverage_gaps(shop), "qualified_name") == ["shop.main.main", "shop.main.run_later", "shop.tools.lonely"]


def test_dead_code(shop):
    assert names(text.dead_code(shop), "qualified_name") == ["shop.tools.lonely", "tests.test_cart.CartTests.setUp"]


def test_dispatch_keeps_alive(spark):
    c = make(spark, {"d.py": "def helper():\n    pass\ndef single():\n    pass\nTABLE = {'a': helper}\n"})
    assert names(text.dead_code(c), "name") == ["single"]


def test_unused_imports(shop):
    assert names(text.unused_imports(shop), "binding") == ["Cart", "RATE", "json", "shop", "shop"]


def test_logical_imports():
    assert text.logical_line(["from a import (  # noqa", "  b,", ")", "x"], 1) == "from a import (  # noqa\n  b,\n)"
    assert text.outside_imports("from a import (\n  b,\n)\nuse\nimport c\n") == ["use"]
    assert text.outside_imports("from a import (\n  b,  # (see c)\n  d\nimport e, (\n") == ["d"] and text.outside_imports("importing = frozen") == ["frozen", "importing"]


def test_todo(shop, spark):
    row = text.todo_comments(shop).first()
    assert (row["tag"], row["qualified_name"], row["risk"], row["bucket"], row["text"]) == ("todo", "shop.cart.Cart.add", 3.2, "low", "TODO: check g")
    c = make(spark, {"m.py": 'x = "# TODO: no"\n# todo lower\n# X.XXX no\n# HACK yes\n', "tests/test_m.py": "# BUG here\n"})
    assert names(text.todo_comments(c), "tag") == ["hack"] and names(text.todo_comments(c, include_tests=True), "tag") == ["bug", "hack"]


def test_priority_scores(spark):
    body = "def monster(a):\n" + "".join(f"    if a > {i}:\n        a += 1\n" for i in range(9))
    c = make(spark, {"m.py": body, "u.py": "from m import monster\ndef go():\n    monster(1)\n"})
    row = priority.refactor_priority(c, min_priority=0).first()
    assert (row["complexity"], row["line_count"], row["caller_count"], row["complexity_score"], row["size_score"]) == (10, 19, 1, 20.0, 3.8)
    assert row["priority"] == 35.3 and row["is_untested"] and row["reasons"][0] == "complexity 10: high"


def test_search(shop):
    hits = lexical.search(shop, "where is the Cart").collect()
    assert hits[0]["qualified_name"] == "shop.cart.Cart" and hits[0]["snippet"] == "A cart of goods."
    assert lexical.search(shop, "the of").count() == 0 and lexical.words("a, 'b' (c) d e f g h") == ["b", "c", "d", "e", "f"]
    assert lexical.search(shop, "cart zebra", match_all=True).count() == 0


@pytest.mark.parametrize(("target", "level"), [("shop.cart.Cart", 1), ("shop.tools", 3), ("cart.Cart", 4), ("Cart.add", 4), ("price", 6), ("shop/main.py", 7), ("loop_", 8), ("nothing", None)])
def test_targets(shop, target, level):
    hit = lexical.resolve_target(shop, target)
    assert (hit and hit["level"]) == level


def test_cards(shop):
    card = neighbours.context(shop, "shop.tools.price")
    assert [c[0] for c in card["callers"]] == ["shop.cart.Cart.total", "shop.main.main"] and card["imports_in"] == ["shop/cart.py", "shop/main.py"]
    hit = neighbours.impact(shop, "shop.tools.price")
    assert len(hit["direct_callers"]) == 2 and hit["risk"] == "medium" and neighbours.impact(shop, "zebra")["kind"] == "not_found"
    assert neighbours.impact(shop, "shop/tools.py")["kind"] in ("symbol", "file") and neighbours.context(shop, "shop/cart.py")["kind"] == "file"


def test_skeleton(shop, tmp_path):
    made = skeleton.generate(shop, "Cart")
    compile(made.body, "x", "exec")
    assert made.filename == "test_cart_skeleton.py" and "class CartTests" in made.body and "Cart(owner, size)" in made.body and "test_total_smoke" in made.body and "test___init__" not in made.body
    path = tmp_path / "t.py"
    skeleton.write(made, str(path))
    with pytest.raises(FileExistsError):
        skeleton.write(made, str(path))
    assert skeleton.generate(shop, "zebra") is None and "price(x)" in skeleton.generate(shop, "price").body


def test_drift(spark):
    a = {"complexity": {"high": 4, "extreme": 1, "hotspots": [{"qname": "x"}]}, "headline": {"files": 10}, "coverage": {"coverage_pct": 70.0}, "cycles": {"groups": [{"files": ["b", "a"]}]}}
    b = {"complexity": {"high": 7, "extreme": 3, "hotspots": [{"qname": "x"}, {"qname": "y"}]}, "headline": {"files": 12}, "coverage": {"coverage_pct": 85.0}, "cycles": {"groups": [{"files": ["c", "a"]}]}, "god_files": []}
    d = drift.compute(spark, a, b)
    assert (d["regression_count"], d["improvement_count"]) == (4, 2) and [s["direction"] for s in d["scalars"]] == ["neutral", "worsened", "worsened", "improved"]
    same = drift.compute(spark, b, b)
    assert same["regression_count"] == same["improvement_count"] == 0 and "No measurable drift" in drift.markdown(same)
    assert drift.compute(spark, None, b)["has_baseline"] is False and "`y`" in drift.markdown(d)


def test_report(shop):
    made = report.health_report(shop)
    assert made["summary"]["cycles"]["count"] == 1 and made["summary"]["dead_code"]["symbols"][0]["qname"] == "shop.tools.lonely"
    assert all(f"## {i}." in made["markdown"] for i in range(1, 10)) and json.loads(report.to_json(made["summary"]))["dead_code_count"] == 2


def write(folder, files):
    for path, code in files.items():
        os.makedirs(os.path.dirname(os.path.join(folder, path)) or folder, exist_ok=True)
        with open(os.path.join(folder, path), "w") as f:
            f.write(textwrap.dedent(code))


def test_store_and_command_line(spark, tmp_path, capsys):
    repo = str(tmp_path / "repo")
    write(repo, SHOP | {".venv/x.py": "", "ignored/y.py": ""})
    with open(f"{repo}/.gitignore", "w") as f:
        f.write("ignored/\n")
    run = lambda *args: (cli.main([args[0], repo, *args[1:]]), capsys.readouterr().out)
    assert run("summary")[0] == 2
    code, out = run("index", "--json")
    assert code == 0 and json.loads(out)["files_seen"] == 8 and json.loads(out)["files_with_errors"] == 1
    assert json.loads(run("index", "--json")[1])["files_skipped_unchanged"] == 8
    before = catalog.Store(spark, f"{repo}/.sorrel").open()
    kept = names(before.symbol, "qualified_name")
    assert json.loads(run("detect_changes", "--json")[1])["recommendation"] == "no_changes"
    write(repo, {"shop/new.py": "def fresh():\n    pass\n"})
    os.remove(f"{repo}/shop/loop_b.py")
    found = json.loads(run("detect_changes", "--json")[1])
    assert (found["added"], found["removed"], found["recommendation"]) == (1, 1, "incremental")
    done = json.loads(run("index", "--json")[1])
    assert (done["files_indexed"], done["files_removed"], done["files_skipped_unchanged"]) == (1, 1, 7)
    now = catalog.Store(spark, f"{repo}/.sorrel").open()
    full = catalog.from_source(now.source)
    for t in ("symbol", "import_edge", "call_edge"):
        assert names(getattr(now, t), *getattr(full, t).columns[:3]) == names(getattr(full, t), *getattr(full, t).columns[:3])
    assert set(kept) ^ set(names(now.symbol, "qualified_name")) == {"shop.loop_b", "shop.new", "shop.new.fresh"}
    assert run("find_path", "main", "Cart.add")[0] == 0 and run("find_path", "main", "zebra")[0] == 1
    assert run("context", "zebra")[0] == 1 and "lonely" in run("find_dead_code")[1] and run("ptc")[0] == 0
    base = str(tmp_path / "base.json")
    assert run("health_report", "--save-baseline", base)[0] == 0 and "10. Drift" in run("health_report", "--baseline", base)[1]
    with open(base, "w") as f:
        f.write("{}")
    assert run("health_report", "--baseline", base)[0] == 2
    with open(f"{repo}/.sorrel/operations.log") as f:
        log = [line.rstrip("\n").split("\t") for line in f]
    assert log[0][1] == "index" and log[-1][1] == "health_report" and log[-1][2].endswith("exit=2")
    assert all(datetime.fromisoformat(line[0]).tzinfo for line in log)
    flags = cli.parser().parse_args(["--no-color", "index", repo, "--parallel", "--workers", "3"])
    assert flags.color is False and flags.parallel and flags.workers == 3 and not flags.no_parallel


def test_stream(spark, tmp_path):
    landing, store = tmp_path / "landing", str(tmp_path / "store")
    landing.mkdir()
    for n, record in enumerate([{"rel_path": "a.py", "content": "def one():\n    two()\n", "mtime": 1}, {"rel_path": "b.py", "content": "def two():\n    pass\n", "mtime": 2}, {"rel_path": "b.py", "content": "def three():\n    pass\n", "mtime": 3}]):
        (landing / f"{n}.json").write_text(json.dumps(record) + "\n")
        if n != 1:
            ingest.watch(spark, str(landing), store).awaitTermination(120)
    c = catalog.Store(spark, store).open()
    assert names(c.symbol.where("kind = 'function'"), "name") == ["one", "three"]
