import ast
import textwrap

import pytest

from sorrel.sources import parser, scan


def facts(code, path="pkg/mod.py"):
    return parser.parse_text(path, textwrap.dedent(code))


def by_name(found):
    return {s["qualified_name"]: s for s in found["symbols"]}


@pytest.mark.parametrize(
    ("body", "value"),
    [
        ("pass", 1),
        ("x = [i for i in y if i if not i]", 2),
        ("match x:\n        case 1: pass\n        case 2: pass\n        case _: pass", 4),
        ("try:\n        pass\n    except* ValueError:\n        pass", 2),
        ("try:\n        pass\n    except ValueError:\n        pass", 3),
        ("return a and b and c or d", 4),
        ("def g():\n        if a: pass", 2),
        ("assert a if b else c", 3),
        ("with a:\n        for b in c: pass", 3),
    ],
)
def test_complexity(body, value):
    assert parser.complexity(ast.parse(f"def f():\n    {body}\n").body[0]) == value


def test_symbols():
    found = facts(
        '''
        """Doc."""
        LIMIT = 3
        _LOW: int = 4
        A, B = 1, 2
        _OK = 1
        def f(a, /, b, *c, d=1, **e):
            """F."""
            def inner(): pass
        class C(Base):
            x = make()
            def m(self): pass
            class D: pass
        if LIMIT:
            def hidden(): go()
        '''
    )
    s = by_name(found)
    assert list(s) == ["pkg.mod", "pkg.mod.LIMIT", "pkg.mod._OK", "pkg.mod.f", "pkg.mod.C", "pkg.mod.C.m"]
    assert s["pkg.mod.f"]["signature"] == "(a, /, b, *c, d, **e)" and s["pkg.mod.f"]["docstring"] == "F." and s["pkg.mod.f"]["line_count"] == 3
    assert s["pkg.mod.C"]["complexity"] == 0 and s["pkg.mod.C.m"]["parent_qname"] == "pkg.mod.C" and s["pkg.mod._OK"]["is_private"] == 1
    assert [(c["caller_qname"], c["callee_name"]) for c in found["calls"]] == [("pkg.mod", "go")]


def test_calls_and_imports():
    found = facts(
        """
        import a.b as c, d
        from . import e
        from ..f import g as h
        class K:
            @deco()
            def m(self, x=default()):
                v = Other(1)
                v.run(); self.n(); c.z(); a.b.y(); f().q(); v.w.u()
        """
    )
    assert [(i["imported_module"], i["imported_name"], i["alias"]) for i in found["imports"]] == [("a.b", None, "c"), ("d", None, None), (".", "e", None), ("..f", "g", "h")]
    assert sorted(c["callee_name"] for c in found["calls"]) == sorted(["Other", "Other.run", "K.n", "c.z", "a.b.y", "f", "Other.w.u"])


def test_errors():
    assert facts("def f(:\n")["parse_error"].startswith("SyntaxError") and facts("x\0y")["parse_error"] and facts("")["symbols"][0]["kind"] == "module"


def test_module_path():
    assert [parser.module_path(p) for p in ("a/b.py", "a/__init__.py", "__init__.py")] == ["a.b", "a", ""]


@pytest.mark.parametrize(
    ("lines", "path", "is_dir", "verdict"),
    [
        (["*.pyc"], "pkg/sub/foo.pyc", False, True),
        (["__pycache__/"], "__pycache__", False, None),
        (["__pycache__/"], "__pycache__/x.py", False, True),
        (["/build/"], "build", True, True),
        (["/build/"], "pkg/build", True, None),
        (["workspace/generated/"], "other/workspace/generated", True, None),
        (["**/cache"], "a/b/cache", True, True),
        (["**/cache"], "notcache", True, None),
        (["*.log", "!keep.log"], "keep.log", False, False),
        (["foo[123].py"], "foo4.py", False, None),
        (["foo[!123].py"], "foo4.py", False, True),
    ],
)
def test_ignore_rules(spark, lines, path, is_dir, verdict):
    paths = spark.createDataFrame([(path, is_dir)], "rel_path string, is_dir boolean")
    assert scan.verdicts(paths, scan.compile_rules(spark, [("", x) for x in lines])).first()["ignored"] is verdict


def test_inner_rules_win(spark):
    rules = scan.compile_rules(spark, [("", "*.py"), ("", "gone/"), ("inner", "!keep.py"), ("gone", "!keep.py")])
    paths = spark.createDataFrame([("inner/keep.py",), ("inner/x.py",), ("gone/keep.py",)], "rel_path string")
    assert [r[0] for r in scan.kept(paths, rules).collect()] == ["inner/keep.py"]
