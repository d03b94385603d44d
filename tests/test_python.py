import ast

import pytest
from pyspark.sql import functions as F

from codescope.operators import python_symbols, python_views
from codescope.plans import lookup, views

MODULE = '''\
import json
from typing import (
    Any,
)
import sys; import re

@decorated
class Loader(Base, Mixin[int], metaclass=Meta):
    """Loads rows.

    In full.
    """

    def __init__(self, client, *args: Any, flag: bool=True, **kw) -> None:
        """
        Starts on the second line.
        """
        self.client = client

    if True:
        def hidden(self):
            pass

    async def run(self, rows: list[int] = [1, 2]) -> dict:
        r"""Runs \\d."""
        def helper():
            return None
        return {}

    class Inner:
        def deep(self): return 1

def run(a, /, b, *, c):
    return a

try:
    import late
except ImportError:
    def fallback(): pass
'''


@pytest.fixture
def view(spark, files_of):
    def run(expression, text=MODULE, path="pkg/mod.py"):
        parsed = python_symbols.parse_python(files_of({path: text}))
        return python_views.with_view(parsed, expression(F.col("parsed"))).first().view

    return run


def test_structure(view):
    assert view(python_views.structure) == "Loader\n  __init__\n  run\nrun"


def test_structure_with_labels(view):
    labelled = view(lambda p: python_views.structure(p, labels=True))
    assert labelled == "[Class] Loader\n  [Method] __init__\n  [Method] run\n[Function] run"


def test_skeleton(view):
    assert view(python_views.skeleton) == (
        "class Loader(Base, Mixin[int]):\n"
        '    """Loads rows."""\n'
        "    def __init__(self, client, *args: Any, flag: bool=True, **kw) -> None: ...\n"
        "    async def run(self, rows: list[int]=[1, 2]) -> dict: ...\n"
        '        """Runs \\d."""\n'
        "\n"
        "def run(a, /, b, *, c): ..."
    )


def test_line_skeleton(view):
    assert view(python_views.line_skeleton) == (
        "class Loader(Base, Mixin[int], metaclass=Meta):\n"
        '    """Loads rows."""\n'
        "    def __init__(self, client, *args: Any, flag: bool=True, **kw) -> None:\n"
        "    async def run(self, rows: list[int] = [1, 2]) -> dict:\n"
        "\n"
        "def run(a, /, b, *, c):"
    )


def test_imports(view):
    assert view(python_views.imports_block) == "import json\nfrom typing import (\n    Any,\n)\nimport sys; import re"
    assert view(python_views.imports_block, "x = 1\n") == "(no imports)"


def test_body_is_first_breadth_first(spark, files_of):
    """A module-level function wins over a method of that name; decorators are not part of a body."""
    requests = [(1, "pkg/mod.py", "run"), (2, "pkg/mod.py", "helper"), (3, "pkg/mod.py", "fallback")]
    found = lookup.symbol_body(
        files_of({"pkg/mod.py": MODULE}), spark.createDataFrame(requests, "req_id long, path string, name string")
    )
    bodies = {r.req_id: r.result for r in found.collect()}
    assert bodies[1] == "def run(a, /, b, *, c):\n    return a"
    assert bodies[2] == "        def helper():\n            return None"
    assert bodies[3] == "    def fallback(): pass"


@pytest.mark.parametrize("text", [MODULE, MODULE.replace("\n", "\r\n"), "é = '😀'\ndef f():\n    'é😀'\n", "def g(): pass"])
def test_body_and_order_agree_with_ast(spark, files_of, text):
    """Brute force: walk the tree, slice the lines."""
    plain = text.replace("\r\n", "\n")
    first = {}
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    nodes = [n for n in ast.walk(ast.parse(plain)) if isinstance(n, kinds)]
    for node in nodes:
        first.setdefault(node.name, "\n".join(plain.split("\n")[node.lineno - 1 : node.end_lineno]))
    requests = [(i, "m.py", name) for i, name in enumerate(first)]
    found = lookup.symbol_body(
        files_of({"m.py": text}), spark.createDataFrame(requests, "req_id long, path string, name string")
    )
    assert {r.name: r.result for r in found.collect()} == first
    table = python_symbols.symbols_table(python_symbols.parse_python(files_of({"m.py": text})))
    assert [r.name for r in table.orderBy("bfs_ord").collect()] == [n.name for n in nodes]


def test_card_and_location(spark, files_of):
    requests = spark.createDataFrame(
        [(1, "m.py", "Loader"), (2, "m.py", "helper"), (3, "m.py", "nope"), (4, "x.rb", "a"), (5, "gone.py", "a")],
        "req_id long, path string, name string",
    )
    files = files_of({"m.py": MODULE, "x.rb": "puts"})
    cards = {r.req_id: r for r in lookup.symbol_card(files, requests).collect()}
    assert cards[1].result == "class Loader(Base, Mixin[int])\nLoads rows.\n\n    In full.\n    "
    assert cards[2].result == "def helper()"
    assert cards[3].message == "Symbol 'nope' not found in m.py"
    assert cards[4].status == "unsupported"
    assert cards[5].message == "File not found: gone.py"
    places = {r.req_id: (r.line, r.col) for r in lookup.locate_definition(files, requests).collect()}
    assert places == {1: (7, 6), 2: (25, 12), 3: (None, None), 4: (None, None), 5: (None, None)}


@pytest.mark.parametrize("text", ["class (nothing:\n", "x = '\0'\n", "(" * 5000])
def test_unparseable_text_is_a_status(spark, files_of, text):
    files = files_of({"bad.py": text, "good.py": "def f(): pass\n"})
    status = {r.path: r.status for r in python_symbols.parse_status(python_symbols.parse_python(files)).collect()}
    assert status == {"bad.py": "parse_error", "good.py": "ok"}
    shown = {r.path: r.view for r in views.structure(files).collect()}
    assert shown["bad.py"].startswith("Parse error in bad.py: ")
    assert shown["good.py"] == "f"


def test_lone_surrogate_in_docstring(view):
    assert '"""\\ud800"""' in view(python_views.skeleton, 'def f():\n    "\\ud800"\n')


def test_symbol_tree_keeps_namesakes_apart(spark, files_of):
    text = "class A:\n    def x(self): pass\n\nclass A:\n    def y(self): pass\n"
    tree = python_symbols.symbol_tree(python_symbols.parse_python(files_of({"m.py": text})))
    assert {(r.parent, r.parent_line, r.child) for r in tree.collect()} == {("A", 1, "x"), ("A", 4, "y")}


def test_import_rows(spark, files_of):
    text = "import a.b as c, d\nfrom ..up import x as y, z\nfrom . import *\ndef f():\n    import late\n"
    rows = python_symbols.imports_table(python_symbols.parse_python(files_of({"m.py": text}))).orderBy("ord").collect()
    assert [(r.module, r.names, r.top_level) for r in rows] == [
        (None, ["a.b", "d"], True), ("..up", ["x", "z"], True), (".", ["*"], True), (None, ["late"], False),
    ]


def test_no_symbols(view):
    for expression in (python_views.structure, python_views.skeleton, python_views.line_skeleton):
        assert view(expression, "x = 1\n") == "(no symbols found)"


def test_simple_signatures_are_written_as_unparse_writes_them(monkeypatch):
    written = ["", "self", "a, b=1", "a: int, b: x.Y=None, c='d', e=u'f', g=True", "a: 'T', b=\"it's\"", "a=-1", "a: x.y.z",
               "a, /, b", "*a", "a, *, b=2", "**k", "a: list[int]=(1, 2)", "a=1.5, b=b'c', d=...", "a=lambda b: b", "a: 1e999"]
    nodes = [ast.parse(f"def f({text}): pass").body[0].args for text in written]
    expected = [ast.unparse(node) for node in nodes]
    assert [python_symbols._arguments(node) for node in nodes] == expected
    monkeypatch.setattr(ast, "unparse", None)
    assert [python_symbols._arguments(node) for node in nodes[:3]] == expected[:3]


def test_statements_are_found_in_every_block():
    source = ("if a:\n x\nelse:\n y\ntry:\n x\nexcept E:\n z\nelse:\n w\nfinally:\n v\n"
              "match a:\n case 1:\n  q\nfor i in a: x\nelse: y\nwith a: x\nclass C: x\nf = lambda: 0\n")
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.stmt | ast.ExceptHandler | ast.match_case):
            inner = [c for c in ast.iter_child_nodes(node) if isinstance(c, ast.stmt | ast.ExceptHandler | ast.match_case)]
            assert list(python_symbols._statements(node)) == inner
