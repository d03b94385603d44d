"""Which binding a name means, against the standard library's symbol tables and by cases."""

import ast
import symtable

import pytest

from codescope.operators import resolved
from codescope.operators.python_scopes import MODULE, Scopes

SNIPPETS = [
    "x = 1\ndef f(x): return x\ndef g(): return x\n",
    "def f():\n    global x\n    x = 1\n    def g(): return x\n    return g\n",
    "def f():\n    x = 1\n    def g():\n        nonlocal x\n        x = 2\n        return x\n    return x, g\n",
    "def f(a, /, b=y, *c, d=z, **e): return a, b, c, d, e, y, z\n",
    "def f(n):\n    return [n for n in n], {m: n for m in n}, (lambda n, k=n: n + k + q)\n",
    "class C:\n    x = 1\n    def m(self): return x\n    def k(self): return C.x, self\n",
    "def f():\n    try: pass\n    except E as e: return e\n    with a as b: return b\n    for i in j: i\n    import p.q, r as s\n    return p, s, e, r\n",
    "def f(v):\n    match v:\n        case {'k': k, **rest}: return k, rest\n        case [a, *b] | C(a, b) as c: return a, b, c\n",
    "def f():\n    if (n := g()): return n\n    return [y := h for h in n], y\n",
    "def f[T](a: T) -> T: return T, a\nclass D[U](B[U]):\n    def m(self) -> U: return U\ntype A[V] = list[V]\n",
    "async def f():\n    async with a as b: return b\n    async for c in d: await c\n    return [e async for e in f]\n",
    "@dec(x)\ndef f(x=x): return x\n@dec\nclass K(x, metaclass=y): z = x\n",
    "def f():\n    class K:\n        x = 1\n        y = x\n        def m(self): return K, x\n    del K\n",
]


def global_names_by_symtable(source):
    found = set()

    def visit(table):
        if table.get_type() in ("function", symtable.SymbolTableType.FUNCTION):
            for s in table.get_symbols():
                if s.is_referenced() or s.is_assigned():
                    if s.is_global():
                        found.add((table.get_lineno(), table.get_name(), s.get_name()))
        for child in table.get_children():
            visit(child)

    visit(symtable.symtable(source, "f", "exec"))
    return {f for f in found if f[1] not in ("listcomp", "genexpr", "dictcomp", "setcomp", "lambda")}


@pytest.mark.parametrize("source", SNIPPETS)
def test_globals_are_those_of_the_symbol_table(source):
    tree = ast.parse(source)
    scopes = Scopes(tree)
    # Comprehensions and lambdas have tables of their own; here the names that stand in functions themselves are compared.
    functions = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    for function in functions:
        inner = {n.id for b in function.body for n in direct(b)}
        lines = {n.lineno for b in function.body for n in direct(b)}
        wanted = {n for at, f, n in global_names_by_symtable(source) if f == function.name and at <= min(lines, default=at)}
        mine = {name for name, _, line, s in scopes.names
                if name in inner and line in lines and scopes.scopes[s].kind == "function" and scopes.meaning(name, s) == MODULE}
        assert mine == wanted & inner, function.name


def direct(node):
    """Names that stand in a function itself, not in what is nested there."""
    if isinstance(node, ast.Name):
        yield node
    if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef | ast.Lambda | ast.ListComp | ast.SetComp
                      | ast.DictComp | ast.GeneratorExp):
        for child in ast.iter_child_nodes(node):
            yield from direct(child)


def lines_of(source, name):
    return [line for n, dotted, line, _, scope in Scopes(ast.parse(source)).uses() if n == name and not dotted and scope == MODULE]


def test_a_class_body_reads_the_outer_name_until_it_binds_its_own():
    assert lines_of("x = 1\nclass C:\n    x = x\n    y = x\n    z = [x for _ in y]\n", "x") == [1, 3, 5]


def test_comprehensions_read_their_first_source_outside():
    assert lines_of("r = [\n x\n for x in\n x\n if x]\n", "x") == [4]


def test_attributes_know_the_name_in_front():
    uses = Scopes(ast.parse("import m\nm.a\ndef f(m):\n    m.a\n    m.b[0]().a\n    g().a\n")).uses()
    assert [(line, base, scope == MODULE) for n, dotted, line, base, scope in uses if n == "a" and dotted] == [
        (2, "m", True), (4, "m", False), (5, "m", False), (6, "g", True)]


def test_deep_expressions_are_read():
    assert lines_of("x = " + " + ".join(["y"] * 900) + "\n", "y") == [1]


def test_imports_inside_functions_stay_there(spark, files_of):
    files = files_of({
        "lib.py": "class K: pass\n",
        "a.py": "def f():\n    from lib import K\n    return K\nK\n",
        "b.py": "from a import K\nK\n",
        "c.py": "def f():\n    from lib import K\n    def g(): return K\n    return g\ndef h(K): return K\n",
    })
    asked = spark.createDataFrame([(1, "K", "lib.py")], "req_id long, symbol string, path string")
    rows = resolved.resolved_references(files, asked).collect()
    assert {(r.path, r.line_no) for r in rows} == {("lib.py", 1), ("a.py", 2), ("a.py", 3), ("c.py", 2), ("c.py", 3)}


def test_nested_definitions_count_in_their_scope(spark, files_of):
    files = files_of({"m.py": "def f():\n    def inner(): pass\n    return inner\n\ndef g(inner):\n    return inner\n\ninner = 1\n"})
    asked = spark.createDataFrame([(1, "inner", "m.py")], "req_id long, symbol string, path string")
    assert {r.line_no for r in resolved.resolved_references(files, asked).collect()} == {2, 3}


def test_modules_are_found_by_place(spark, join_way):
    paths = ["p/a.py", "p/a/__init__.py", "src/b/c.py", "q/src/b/c.py", "d/__init__.py", "x/a.py", "a.py"]
    places = resolved.module_places(spark.createDataFrame([(p,) for p in paths], "path string"))
    wanted = spark.createDataFrame(
        [("p/", "a"), ("q/r/", "b.c"), ("z/", "b.c"), ("d/", "."), ("d/e/", ".."), ("", "a"), ("x/y/", "..a"), ("p/", "os.path")],
        "dir string, module string")
    found = {(r.dir, r.module): r.target for r in resolved.resolve_modules(wanted, places).collect()}
    assert found == {("p/", "a"): "p/a.py", ("q/r/", "b.c"): "q/src/b/c.py", ("z/", "b.c"): "src/b/c.py", ("d/", "."): "d/__init__.py",
                     ("d/e/", ".."): "d/__init__.py", ("", "a"): "a.py", ("x/y/", "..a"): "x/a.py"}
