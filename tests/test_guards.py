"""No file ends a job, and none takes its neighbours' answers away."""

import time

import pytest
from pyspark.sql import functions as F

from codescope.operators import config_files, python_symbols, script_symbols
from codescope.plans import lookup, views

BAD_YAML = {
    "bool.yml": "a: !!bool foo", "stamp.yml": "a: !!timestamp foo", "int.yml": 'a: !!int ""', "hex.yml": "a: 0x" + "f" * 5000,
}
ODD_YAML = {
    "loop.yml": "a: &x [*x]\nb: 1", "deep.yml": "a: " + "[" * 400 + "]" * 400 + "\nb: 1",
    "bomb.yml": "\n".join(["a: &a [1, 1]", *[f"{y}: &{y} [*{x}, *{x}, *{x}, *{x}]" for x, y in zip("acdefghij", "cdefghijk")], "b: 1"]),
    "keys.yml": "a: {2020-01-02: x, b: 1}\nb: 1",
}
DEEP = "def f(x=" + "+".join(["1"] * 3000) + "):\n    pass\n\n\ndef g():\n    pass\n"
SOUND = {"good.py": "def f():\n    pass\n", "good.json": '{"a": 1}', "good.yml": "a: 1"}


@pytest.fixture
def mixed(files_of):
    return files_of({**BAD_YAML, **ODD_YAML, "deep.py": DEEP, **SOUND})


def test_every_file_has_a_row(mixed):
    got = {r.path: r for r in views.structure(mixed).collect()}
    assert got.keys() == {*BAD_YAML, *ODD_YAML, "deep.py", *SOUND}
    assert {p for p, r in got.items() if r.status == "parse_error"} >= {"bool.yml", "stamp.yml", "int.yml"}
    assert [got[p].view for p in SOUND] == ["f", "a", "a"]
    assert all(got[p].view.split("\n")[-1] == "b" for p in ODD_YAML)
    assert {r.path for r in views.skeleton(mixed).collect()} == got.keys()


def test_bodies_of_odd_values(spark, mixed):
    paths = [*ODD_YAML, "hex.yml", "good.yml"]
    requests = spark.createDataFrame(
        [(i, p, k) for i, (p, k) in enumerate((p, k) for p in paths for k in "ab")], "req_id long, path string, name string")
    got = {(r.path, r.name): r for r in lookup.symbol_body(mixed, requests).collect()}
    assert all(got[p, "b"].status == "ok" for p in ODD_YAML)
    assert got["good.yml", "a"].status == "ok"
    assert got["deep.yml", "a"].status != "ok" or got["deep.yml", "a"].result


def test_json_of_odd_values(mixed):
    parsed = config_files.parse_config(mixed.where("path in ('keys.yml', 'bomb.yml', 'loop.yml')"))
    got = {(r.path, r.key): r.value_json for r in config_files.config_entries(parsed).collect()}
    assert got["keys.yml", "a"] == '{"2020-01-02":"x","b":1}'
    assert got["bomb.yml", "k"] is None and got["loop.yml", "a"] is None and got["bomb.yml", "a"] == "[1,1]"


def test_signature_that_is_too_deep(mixed):
    table = python_symbols.symbols_table(python_symbols.parse_python(mixed.where("path like '%.py'")))
    got = {(r.path, r.name): r.header for r in table.collect()}
    assert got.keys() in ({("deep.py", "f"), ("deep.py", "g"), ("good.py", "f")}, {("good.py", "f")})
    assert got["good.py", "f"] == "def f(): ..."


@pytest.mark.parametrize("text", ["", "}", ")", "`", "`${", "`${}", "/*", "/", "({`${)", "'", "\\", "`\\", "/[", "`${`${}"])
def test_cut_off_scripts(text):
    bare, code = script_symbols._quieted(text)
    assert len(bare) == len(code) == len(text)
    script_symbols._scan_one(text)


@pytest.mark.parametrize("text", ["`${" * 20_000, "/* " * 50_000, "(a/b)/" * 20_000, "'{" * 50_000, "}`}`)" * 20_000])
def test_odd_scripts_take_linear_time(text):
    began = time.perf_counter()
    script_symbols._scan_one(text)
    assert time.perf_counter() - began < 2


def test_continued_lines_take_linear_time():
    text = "const a = 1\n" + "".join(f"  + value{i}\n" for i in range(20_000)) + "function last() {}\n"
    began = time.perf_counter()
    rows = script_symbols._scan_one(text)
    assert time.perf_counter() - began < 2
    assert len(rows) == 2


@pytest.mark.parametrize(
    "line",
    [
        "return /[{`]/.test(y)", "throw /[`]/", "const q = typeof /{/", "return a / b / c", "if (y) /[{]/.test(y);",
        "while (y) /}/.exec(y)", "const v = (a) / 2 + '/{'", "y.map((q) => /[{]/)", "const o = {a: 1} / 2; const q = '/{'",
        'const a = `x ${y ? `inner {` : ""} y`;', 'const t = `a ${ {x: "}"}.x } { ${`${`{`}`}`', "const e = <Foo {...y} />",
        "/* `{ */", "a = `\\``",
    ],
)
def test_patterns_and_templates_hide_nothing(line):
    rows = script_symbols._scan_one("function a(y) {\n  " + line + "\n}\nfunction b() {}\n")
    assert [r[0] for r in rows] == [0, len("function a(y) {\n  " + line + "\n}\n")]
