import pytest

from codescope.plans import lookup, views

TS = r'''/** License */
import { A, B } from "./base";
import def from './x'
import type { T } from "t"
import fs = require("fs")
const path = require("path");
const lazy = () => { return require("lazy") }
import("./dynamic").then(m => m)

/**
 * A shape.
 * @deprecated
 */
export interface Shape<T> extends Base {
  name: string;
  size?: number
  [key: string]: any
  area(x: number): number;
  opts: { a: string; b: Map<string, number> };
}
type Alias = string | { a: number };
export type Fn<T> = (x: T) => void
enum Color { Red, Green }

/** Main class. */
@Component({ selector: "x{" })
export default abstract class Foo<T> extends Bar<{ x: 1 }> implements Q
{
  private readonly x: number = 5;
  static handler = (e) => { if (e) { return 1 } };
  y
  /** Makes it. */
  constructor(private a: string, b = "}") {
    super();
  }
  /** Does it.
   * more */
  @Dec() async doIt(p: Promise<string>): Promise<{ ok: boolean }> {
    const t = `a ${p} {`;
    // comment }
    return { ok: /[}"]/.test(t) };
  }
  get size(): number { return 1 }
  abstract foo(): void;
  *gen() { yield 1 }
}
class {
}
/** Fun. */
export async function go(a: string, b?: number): Promise<void> {
  const inner = () => {};
}
function noTypes(a, b) { return a + b }
export const arrow = async (x: number): Promise<void> => {
  await x;
}, second = function () {}, third = 3
let typed: (x: number) => string = (x) => `${x}`
var one = y => y
const m: Map<string, number> = new Map(),
  q = 1
'''
SVELTE = "<p>x</p>\n<script lang='ts'>\nlet a = 1;\nexport function f() {}\n</script>\n<script>let b</script>"


@pytest.fixture
def files(files_of):
    return files_of({"a.ts": TS, "b.svelte": SVELTE, "c.js": "", "d.svelte": "<p>no script</p>", "e.tsx": TS.replace("\n", "\r\n")})


def shown(view, files):
    return {r.path: r.view for r in view(files).collect()}


def test_structure(files):
    got = shown(views.structure, files)
    assert got["a.ts"].split("\n") == [
        "Shape", "Alias", "Fn", "Foo", "  constructor", "  doIt", "  foo", "  gen", "  x", "  handler", "  y",
        "(anonymous)", "go", "noTypes", "lazy", "arrow", "second", "typed", "one",
    ]
    assert got["e.tsx"] == got["a.ts"]
    assert got["b.svelte"] == "f"
    assert got["c.js"] == got["d.svelte"] == "(no symbols found)"


def test_skeleton(files):
    got = shown(views.skeleton, files)
    assert got["a.ts"] == (
        "interface Shape {\n  name: string\n  size: number\n  opts: { a: string; b: Map<string, number> }\n}\n\n"
        'class Foo {\n  /** Main class. */\n  constructor(private a: string, b = "}")\n'
        "  async doIt(p: Promise<string>): Promise<{ ok: boolean }>\n    /** Does it. */\n  foo(): void\n  gen()\n}\n\n"
        "class (anonymous) {\n}\n\n"
        "async function go(a: string, b?: number): Promise<void>\n  /** Fun. */\nfunction noTypes(a, b)"
    )


def test_labelled_structure(files):
    got = shown(lambda f: views.structure(f, labels=True), files)
    assert got["a.ts"].split("\n") == [
        "[Interface] Shape", "Alias", "Fn", "[Class] Foo", "  [Constructor] constructor", "  [Method] doIt", "  [Method] foo",
        "  [Method] gen", "[Class] (anonymous)", "[Function] go", "[Function] noTypes", "lazy", "arrow", "second", "typed", "one",
    ]
    assert got["c.js"] == "(no symbols found)"


def test_lines_of_declarations(files):
    got = shown(lambda f: views.skeleton(f, as_written=True), files)
    assert got["a.ts"].startswith("export interface Shape<T> extends Base {\n\ntype Alias = string | { a: number };\n\n")
    assert got["a.ts"].endswith(
        "class {\n\nexport async function go(a: string, b?: number): Promise<void> {\n\nfunction noTypes(a, b) { return a + b }")
    assert got["e.tsx"] == got["a.ts"]
    assert got["c.js"] == "(no symbols found)"


def test_only_some_kinds(files_of):
    files = files_of({"a.ts": "function f() {}", "b.py": "def g(): pass", "c.json": "{}", "d.rb": "x"})
    for view in (views.structure, views.skeleton, views.imports):
        assert {r.path for r in view(files, kinds=["python", "script"]).collect()} == {"a.ts", "b.py"}


def test_imports(files):
    got = shown(views.imports, files)
    assert got["a.ts"].split("\n") == [
        'import { A, B } from "./base";', "import def from './x'", 'import type { T } from "t"',
        'const path = require("path");', 'const lazy = () => { return require("lazy") }',
    ]
    assert got["c.js"] == "(no imports)"


def test_bodies(spark, files, join_way):
    names = ["Foo", "go", "q", "Shape", "second", "noTypes", "Alias", "doIt", "number"]
    requests = [(i, "a.ts", n) for i, n in enumerate(names)] + [(90, "b.svelte", "f"), (91, "b.svelte", "b")]
    frame = spark.createDataFrame(requests, "req_id long, path string, name string")
    rows = {(r.path, r.name): r for r in lookup.symbol_body(files, frame).collect()}
    body = {name: rows["a.ts", name].result for name in names}
    assert body["Foo"].startswith('@Component({ selector: "x{" })\nexport default abstract class Foo')
    assert body["Foo"].endswith("*gen() { yield 1 }\n}")
    assert body["go"] == TS[TS.index("export async function go") : TS.index("\nfunction noTypes")]
    assert body["q"] == "const m: Map<string, number> = new Map(),\n  q = 1"
    assert body["Shape"] == TS[TS.index("export interface") : TS.index("\ntype Alias")]
    assert body["second"].startswith("export const arrow") and body["second"].endswith("third = 3")
    assert body["noTypes"] == "function noTypes(a, b) { return a + b }"
    assert body["Alias"] is body["doIt"] is body["number"] is None
    assert rows["a.ts", "Alias"].message == "Symbol 'Alias' not found in a.ts"
    assert rows["b.svelte", "f"].result == "export function f() {}"
    assert rows["b.svelte", "b"].status == "symbol_not_found"


def test_later_kind_and_place_win(spark, files_of):
    text = "const X = 1;\nclass X {}\nfunction X() { return 1 }\nfunction X() { return 2 }\nclass Y {}\nfunction Y() {}\n"
    frame = spark.createDataFrame([(1, "m.ts", "X"), (2, "m.ts", "Y")], "req_id long, path string, name string")
    rows = {r.name: r.result for r in lookup.symbol_body(files_of({"m.ts": text}), frame).collect()}
    assert rows == {"X": "const X = 1;", "Y": "function Y() {}"}


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("export const a = () =>\n  1\nexport const b = 2\n", "a"),
        ("const s = 'it\\'s {'\nfunction f() {}\n", "f"),
        ("const r = /[{]/g\nfunction f() {}\n", "f"),
        ("/* { */ function f() {} // {\nfunction g() {}", "f\ng"),
        ("if (x) {\n  function hidden() {}\n} else {\n}\nfunction f() {}\n", "f"),
        ("foo({\n  a: () => 1\n})\nvar f = function () {}\n", "f"),
        ("class A { static { init() } #p = 1; set v(x) {} m<T>(x: T): T { return x } 'quoted'() {} }", "A\n  m\n  'quoted'\n  #p"),
        ("function f(): { a: number } {\n  return { a: 1 }\n}\nfunction g() {}\n", "f\ng"),
        ("export default function () {}\nfunction f() {}", "f"),
        ("export default function main() {}\n", "main"),
        ("x = `${a}\n{`\nfunction f() {}", "f"),
        ("namespace N { function inner() {} }\nfunction f() {}", "f"),
    ],
)
def test_small_texts(files_of, text, wanted):
    assert views.structure(files_of({"m.ts": text})).first().view == wanted


def test_long_comments_and_blanks_are_passed_once():
    import time

    from codescope.operators.script_symbols import _scan_one

    line = " * a line of a comment that says something\n"
    began = time.time()
    for text in ("/*\n" + line * 20_000 + "*/\nclass A {}\n", "@Dec()\n/*\n" + line * 20_000 + "*/\nclass A {}\n",
                 "class A {\n" + "// x\n" * 20_000 + "m() {}\n}\n", "let a =\n" + "\n" * 200_000 + "1\n"):
        assert len(_scan_one(text)) == 1
    assert time.time() - began < 8
