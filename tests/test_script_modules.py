"""Imports and exports of scripts, the files they mean, and uses of a declaration."""

import pytest

from codescope.operators import script_modules
from codescope.operators.script_symbols import scan_scripts

CLAUSES = """import A from './a'
import B, { c, type D as E, default as F } from "./b";
import * as G from './g'
import type { H } from './h'
import './effect'
import I, * as J from './ij'
export * from './k'
export * as L from './l'
export { m, n as o } from './m'
export { A as P, c }
export default A
export const q = 1, r = 2
export async function s() {}
export abstract class T {}
export interface U { a: 1 }
export type V = string
export enum W { x }
const X = require('./x')
const { y, z: Z } = require("./y").inner
export default class AA {}
import BB from './bb.json' with { type: "json" }
const notThis = "require('./no')"
export default function () {}
let plain = 1
"""


def test_clauses(spark, files_of):
    rows = script_modules.module_clauses(scan_scripts(files_of({"m.ts": CLAUSES}))).collect()
    found = {(r.module, r.name, r.local, r.exported) for r in rows}
    assert found == {
        ("./a", "default", "A", None), ("./b", "default", "B", None), ("./b", "c", "c", None), ("./b", "D", "E", None),
        ("./b", "default", "F", None), ("./g", "*", "G", None), ("./h", "H", "H", None), ("./effect", None, None, None),
        ("./ij", "default", "I", None), ("./ij", "*", "J", None), ("./k", "*", None, "*"), ("./l", "*", None, "L"),
        ("./m", "m", None, "m"), ("./m", "n", None, "o"), (None, "A", None, "P"), (None, "c", None, "c"), (None, "A", None, "default"),
        (None, "q", None, "q"), (None, "r", None, "r"), (None, "s", None, "s"), (None, "T", None, "T"), (None, "U", None, "U"),
        (None, "V", None, "V"), (None, "W", None, "W"), ("./x", "*", "X", None), ("./y", "y", "y", None), ("./y", "z", "Z", None),
        (None, "AA", None, "default"), ("./bb.json", "default", "BB", None),
    }


def test_relative_modules(spark, join_way):
    paths = ["a/x.ts", "a/x.js", "a/d/index.tsx", "b.jsx", "a/c.svelte", "a/y.ts", "index.js", "z/x.d.ts"]
    wanted = [("a/", "./x"), ("a/", "./x.js"), ("a/", "./d"), ("a/b/", "../../b"), ("a/", "./c.svelte"), ("a/", "./y.js"), ("a/", ".."),
              ("", "../up"), ("a/", "react"), ("a/", "./gone"), ("a/", "./d/./../x.ts")]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    found = script_modules.resolve_script_modules(spark.createDataFrame(wanted, "dir string, module string"), files).collect()
    assert {(r.dir, r.module): r.target for r in found} == {
        ("a/", "./x"): "a/x.ts", ("a/", "./x.js"): "a/x.js", ("a/", "./d"): "a/d/index.tsx", ("a/b/", "../../b"): "b.jsx",
        ("a/", "./c.svelte"): "a/c.svelte", ("a/", "./y.js"): "a/y.ts", ("a/", ".."): "index.js", ("a/", "./d/./../x.ts"): "a/x.ts"}


CORPUS = {
    "core.ts": "export class K { go() { return K; } }\nexport default K;\nconst hidden = 1;\nhidden;\n",
    "a.ts": "import { K as Q } from './core'\nnew Q(); // Q\n'Q'\nx.Q\n",
    "b.ts": "import Def from './core.js'\nDef\nK\n",
    "c.ts": "import * as all from './core'\nall.K; all.other; K\n",
    "relay.ts": "export * from './core'\nexport { K as Z } from './core'\n",
    "far.ts": "export * from './relay'\n",
    "d.ts": "import { K, Z } from './far'\nK; Z\n",
    "cycle1.ts": "export * from './cycle2'\nimport { K } from './core'\nexport { K }\n",
    "cycle2.ts": "export * from './cycle1'\n",
    "e.ts": "import { K } from './cycle2'\nK\n",
    "stranger.ts": "import { K } from './elsewhere'\nK\n",
    "elsewhere.ts": "export const K = 1\n",
    "page.svelte": "<script>\nimport { K } from './core'\nK\n</script>\n<p>K</p>\n",
    "f.js": "const { K } = require('./core'), n = K\nmodule.K\n",
}


def test_uses_follow_the_module_graph(spark, files_of, join_way):
    asked = spark.createDataFrame([(1, "K", "core.ts"), (2, "hidden", "core.ts"), (3, "K", "elsewhere.ts"), (4, "gone", "core.ts"),
                                   (5, None, "core.ts"), (6, "K", None), (7, "K", "core.ts")], "req_id long, symbol string, path string")
    rows = script_modules.script_resolved_references(files_of(CORPUS), asked).collect()
    by = {i: {(r.path, r.line_no) for r in rows if r.req_id == i and r.status == "ok"} for i in range(1, 8)}
    assert by[1] == {
        ("core.ts", 1), ("core.ts", 2), ("a.ts", 1), ("a.ts", 2), ("b.ts", 1), ("b.ts", 2), ("c.ts", 2), ("relay.ts", 2), ("d.ts", 1), ("d.ts", 2),
        ("cycle1.ts", 2), ("cycle1.ts", 3), ("e.ts", 1), ("e.ts", 2), ("page.svelte", 2), ("page.svelte", 3), ("f.js", 1)}
    assert by[7] == by[1]
    assert by[2] == {("core.ts", 3), ("core.ts", 4)}
    assert by[3] == {("elsewhere.ts", 1), ("stranger.ts", 1), ("stranger.ts", 2)}
    assert {r.req_id for r in rows if r.status == "no_references"} == {4, 5, 6}


def test_nothing(spark, files_of):
    none = spark.createDataFrame([], "req_id long, symbol string, path string")
    assert script_modules.script_resolved_references(files_of(CORPUS), none).count() == 0
    asked = spark.createDataFrame([(1, "K", "m.ts")], none.schema)
    assert [r.status for r in script_modules.script_resolved_references(files_of({"m.ts": None, "n.ts": ""}), asked).collect()] == [
        "no_references"]
