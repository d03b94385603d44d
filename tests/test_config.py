import datetime
import json

import pytest
import yaml

from codescope.operators import config_files
from codescope.plans import lookup, views

JSON = {
    "a.json": '{"b": 1, "a": "x", "b": [1, {"k": "é"}], "n": null, "f": 1.50, "t": true, "e": 1e22, "q": "it\'s", "d": {}}',
    "empty.json": "{}",
    "list.json": "[1, 2, 3]",
    "text.json": json.dumps("y" * 300),
    "nan.json": '{"x": NaN, "y": -Infinity}',
    "bad.json": "{'a': 1}",
    "bom.json": "﻿{}",
    "lone.json": '{"k": "\\ud800", "\\udfff": 1}',
}
YAML = {
    "a.yml": "on: yes\nwhen: 2020-01-02\nx: &anchor {b: 1, a: [1]}\ny: *anchor\n7: one\nlong: " + "z" * 100 + "\n",
    "empty.yaml": "",
    "list.yaml": "- 1\n- 2\n",
    "bad.yaml": "a: [",
    "tag.yaml": "a: !include other.yml\n",
    "many.yaml": "a: 1\n---\nb: 2\n",
}


def preview(value):
    if isinstance(value, dict):
        return "{...} (%d keys)" % len(value)
    if isinstance(value, list):
        return "[...] (%d items)" % len(value)
    text = repr(value)
    return text if len(text) <= 80 else text[:80] + "…"


@pytest.fixture
def shown(files_of):
    def run(texts, view):
        return {r.path: r.view for r in view(files_of(texts)).collect()}

    return run


def test_json_structure(shown):
    got = shown(JSON, views.structure)
    assert got["a.json"] == "b\na\nn\nf\nt\ne\nq\nd"
    assert got["empty.json"] == "(empty object)"
    assert got["list.json"] == "(array of 3 items)"
    assert got["text.json"] == "str"
    assert got["nan.json"] == "x\ny"
    assert got["bad.json"].startswith("JSON parse error in bad.json: Expecting property name")
    assert got["bom.json"].startswith("JSON parse error in bom.json: Unexpected UTF-8 BOM")
    assert got["lone.json"] == "k\n\\udfff"


def test_json_skeleton(shown):
    got = shown(JSON, views.skeleton)
    assert got["a.json"] == "\n".join(f"{k}: {preview(v)}" for k, v in json.loads(JSON["a.json"]).items())
    assert got["empty.json"] == ""
    assert got["text.json"] == repr("y" * 300)[:200]
    assert got["nan.json"] == "x: nan\ny: -inf"


def test_yaml_views(shown):
    got = shown(YAML, views.skeleton)
    wanted = yaml.safe_load(YAML["a.yml"])
    assert wanted["when"] == datetime.date(2020, 1, 2)
    assert got["a.yml"] == "\n".join(f"{k}: {preview(v)}" for k, v in wanted.items())
    assert got["empty.yaml"] == "None"
    structure = shown(YAML, views.structure)
    assert structure["a.yml"] == "True\nwhen\nx\ny\n7\nlong"
    assert structure["empty.yaml"] == "NoneType"
    assert structure["list.yaml"] == "(array of 2 items)"
    for path in ("bad.yaml", "tag.yaml", "many.yaml"):
        assert structure[path].startswith(f"YAML parse error in {path}: ")


def test_values_by_key(spark, files_of, join_way):
    data, mapping = json.loads(JSON["a.json"]), yaml.safe_load(YAML["a.yml"])
    wanted = {("a.json", k): json.dumps(v, indent=2) for k, v in data.items()}
    wanted |= {("a.yml", str(k)): yaml.dump(v, default_flow_style=False).rstrip() for k, v in mapping.items()}
    misses = {
        ("a.json", "nope"): "Key 'nope' not found. Top-level keys: b, a, n, f, t, e, q, d",
        ("list.json", "a"): "Cannot look up key 'a': root is not an object",
        ("list.yaml", "a"): "Cannot look up key 'a': root is not a mapping",
        ("gone.json", "a"): "File not found: gone.json",
    }
    requests = [(i, *key) for i, key in enumerate([*wanted, *misses])]
    rows = lookup.batch_lookup(
        files_of(JSON | YAML), spark.createDataFrame(requests, "req_id long, path string, name string"), "symbol_body"
    ).collect()
    assert len(rows) == len(requests)
    assert {(r.path, r.name): r.result for r in rows if r.status == "ok"} == wanted
    assert {(r.path, r.name): r.message for r in rows if r.status != "ok"} == misses


def test_imports(shown):
    got = shown(
        {
            "r.json": '{"$ref": "a.json", "x": {"$ref" :\n"b#/c"}, "ref": "no"}',
            "n.json": "{}",
            "a.yml": "# see http://x?a&b\nx: &é1 1\ny: !include  sub/c.yml\nz: !include d\n",
            "n.yml": "a: 1\n",
        },
        views.imports,
    )
    assert got == {
        "r.json": "a.json\nb#/c",
        "n.json": "(no $ref imports)",
        "a.yml": "anchors: b, é1\nincludes: sub/c.yml, d",
        "n.yml": "(no anchors or includes)",
    }


def test_entry_rows(files_of):
    parsed = config_files.parse_config(files_of({"a.json": '{"l": [1], "s": "v"}'}))
    rows = config_files.config_entries(parsed).orderBy("ord").collect()
    assert [(r.ord, r.key, r.value_type, r.n_children, r.value_json) for r in rows] == [
        (0, "l", "list", 1, "[1]"), (1, "s", "str", None, '"v"'),
    ]
    assert config_files.config_roots(parsed).first().asDict() == {
        "path": "a.json", "root_type": "dict", "n_items": 2, "status": "ok",
    }
