"""Requests that name no file."""

import pytest

from codescope.plans import definitions, lookup

FILES = {
    "b/one.py": "class Alpha:\n    def run(self): pass\n\ndef run(): return 1\n",
    "a/two.py": "class Beta:\n    def run(self): return 2\n",
    "a/zed.py": "def run(): return 3\n",
    "c/broken.py": "def run(:\n",
    "c/w.ts": "export function load$it() { return 1; }\nconst run2 = 1, other = 2;\nclass Alpha {}\n",
    "c/d.json": '{"k": 1, "a-b": [2]}',
    "c/Dockerfile": "FROM x AS run\nENV A=1\nCOPY k .\n",
    "c/uni.py": "def ﬁn(): pass\n",
    "c/note.txt": "run Alpha",
}


def answers(frame):
    return {(r.req_id, r.path): (r.status, r.result) for r in frame.collect()}


@pytest.fixture
def corpus(files_of):
    return files_of(FILES)


def requests_of(spark, names, columns="req_id long, path string, name string"):
    return spark.createDataFrame(names, columns)


def test_outer_definitions_come_first_and_then_paths(spark, corpus, join_way):
    asked = [(1, None, "run"), (2, None, "Alpha"), (3, None, "load$it"), (4, None, "a-b"), (5, None, "env"), (6, None, "missing"),
             (7, "b/one.py", "run"), (8, None, "fin"), (9, None, None), (10, None, "other"), (11, None, "")]
    found = answers(lookup.batch_lookup(corpus, requests_of(spark, asked), "symbol_body"))
    assert found == {
        (1, "a/zed.py"): ("ok", "def run(): return 3"),
        (2, "b/one.py"): ("ok", "class Alpha:\n    def run(self): pass"),
        (3, "c/w.ts"): ("ok", "export function load$it() { return 1; }"),
        (4, "c/d.json"): ("ok", "[\n  2\n]"),
        (5, "c/Dockerfile"): ("ok", "ENV A=1"),
        (6, None): ("symbol_not_found", None),
        (7, "b/one.py"): ("ok", "def run(): return 1"),
        (8, "c/uni.py"): ("ok", "def ﬁn(): pass"),
        (9, None): ("symbol_not_found", None),
        (10, "c/w.ts"): ("ok", "const run2 = 1, other = 2;"),
        (11, None): ("symbol_not_found", None),
    }


def test_more_than_one(spark, corpus):
    asked = requests_of(spark, [(1, None, "run"), (2, None, "run"), (3, None, "Alpha")])
    found = answers(lookup.symbol_body(corpus, asked, top=3))
    assert [p for i, p in found if i == 1] and {p for i, p in found if i == 1} == {p for i, p in found if i == 2}
    assert {p for i, p in found if i == 1} == {"a/zed.py", "b/one.py", "a/two.py"} or {p for i, p in found if i == 1} == {
        "a/zed.py", "b/one.py", "c/Dockerfile"}
    assert {p for i, p in found if i == 3} == {"b/one.py", "c/w.ts"}


def test_cards_and_places_are_of_python_alone(spark, corpus):
    asked = requests_of(spark, [(1, None, "Alpha"), (2, None, "load$it"), (3, None, "run")])
    assert answers(lookup.symbol_card(corpus, asked)) == {
        (1, "b/one.py"): ("ok", "class Alpha"), (2, None): ("symbol_not_found", None), (3, "a/zed.py"): ("ok", "def run()")}
    places = {r.req_id: (r.path, r.line, r.col) for r in lookup.locate_definition(corpus, asked).collect()}
    assert places == {1: ("b/one.py", 0, 6), 2: (None, None, None), 3: ("a/zed.py", 0, 4)}


def test_uses_of_a_definition_found_by_name(spark, files_of):
    files = files_of({
        "lib/shape.py": "class Square: pass\n", "app/use.py": "from shape import Square as S\nx = S()\n",
        "app/other.py": "# Square\n", "lib/__init__.py": "",
    })
    asked = requests_of(spark, [(1, None, "Square"), (2, None, "Gone")])
    hits = lookup.batch_lookup(files, asked, "resolved_references").collect()
    assert {(r.req_id, r.path, r.status, r.result) for r in hits} == {
        (1, "lib/shape.py", "ok", "lib/shape.py:1"), (1, "lib/shape.py", "ok", "app/use.py:1"), (1, "lib/shape.py", "ok", "app/use.py:2"),
        (2, None, "no_references", None)}


def test_all_columns_of_requests_come_back(spark, corpus):
    asked = spark.createDataFrame([(1, "t", None, "run", "x", 5)], "req_id long, text string, path string, name string, _found string, level int")
    (row,) = lookup.symbol_body(corpus, asked).collect()
    assert (row.text, row.path, row._found, row.level, row.result) == ("t", "a/zed.py", "x", 5, "def run(): return 3")


def test_first_definitions_of_a_hot_name_stay_few(spark):
    from codescope.sources.corpus import classify_files

    files = classify_files(spark.range(2000).selectExpr("concat('p/', id, '.py') AS path", "'def main(): pass' AS text"))
    found = definitions.first_definitions(files, spark.createDataFrame([("main",)], "name string"), 2).collect()
    assert [(r.path, r.nth) for r in sorted(found, key=lambda r: r.nth)] == [("p/0.py", 1), ("p/1.py", 2)]
