"""Long request lists: what is read, parsed and shuffled for them, and that the answers stay the same."""

import pyarrow as pa
import pytest

from codescope.functions import batches
from codescope.operators import config_files, python_symbols, script_symbols
from codescope.plans import joins, lookup

FILES = {
    "a.py": "import os\nclass K:\n    def run(self): pass\n    def go(self): return 1\n\ndef run(): pass\nif 1:\n    def late(): pass\n",
    "b.py": "def run(:\n",
    "c.ts": "export class K { go() { return 1; } }\nconst one = 1, run = () => 2;\nlet gl<string>ue = 1;\n// nowhere\n",
    "d.json": '{"k": {"a": [1]}, "run": 2, "1": null}',
    "e.yml": "run: {b: 1}\n1: x\nk: [1, 2]\n",
    "Dockerfile": "FROM x AS run\nENV A=1\n",
    "f.rb": "run",
}
NAMES = ["run", "K", "late", "go", "one", "glue", "nowhere", "k", "1", "env", "", None]


@pytest.fixture
def corpus(spark, tmp_path):
    from codescope.sources.corpus import classify_files

    location = str(tmp_path / "files")
    classify_files(spark.createDataFrame(list(FILES.items()), "path string, text string")).write.parquet(location)
    return spark.read.parquet(location)


@pytest.fixture
def long_lists(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(joins, "MANY_PATHS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def requests_of(spark, times=1):
    asked = [(path, name) for path in [*FILES, "gone.py"] for name in NAMES for _ in range(times)]
    return spark.createDataFrame([(n, *a) for n, a in enumerate(asked)], "req_id long, path string, name string")


def rows(frame):
    return sorted(map(str, frame.collect()))


@pytest.mark.parametrize("view", ["symbol_body", "symbol_card", "locate", "structure"])
def test_answers_are_those_of_short_lists(spark, corpus, view, monkeypatch):
    requests = requests_of(spark, 3).union(requests_of(spark).limit(5))
    requests = requests.drop("name").union(requests.limit(1).selectExpr("req_id", "null")) if view == "structure" else requests
    wanted = rows(lookup.batch_lookup(corpus, requests, view))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(joins, "MANY_PATHS", 0)
    for most in (1_000, 4):
        monkeypatch.setattr(joins, "PATH_REQUESTS", most)
        monkeypatch.setattr(joins, "SALTS", 3)
        assert rows(lookup.batch_lookup(corpus, requests, view)) == wanted


def test_a_file_that_very_many_requests_name_is_no_reason_to_shuffle_what_is_parsed(spark, corpus, long_lists, monkeypatch):
    monkeypatch.setattr(joins, "PATH_REQUESTS", 10)
    requests = requests_of(spark, 20)
    asked = lookup._asked(requests, "name").drop("req_id")
    met = joins.with_requests(corpus.select("path", "text"), asked, "left").selectExpr("path", "size(_asked) AS n", "_there").collect()
    assert sum(r.n for r in met) == 20 * len(NAMES) * 8 and max(r.n for r in met) <= 4 * 10
    assert {r.path for r in met if r._there is None} == {"gone.py"}
    text = lookup.symbol_body(corpus, requests)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text[: text.index("ArrowEvalPython")]


def test_requests_that_nothing_tells_apart_are_salted(spark, corpus, long_lists, monkeypatch):
    requests = spark.range(200).selectExpr("7L AS req_id", "'a.py' AS path", "'run' AS name")
    monkeypatch.setattr(joins, "PATH_REQUESTS", 10)
    assert joins.with_requests(corpus, lookup._asked(requests, "name").drop("req_id"), "left") is None
    assert [(r.status, r.result) for r in lookup.symbol_body(corpus, requests).distinct().collect()] == [("ok", "def run(): pass")]


def test_the_corpus_is_read_once(spark, corpus, long_lists):
    """Missing files are told by the join that brings the requests to the texts."""
    for view, requests in (("symbol_body", requests_of(spark)), ("structure", requests_of(spark).drop("name"))):
        text = lookup.batch_lookup(corpus, requests, view)._jdf.queryExecution().executedPlan().toString()
        assert text.count("FileScan parquet") == 1


def test_parsers_work_out_only_what_is_asked_for():
    source = FILES["a.py"]
    _, symbols, imports, _ = python_symbols._parse_one(source, True)
    firsts = [s for s in symbols if s[10]]
    assert python_symbols._parse_one(source, True, False, ["run", "late", None]) == (
        None, [s for s in firsts if s[2] in ("run", "late")], [], [])
    assert imports and sorted(python_symbols._defined_one(source)) == sorted((s[2], s[8]) for s in firsts)
    assert python_symbols._defined_one(FILES["b.py"]) == []
    whole = [(r[0], r[1], r[4]) for r in script_symbols._scan_one(FILES["c.ts"])]
    assert [(r[0], r[1], r[4]) for r in script_symbols._outlines(FILES["c.ts"])] == whole and len(whole) == 3
    assert [(r[0], r[1], r[4]) for r in script_symbols._outlines(FILES["c.ts"], ["one", None])] == whole[1:]  # the last is glued
    assert script_symbols._outlines("class A {}\nlet b = 1;\n", ["zz", None]) == []
    (_, _, _, _, entries) = config_files._parse_one(FILES["d.json"], "json", True, ["k", None])
    assert [(e[1], e[5], e[6]) for e in entries] == [("k", None, '{\n  "a": [\n    1\n  ]\n}'), ("run", None, None), ("1", None, None)]


def test_names_are_handed_to_parsers_as_text(corpus):
    """For every row added to a batch Spark sums up its size, which takes as long as the batch has rows for array columns."""
    from pyspark.sql import functions as F

    from codescope.plans import views

    names = F.array(F.lit("run"), F.lit(None), F.lit('"\\'), F.col("name"))
    handed = corpus.select(batches.written(names, F.col("kind").isNotNull()).alias("n"))
    assert handed.schema["n"].dataType.simpleString() == "string"
    back = batches.read_back(pa.array([r.n for r in handed.collect()], pa.string()))
    assert ["run", None, '"\\', "a.py"] in back and None in back
    parsed = views.with_parsed(corpus, names=names)
    assert {r.path: [s.name for s in r.parsed.symbols] for r in parsed.where("kind = 'python'").collect()} == {"a.py": ["run"], "b.py": []}
