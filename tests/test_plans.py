"""The shape of physical plans: what is shuffled, what is broadcast, how often files are parsed."""

import re

import pytest
from pyspark.sql import functions as F

from codescope.operators import references
from codescope.plans import joins, lookup, report, views


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A stored corpus, so that plans start at a parquet scan."""
    from codescope.sources.corpus import classify_files

    location = str(tmp_path_factory.mktemp("corpus") / "files")
    texts = {f"d{i % 5}/m{i}.py": f"import os\nclass K{i}:\n    def f(self): pass\n" for i in range(50)}
    texts |= {"a.ts": "function f() {}\n", "b.json": "{}", "c.yml": "a: 1", "Dockerfile": "FROM x\n"}
    classify_files(spark.createDataFrame(list(texts.items()), "path string, text string")).write.parquet(location)
    return spark.read.parquet(location)


@pytest.fixture
def requests(spark):
    rows = [(i, f"d{i % 5}/m{i}.py", f"K{i}") for i in range(10)]
    return spark.createDataFrame(rows, "req_id long, path string, name string")


def plan(frame):
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text
    return text


@pytest.mark.parametrize("view", [views.structure, views.skeleton, views.imports])
def test_views_parse_once_and_do_not_shuffle(corpus, view):
    text = plan(view(corpus))
    assert "Exchange" not in text
    assert text.count("ArrowEvalPython") == 1
    assert len(re.findall(r"FileScan parquet", text)) == 1
    assert "language" not in text  # columns that no view needs are not read


def test_search_is_one_narrow_scan(corpus):
    text = plan(references.find_references(corpus, "K1"))
    assert "Exchange" not in text
    assert "StringContains(text,K1)" in text


def test_bulk_search_broadcasts_only_small_lists(spark, corpus, monkeypatch):
    symbols = spark.createDataFrame([(f"K{i}",) for i in range(20)], "symbol string")
    few = plan(references.find_references_bulk(corpus, symbols))
    assert "BroadcastHashJoin" in few and "hashpartitioning(symbol" not in few.split("BroadcastExchange")[0]
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = plan(references.find_references_bulk(corpus, symbols))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in many and re.search(r"hashpartitioning\(symbol#\d+, _salt#\d+", many)


def test_lookup_of_few_files_reaches_the_scan(corpus, requests):
    text = plan(lookup.symbol_body(corpus, requests))
    assert re.search(r"PushedFilters: \[[^]]*In\(path", text)
    assert text.count("ArrowEvalPython") == 1


def test_large_request_lists_are_salted(spark, corpus, requests, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(joins, "INLINE_PATHS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(lookup.symbol_body(corpus, requests))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in text
    assert re.search(r"hashpartitioning\(path#\d+, _salt#\d+", text)


def test_hot_path_is_spread(spark, corpus, monkeypatch):
    """A third and more of all requests name one file; their answers are whole."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
    hot = spark.range(2000).select(
        F.col("id").alias("req_id"), F.lit("d1/m1.py").alias("path"),
        F.when(F.col("id") % 2 == 0, "K1").otherwise(F.concat(F.lit("no"), "id")).alias("name"),
    )
    cold = spark.range(2000, 2050).select(
        F.col("id").alias("req_id"), F.concat(F.lit("d9/m"), "id", F.lit(".py")).alias("path"), F.lit("K").alias("name")
    )
    status = lookup.symbol_body(corpus, hot.unionByName(cold)).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in status} == {"ok": 1000, "symbol_not_found": 1000, "not_found": 50}


def test_report_shuffles_only_sums(corpus):
    text = plan(report.view_cost_report(corpus))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_sum" in text
    assert text.count("ArrowEvalPython") == 1


def test_many_bodies_in_one_file_are_measured_in_proportion(files_of):
    import time

    files = files_of({"big.py": "".join(f"def f{i}(a, b):\n    return a + b\n" for i in range(24_000))})
    began = time.time()
    (row,) = report.view_sizes(files).where("view = 'symbol_body'").collect()
    assert (row.n_views, row.pieces) == (24_000, 24_000 * 12)
    assert row.chars == sum(len(f"def f{i}(a, b):\n    return a + b") for i in range(24_000))
    assert time.time() - began < 30


def test_many_requests_meet_the_texts_in_one_join(spark, corpus, requests, monkeypatch):
    """What is parsed is not shuffled, unless very many requests name one file; answers are the same in both ways."""
    asked = requests.union(requests.limit(3)).union(spark.createDataFrame(
        [(90, "gone.py", "K"), (91, "b.json", "a"), (92, "Dockerfile", "from"), (93, "d1/m1.py", None)], requests.schema))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(joins, "MANY_PATHS", 0, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lookup.symbol_body(corpus, asked)
        text = plan(found)
        above = text[: text.index("ArrowEvalPython")]
        assert "Exchange" not in above and "_salt" not in above
        rows = sorted(map(str, found.collect()))
        monkeypatch.setattr(joins, "PATH_REQUESTS", 0)
        assert rows == sorted(map(str, lookup.symbol_body(corpus, asked).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 17


def test_pieces_of_plain_and_other_texts(spark):
    texts = ["", "a_1 b.c", "x\x0b\x1c\x7f\x00y", "tab\tnew\n\r\f.", "naïve café—ok", "２ ² 漢字", "\u00a0 a"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    both = frame.select(report._pieces(F.col("t")).alias("n"), F.regexp_count("t", F.lit(report.PIECE)).alias("m")).collect()
    assert [r.n for r in both] == [r.m for r in both]


def test_tasks_of_a_long_request_list_are_as_many_as_its_files_need(spark, files_of, monkeypatch):
    from codescope.plans import joins, lookup

    files = files_of({f"p/{n}.py": f"def f{n}(): pass\n" for n in range(60)} | {"p/none.py": "def f(:\n"})
    asked = [(n, f"p/{n % 50}.py", f"f{n % 50}") for n in range(100)] + [(100, "p/gone.py", "f"), (101, None, "f"), (102, "p/none.py", "f")]
    requests = spark.createDataFrame(asked, "req_id long, path string, name string")
    views = {"structure": requests.drop("name"), "symbol_body": requests.where("path IS NOT NULL")}
    wanted = {v: sorted(lookup.batch_lookup(files, r, v).collect(), key=repr) for v, r in views.items()}
    monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(joins, "MANY_PATHS", 10)
    monkeypatch.setattr(joins, "TASK_PATHS", 4)
    together = joins.with_requests(files, requests.drop("name"))
    assert together.count() == 51 and together.rdd.getNumPartitions() == 13  # 52 paths are named
    for view, listed in views.items():
        assert sorted(lookup.batch_lookup(files, listed, view).collect(), key=repr) == wanted[view]
    assert [r.result for r in wanted["structure"] if r.req_id == 53] == ["f3"]
