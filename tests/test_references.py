import random
import re

import pytest

from codescope.operators import references, resolved
from codescope.operators.lines import file_lines
from codescope.plans import lookup

ALPHABET = "ab_é1 .$->\n\r\tЖ"


@pytest.fixture(scope="module")
def random_texts():
    rng = random.Random(7)
    texts = {f"f{i}.txt": "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for i in range(300)}
    return texts | {"empty.txt": "", "nl.txt": "\n", "crlf.txt": "a\r\nb\ra\n"}


def lines_of(text):
    return re.sub("\r\n?", "\n", text).removesuffix("\n").split("\n") if text else []


def brute_force(texts, symbol):
    pattern = re.compile(r"\b" + re.escape(symbol) + r"\b")
    return {(path, n) for path, text in texts.items() for n, line in enumerate(lines_of(text), 1) if pattern.search(line)}


SYMBOLS = ["a", "ab", "é", "a.b", "$a", "a$", "->", ".", "", "_", "Ж", "a b", "-", "1", r"\E", "$"]


def test_lines(files_of, random_texts):
    got = {(r.path, r.line_no): r.line for r in file_lines(files_of(random_texts)).collect()}
    assert got == {(p, n): line for p, t in random_texts.items() for n, line in enumerate(lines_of(t), 1)}


@pytest.mark.parametrize("symbol", SYMBOLS)
def test_single_symbol(files_of, random_texts, symbol):
    got = references.find_references(files_of(random_texts), symbol).collect()
    assert {(r.path, r.line_no) for r in got} == brute_force(random_texts, symbol)
    assert len(got) == len({(r.path, r.line_no) for r in got})


def test_all_symbols_in_one_pass(spark, files_of, random_texts, join_way):
    symbols = spark.createDataFrame([(s,) for s in [*SYMBOLS, "a", None]], "symbol string")
    got = references.find_references_bulk(files_of(random_texts), symbols).collect()
    assert len(got) == len(set(got))
    for symbol in SYMBOLS:
        assert {(r.path, r.line_no) for r in got if r.symbol == symbol} == brute_force(random_texts, symbol)


def test_neighbouring_words_meet_by_equality(spark, files_of, random_texts, join_way):
    """Names of two words are not checked against every line that has one of them."""
    asked = ["a b", "a.b", "b->a", "é Ж", "1 .a", "ab  b"]
    longer = [".a b", "a b.", "a.b a", "$b $a", "a b_é", "ab\nb", "a $"]
    symbols = spark.createDataFrame([(s,) for s in asked], "symbol string")
    found = references.find_references_bulk(files_of(random_texts), symbols)
    assert "rlike(line" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    texts = random_texts | {"p.txt": "a b a.b b->a b_é Ж\n1 .a ab  b x.a b.a b a $b $a\n" + "a b " * 2_000}
    got = references.find_references_bulk(files_of(texts), symbols.union(spark.createDataFrame([(s,) for s in longer], "symbol string"))).collect()
    assert len(got) == len(set(got))
    for symbol in asked + longer:
        assert {(r.path, r.line_no) for r in got if r.symbol == symbol} == brute_force(texts, symbol)


def test_no_symbols_asked(spark, files_of):
    none = spark.createDataFrame([], "symbol string")
    assert references.find_references_bulk(files_of({"a.txt": "a"}), none).count() == 0


def test_rendered_hits(files_of):
    hits = references.render_hits(references.find_references(files_of({"usage.py": "x = 1\nMyClass()\ny = 2\n"}), "MyClass"))
    assert [r.hit for r in hits.collect()] == ["usage.py:2"]


def test_requests_without_hits(spark, files_of):
    requests = spark.createDataFrame([(1, "a"), (2, "Unicorn"), (3, "a")], "req_id long, name string")
    rows = lookup.find_references(files_of({"m.py": "a\n"}), requests).collect()
    assert {(r.req_id, r.path, r.line_no, r.message) for r in rows} == {
        (1, "m.py", 1, None), (3, "m.py", 1, None), (2, None, None, "(no references found)"),
    }


CORPUS = {
    "src/pkg/core.py": "class K:\n    def go(self): pass\n\ndef f(): return K()\n",
    "src/pkg/__init__.py": "from .core import K\n",
    "src/pkg/sub/user.py": "from ..core import K as Q\nQ()\n",
    "src/pkg/sub/stranger.py": "from ...core import K\nK\n",
    "app/main.py": "from pkg.core import K\nK().go()\n",
    "app/star.py": "from pkg.core import *\nK\n",
    "app/module.py": "import os, pkg.core\npkg.core.K\n",
    "app/from_package.py": "from pkg import core\ncore.K\n",
    "app/other.py": "from pkg.core import f\n# K\n",
    "near/pkg/core.py": "K = 1\n",
    "near/user.py": "from pkg.core import K\nK\n",
    "notes.txt": "K\n",
    "broken.py": "from pkg.core import K\ndef (\n",
    "app/alias.py": "from pkg.core import (\n    f,\n    K as R,\n)\nR().go()  # K\nx = 'K'\n",
    "app/through.py": "from pkg import K as W\n\n\nclass Sub(W):\n    pass\n",
    "src/pkg/outer.py": "from .sub.user import Q\nfrom .relay import *\n",
    "src/pkg/relay.py": "from .core import *\n",
    "app/far.py": "from pkg.outer import K, Q as Z\nZ; K\n",
    "app/attr.py": "import pkg\npkg.K.go\nimport pkg.core as c\nc.K; c.f; other.K\n",
    "app/last.py": "from app import far\nfrom app.far import Z\nfar.Z\nZ\n",
    "app/cycle_a.py": "from app.cycle_b import *\nfrom pkg.core import K\n",
    "app/cycle_b.py": "from app.cycle_a import *\nK\n",
}


def test_resolved_references(spark, files_of, join_way):
    requests = spark.createDataFrame(
        [(1, "K", "src/pkg/core.py"), (2, "go", "src/pkg/core.py"), (3, "K", "notes.txt"), (4, "zzz", "src/pkg/core.py"),
         (5, "K", "src/pkg/core.py")],
        "req_id long, symbol string, path string",
    )
    rows = resolved.resolved_references(files_of(CORPUS), requests).collect()
    assert len(rows) == len(set(rows))
    by_request = {i: {(r.path, r.line_no) for r in rows if r.req_id == i and r.status == "ok"} for i in range(1, 6)}
    assert by_request[1] == {
        ("src/pkg/core.py", 1), ("src/pkg/core.py", 4), ("src/pkg/__init__.py", 1), ("src/pkg/sub/user.py", 1),
        ("src/pkg/sub/user.py", 2), ("app/main.py", 1), ("app/main.py", 2), ("app/star.py", 2), ("app/module.py", 2),
        ("app/from_package.py", 2), ("app/alias.py", 3), ("app/alias.py", 5), ("app/through.py", 1), ("app/through.py", 4),
        ("src/pkg/outer.py", 1), ("app/far.py", 1), ("app/far.py", 2), ("app/attr.py", 2), ("app/attr.py", 4),
        ("app/last.py", 2), ("app/last.py", 3), ("app/last.py", 4), ("app/cycle_a.py", 2), ("app/cycle_b.py", 2),
    }
    assert by_request[5] == by_request[1]
    # ``go`` belongs to class K, so files that bring in K can use it.
    assert by_request[2] == {("src/pkg/core.py", 2), ("app/main.py", 2), ("app/alias.py", 5), ("app/attr.py", 2)}
    assert by_request[3] == {(p, n) for p, n in brute_force(CORPUS, "K")}
    assert by_request[4] == set()
    assert {r.method for r in rows if r.req_id in (1, 2, 5)} == {"resolved"}
    assert {r.method for r in rows if r.req_id == 3} == {"text"}
    assert [(r.path, r.status, r.message) for r in rows if r.req_id == 4] == [(None, "no_references", "(no references found)")]


def test_resolved_references_of_nothing(spark, files_of):
    none = spark.createDataFrame([], "req_id long, symbol string, path string")
    assert resolved.resolved_references(files_of(CORPUS), none).count() == 0
    odd = spark.createDataFrame([(1, None, "app/main.py"), (2, "K", None), (3, None, None)], none.schema)
    rows = resolved.resolved_references(files_of({"m.py": "K\n"}), odd).collect()
    assert {(r.req_id, r.path, r.status) for r in rows} == {(1, None, "no_references"), (2, "m.py", "ok"), (3, None, "no_references")}


def test_search_runs_on_a_stream(spark, tmp_path):
    """Row-local operators take a streaming corpus unchanged."""
    source = str(tmp_path / "in")
    spark.createDataFrame([("a.py", "x\nK\n"), ("b.py", "y\n")], "path string, text string").write.parquet(source)
    stream = spark.readStream.schema("path string, text string").parquet(source)
    query = references.find_references(stream, "K").writeStream.format("memory").queryName("hits").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.path, r.line_no) for r in spark.table("hits").select("path", "line_no").collect()] == [("a.py", 2)]


def test_lists_are_repeated_only_for_the_salts_in_use(spark, monkeypatch):
    from codescope.plans import joins

    rows = spark.range(4000).selectExpr("if(id < 3000, 'hot', concat('k', id)) AS key", "id")
    listed = spark.range(4000).selectExpr("if(id = 0, 'hot', concat('k', id)) AS key", "id * 2 AS twice")
    for read_twice, most in ((True, 1000 + joins.SALTS), (False, 4000 * joins.SALTS)):
        repeated = []
        with monkeypatch.context() as m:
            join = type(rows).join
            m.setattr(type(rows), "join", lambda *a: repeated.append(a[1]) or join(*a))
            found = joins.list_join(rows, listed, ["key"], False, read_twice)
        assert repeated[-1].count() <= most and "_salt" in repeated[-1].columns
        assert sorted((r.id, r.twice) for r in found.collect()) == [(n, 0 if n < 3000 else 2 * n) for n in range(4000)]
    files = joins.file_join(rows, listed, ["key"], False)
    assert files.count() == 4000 and "_salt" not in files._jdf.queryExecution().toString()
