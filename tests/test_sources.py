import os

import pytest
from pyspark.sql import functions as F

from codescope.operators import references
from codescope.sources import corpus, tree


@pytest.fixture
def root(tmp_path):
    texts = {
        "a.py": b"MyClass()\n",
        "pkg/__init__.py": b"",
        "pkg/.hidden.py": b"MyClass\n",
        "pkg/_x/deep/er/m.py": b"from b import MyClass\r\nMyClass\rMyClass",
        ".git/COMMIT_EDITMSG": b"MyClass\n",
        "pkg/node_modules/i.js": b"MyClass\n",
        "tests/t.py": b"MyClass\n",
        "notebooks/n.py": b"MyClass\n",
        "dist/d.js": b"MyClass\n",
        "broken.txt": b"\xffMy\xc3Class\xef\xbf\xbd MyClass",
        "Dockerfile": b"FROM x\n",
    }
    for name, data in texts.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path)


def relative(root, frame):
    return {os.path.relpath(r.path, root) for r in frame.select("path").collect()}


SEARCHED = {"a.py", "pkg/__init__.py", "pkg/.hidden.py", "pkg/_x/deep/er/m.py", "dist/d.js", "broken.txt", "Dockerfile"}


@pytest.mark.parametrize("splits", [1, 3, 100])
def test_scan_for_search(spark, root, splits):
    assert relative(root, tree.scan_source_tree(spark, root, num_partitions=splits)) == SEARCHED


def test_scan_for_index(spark, root):
    found = tree.scan_source_tree(spark, root, corpus.INDEX_SKIP_DIRS)
    assert relative(root, found) == (SEARCHED - {"dist/d.js"}) | {"tests/t.py", "notebooks/n.py"}


def test_scan_everything(spark, root):
    found = tree.scan_source_tree(spark, root, (), skip_hidden_dirs=False)
    assert len(relative(root, found)) == 11


def test_pruning_a_table_agrees_with_the_scan(spark, root):
    everything = tree.scan_source_tree(spark, root, (), skip_hidden_dirs=False)
    assert relative(root, corpus.prune_files(everything, root)) == SEARCHED
    assert relative(root, corpus.prune_files(everything.where("path like '%pkg%'"), root + "/pkg/")) == {
        "pkg/__init__.py", "pkg/.hidden.py", "pkg/_x/deep/er/m.py",
    }


def test_missing_root(spark):
    with pytest.raises(FileNotFoundError, match="Directory not found: /no/such"):
        tree.scan_source_tree(spark, "/no/such")


def test_search_in_a_tree(spark, root):
    hits = references.find_references(tree.scan_source_tree(spark, root, mode="ignore"), "MyClass").collect()
    assert {(os.path.relpath(r.path, root), r.line_no) for r in hits} == {
        ("a.py", 1), ("pkg/.hidden.py", 1), ("pkg/_x/deep/er/m.py", 1), ("pkg/_x/deep/er/m.py", 2),
        ("pkg/_x/deep/er/m.py", 3), ("dist/d.js", 1), ("broken.txt", 1),
    }


def test_unreadable_and_undecodable_files_are_rows(spark, root):
    os.symlink(os.path.join(root, "nowhere"), os.path.join(root, "dangling.py"))
    status = {os.path.relpath(r.path, root): r.status for r in tree.scan_source_tree(spark, root).collect()}
    assert status == {**dict.fromkeys(SEARCHED, "ok"), "broken.txt": "decode_error", "dangling.py": "unreadable"}


BYTES = [b"", b"ok\xc3\xa9", b"\xff", b"a\xc3", b"\xe2\x28\xa1", b"\xf0\x9f\x98x", b"\xed\xa0\x80y", b"\xef\xbf\xbd\xff", b"\xc0\xaf", b"\r\n\r"]


def test_decoding_agrees_with_bytes_decode(spark):
    frame = spark.createDataFrame([(str(i), b) for i, b in enumerate(BYTES)], "path string, content binary")
    got = {int(r.path): r.text for r in corpus.decode_text(frame, "ignore").collect()}
    assert got == {i: b.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for i, b in enumerate(BYTES)}
    for row in corpus.decode_text(frame, "strict").collect():
        try:
            text, status = BYTES[int(row.path)].decode().replace("\r\n", "\n").replace("\r", "\n"), "ok"
        except UnicodeDecodeError:
            text, status = None, "decode_error"
        assert (row.text, row.status) == (text, status)
    with pytest.raises(ValueError, match="mode"):
        corpus.decode_text(frame, "lax")


def test_stored_corpus_prunes_kinds_and_pushes_paths(spark, files_of, tmp_path):
    files = files_of({"a.py": "x", "b/Dockerfile": "FROM x", "c.rb": "y"}).select("path", "name", "ext", "kind", "text")
    location = str(tmp_path / "corpus")
    corpus.write_corpus(files, location, partitions=2, max_records_per_file=1)
    back = corpus.read_corpus(spark, location)
    assert {(r.path, r.kind) for r in back.collect()} == {("a.py", "python"), ("b/Dockerfile", "dockerfile"), ("c.rb", None)}
    plan = back.where((F.col("kind") == "python") & F.col("path").isin("a.py"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in text and "PartitionFilters: [" in text and "PushedFilters: [In(path" in text or "EqualTo(path" in text


def test_undecodable_file_is_a_status_in_views(spark):
    from codescope.plans import lookup, views

    frame = spark.createDataFrame(
        [("bad.py", b"x = '\xff'\n"), ("good.py", b"def f(): pass\r\n"), ("gone.py", None)], "path string, content binary"
    )
    files = corpus.classify_files(corpus.decode_text(frame, "strict"))
    got = {r.path: (r.status, r.view) for r in views.structure(files).collect()}
    assert got == {
        "bad.py": ("parse_error", "Parse error in bad.py: not valid UTF-8"),
        "good.py": ("ok", "f"),
        "gone.py": ("not_found", "File not found: gone.py"),
    }
    requests = spark.createDataFrame([(1, "bad.py", "f"), (2, "good.py", "f")], "req_id long, path string, name string")
    answers = {r.req_id: (r.status, r.result) for r in lookup.symbol_body(files, requests).collect()}
    assert answers == {1: ("parse_error", None), 2: ("ok", "def f(): pass")}


def test_files_are_packed_by_size(spark):
    rows = [("huge.py", 50 << 20), *[(f"d/{i}.py", 1 << 10) for i in range(20_000)], *[(f"m/{i}.py", 3 << 20) for i in range(20)], ("none", 0)]
    packed = corpus.pack(spark.createDataFrame(rows, "path string, size long"), 8 << 20)
    parts = packed.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in parts) == len(rows)
    assert sorted(r.bytes for r in parts)[-1] < (50 << 20) + (9 << 20) and sorted(r.bytes for r in parts)[-2] < 20 << 20
    assert corpus.pack(packed.limit(0)).count() == 0


def tree_of(tmp_path, names):
    for name in names:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x = 1\n")
    return str(tmp_path)


@pytest.mark.parametrize("names", [
    [f"f{i}.py" for i in range(30)], [f"d{i}/f.py" for i in range(60)], ["/".join("abcdefgh"[: i + 1]) + "/f.py" for i in range(8)]],
    ids=["flat", "wide", "deep"])
def test_listing_has_a_bounded_number_of_tasks(spark, tmp_path, names):
    root = tree_of(tmp_path, names)
    listed = tree.list_source_tree(spark, root, num_partitions=4)
    assert listed.rdd.getNumPartitions() <= 4
    assert {os.path.relpath(r.path, root) for r in listed.collect()} == set(names)
    assert {r.size for r in listed.collect()} == {6}


def test_filters_reach_the_listing(spark, tmp_path):
    names = ["a/x.py", "a/b/y.py", "a/b/z.json", "c/d/w.py", "ab/v.py", "top.py"]
    root = tree_of(tmp_path, names)
    os.chmod(os.path.join(root, "c"), 0)  # listing it would raise, for any but the super-user
    reader = tree._TreeReader(root, set(), True, 2)
    list(reader.pushFilters([tree.StringStartsWith(("path",), root + "/a/"), tree.EqualTo(("size",), 6)]))
    assert {os.path.relpath(d, root) for part in reader.partitions() for d, _ in part.parts} <= {".", "a", "a/b"}
    os.chmod(os.path.join(root, "c"), 0o755)
    below = tree.list_source_tree(spark, root, below=root + "/a/")
    assert "PushedFilters: [" in below._jdf.queryExecution().executedPlan().toString() or "StartsWith" in below._jdf.queryExecution().toString()
    assert {os.path.relpath(r.path, root) for r in below.collect()} == {"a/x.py", "a/b/y.py", "a/b/z.json"}
    chosen = tree.scan_source_tree(spark, root, below=root + "/a/", kinds=["python"])
    assert {os.path.relpath(r.path, root) for r in chosen.collect()} == {"a/x.py", "a/b/y.py"}
    assert {os.path.relpath(r.path, root) for r in tree.scan_source_tree(spark, root).collect()} == set(names)
