"""Columns of the caller that are called like an operator's own come back unchanged."""

import re

import pytest
from pyspark.sql import functions as F

from codescope.llm import decontamination, exact_dedup, mixing, quality, simhash, url_filter
from codescope.llm.tables import aside

NAMES = ["_id", "_SHA", "_order", "_slice", "_whole", "_end", "_last", "_host", "_features", "_grams", "_probability", "size", "source_size",
         "target", "repeats", "copy", "copy_", "p_text", "p_quality", "digest", "key", "n", "_id_kept", "fingerprint", "label"]
PARTS = ["alpha beta gamma delta epsilon", "one two three four five six", "the quick brown fox jumps", "lorem ipsum dolor sit amet"]
TEXTS = [f"{PARTS[i % 4]} {i} {PARTS[(i * 7 + 1) % 4]} w{i * 13} w{i * 29}" for i in range(24)] + ["same words in two rows of one"] * 2


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, t, "en", "ab"[i % 2], len(t), *[f"{name}{i}" for name in NAMES]) for i, t in enumerate(TEXTS)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(rows, columns)


def unchanged(frame, skipped=()):
    rows = frame.collect()
    for row in rows:
        for name in NAMES:
            if name not in skipped:
                assert row[name] == f"{name}{row.doc_id}"
    return rows


def test_rows_that_stay_keep_their_columns(clashing):
    rows = unchanged(exact_dedup.first_of_each(clashing))
    assert len(rows) == len(TEXTS) - 1
    assert exact_dedup.first_of_each(clashing).columns == clashing.columns
    twice = clashing.union(clashing)
    for frame in (simhash.first_of_each(twice), exact_dedup.first_of_each(twice)):
        assert frame.columns == clashing.columns and len(unchanged(frame)) == len(TEXTS) - 1


def test_mixing_replaces_only_what_it_names(clashing):
    mix = mixing.mixed(clashing)
    unchanged(mix, ("size", "source_size", "target", "repeats"))
    assert all(r["size"] == len(re.findall(r"\S+", r.text)) for r in mix.collect())


def test_stages_of_the_pipeline(spark, clashing, labels_of, tmp_path):
    import corpus_pipeline

    labels_of([]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this is anywhere at all")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clashing, str(tmp_path))
        assert out.columns[: len(clashing.columns)] == clashing.columns
        assert len(unchanged(out)) >= len(TEXTS) - 1, name
    assert out.columns[-1] == "copy__" and {r["copy__"] for r in out.collect()} <= {1, 2, 3}


def test_pages_keep_their_columns(spark, clashing):
    pages = clashing.select(F.col("doc_id"), F.lit("http://a.example.org/en/1").alias("url"), *[F.col(f"`{n}`") for n in NAMES])
    model = url_filter.train(url_filter.labelled_urls(spark))
    assert {r.host for r in unchanged(url_filter.judged(pages, model))} == {"a.example.org"}


def test_clean_documents_and_scores_keep_their_columns(spark, clashing):
    bench = spark.createDataFrame([(1, PARTS[0])], "item_id long, text string")
    unchanged(decontamination.clean_documents(clashing, bench))
    unchanged(quality.scored(clashing, None), ("p_text", "p_quality"))


def test_aside(spark):
    frame, back = aside(spark.createDataFrame([(1, 2, 3)], "A int, a_kept int, B int"), ["a", "x"])
    assert frame.columns == ["A_kept_", "a_kept", "B"] or frame.columns[0] not in ("A", "a")
    assert back(frame.withColumn("a", F.lit(9)).drop("a")).columns == ["A", "a_kept", "B"]


@pytest.mark.parametrize("batches", [1, 2, 3])
@pytest.mark.parametrize("ids", ["long", "string"])
def test_digests_that_share_a_key_are_told_apart(spark, monkeypatch, batches, ids):
    """A constant key lets everything through the filters; nothing may come twice."""
    monkeypatch.setattr(exact_dedup, "_key", lambda: F.lit(7).cast("long"))
    rows = [(i, f"text {i % 11}" if i < 30 else f"alone {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(ids))
    got = exact_dedup.exact_duplicates(docs, batches).collect()
    assert len(got) == 60
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(str(i) if ids == "string" else i)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == sorted(
        (i, min(g), len(g)) for g in groups.values() for i in g)
