"""Registered queries against their SQL, and the shape of those that SQL cannot say."""

import pytest

from codescope.llm.queries import ORACLE, QUERIES
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, name):
    count, problems = difference(spark, connect(SF_DIR), QUERIES[name], ORACLE[name], SF_DIR)
    assert not problems
    assert count


@pytest.mark.parametrize("name", ["op1_token_counts", "op5_simhash_near_dedup", "op7_toxicity", "op9_secret_scan", "op10_quality"])
def test_one_row_for_each_document(spark, name):
    ids = [r.doc_id for r in QUERIES[name](spark, SF_DIR).select("doc_id").collect()]
    wanted = [r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect()]
    assert sorted(ids) == sorted(wanted)


def test_nearest_neighbours_against_brute_force(spark):
    """Recall of at least 0.9, exact scores in order, and twenty others for each query."""
    import numpy as np

    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").orderBy("vec_id").toArrow()
    ids, points = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), dtype=np.float64)
    found = {}
    for r in QUERIES["op12_nearest_neighbours"](spark, SF_DIR).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    place = {i: n for n, i in enumerate(ids.tolist())}
    assert set(found) == {i for i in place if i % 20 == 0}
    hits = 0
    for query, rows in found.items():
        scores = np.add.accumulate(points[place[query]] * points, axis=1)[:, -1]
        best = [i for i in ids[np.lexsort((ids, -scores))].tolist() if i != query][:20]
        assert [r[0] for r in rows] == list(range(1, 21))
        assert [r[1] for r in rows] == [i for _, i in sorted((-s, i) for _, i, s in rows)]
        assert all(s == scores[place[i]] for _, i, s in rows)
        hits += len({i for _, i, _ in rows} & set(best))
    assert hits >= 0.9 * 20 * len(found)


def test_urls_are_judged_one_by_one(spark):
    rows = QUERIES["op4_url_filter"](spark, SF_DIR).collect()
    assert sorted(r.page_id for r in rows) == sorted(r.page_id for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect())
    assert {r.verdict for r in rows} <= {"allow", "block"}


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "exact_duplicates", "near_duplicates", "benchmark_free", "source_mix"]
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows) > 0
    assert max(r.copy for r in rows) <= 3


def test_pipeline_stages_on_awkward_documents(spark, awkward, no_documents, tmp_path, labels_of):
    import corpus_pipeline

    labels_of([]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in corpus_pipeline.STAGES:
        for docs in (awkward.select(columns), no_documents.select(columns)):
            out = stage(spark, docs, str(tmp_path))
            assert out.columns[:5] == columns
            kept = [r.doc_id for r in out.collect()]
            if name == "exact_duplicates" and docs.count():
                assert sorted(kept, key=str) == sorted([1, 3, None, 4, 5, 6, 8, 9], key=str)
