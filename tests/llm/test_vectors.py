import collections
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from codescope.llm import cover_tree, posting_lists, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, cell int, score double, uid string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 0.5, "u") for i, v, label in rows], SCHEMA)


def sane(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def padded(v, size):
    return np.array(list(v) + [0.0] * (size - len(v)))


def brute_negatives(rows, every=50):
    rows = [(i, tuple(v), label) for i, v, label in rows if i is not None and label is not None and sane(v)]
    found = []
    for a, (anchor, v, label) in enumerate(rows):
        if anchor % every:
            continue
        scored = [(-sum(int(x) * int(y) for x, y in zip(v, w)), i, other == label)
                  for b, (i, w, other) in enumerate(rows) if a != b]
        positives = sorted((s, i) for s, i, same in scored if same)[:5]
        for s, i in positives:
            fits = sorted((n, j) for n, j, same in scored if not same and 50 * -s <= 100 * -n <= 95 * -s)[:3]
            found += [(anchor, i, rank, j, -s, -n) for rank, (n, j) in enumerate(fits, start=1)]
    return sorted(found)


def negatives(frame, **options):
    rows = frame.withColumnRenamed("embedding", "vector")
    return sorted(tuple(r) for r in cover_tree.hard_negatives(rows, **options).collect())


def clustered(seed, n, size=6, spread=20):
    rng = random.Random(seed)
    centres = [[rng.randint(-200, 200) for _ in range(size)] for _ in range(5)]
    return [(i, [float(x + rng.randint(-spread, spread)) for x in rng.choice(centres)], rng.randint(0, 2)) for i in range(n)]


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(cover_tree, "CELL_ROWS", 40)
    monkeypatch.setattr(cover_tree, "LEAF_ROWS", 4)
    monkeypatch.setattr(cover_tree, "MAX_ROOTS", 6)


def test_negatives_against_brute_force(spark, small_cells):
    rows = clustered(1, 600)
    wanted = brute_negatives(rows)
    assert wanted and negatives(table_of(spark, rows)) == wanted


def test_negatives_with_ties_copies_and_unusable_rows(spark, small_cells):
    same = [3.0, 4.0, 0.0]
    rows = [(i, same, i % 3) for i in range(200)] + [(i, [float(i % 5), 2.0, 1.0], i % 2) for i in range(200, 320)]
    rows += [(50, same, 2), (50, same, 2), (100, [1.0, 1.0, 1.0], 1), (400, None, 1), (450, [1.0, None, 2.0], 1), (None, same, 1),
             (500, [math.nan, 1.0, 1.0], 0), (550, [math.inf, 1.0, 1.0], 0), (600, same, None), (650, [], 1), (700, [0.0, 0.0, 0.0], 1),
             (750, [4.0], 1), (-50, [1.0, 2.0, 3.0], 0)]
    assert negatives(table_of(spark, rows)) == brute_negatives(rows)


def test_negatives_of_large_numbers_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(0, 1 << 29)) for _ in range(3)], i % 2) for i in range(60)]
    assert negatives(table_of(spark, rows), every=5) == brute_negatives(rows, 5)


def test_negatives_of_nothing(spark):
    assert negatives(table_of(spark, [])) == []
    assert negatives(table_of(spark, [(50, [1.0], 1)])) == []
    assert negatives(table_of(spark, [(50, None, 1), (100, [1.0], None)])) == []


def test_anchors_of_a_hot_cell_are_dealt_over_copies(spark, small_cells, monkeypatch):
    monkeypatch.setattr(cover_tree, "CELL_ANCHORS", 3)
    rows = clustered(4, 300)
    assert negatives(table_of(spark, rows), every=5) == brute_negatives(rows, 5)


def test_tree_bounds_hold_and_skip(monkeypatch):
    monkeypatch.setattr(cover_tree, "LEAF_ROWS", 64)
    rng = np.random.default_rng(8)
    centres = rng.integers(-300, 300, (30, 8)).astype(float)
    rows = np.floor(np.repeat(centres, 60, axis=0) + rng.normal(0, 6, (1800, 8)))
    longest = float(np.sqrt((rows * rows).sum(1).max()))
    centre = cover_tree._augmented(rows[:1], longest)[0]
    tree = cover_tree.Tree.build(rows, np.arange(1800), np.arange(1800) % 2, np.ones(1800, bool), centre, longest)
    assert sorted(tree.ids.tolist()) == list(range(1800))
    queries = rows[::90]
    low, high = cover_tree.score_bounds(queries, tree.centres, tree.radii, longest)
    scores = queries @ tree.rows.T
    for node, (start, end, child, last) in enumerate(tree.bounds.tolist()):
        assert (scores[:, start:end].max(1) <= high[:, node]).all() and (scores[:, start:end].min(1) >= low[:, node]).all()
        if last:
            assert sum(tree.bounds[c, 1] - tree.bounds[c, 0] for c in range(child, last)) == end - start
    verified = 0
    for i, q in enumerate(queries):
        window = cover_tree.Window_(-math.inf, math.inf, 3)
        verified += cover_tree.descend(tree, q, -1, 0, False, [window], low[i].tolist(), high[i].tolist())
        best = sorted((-int(s), int(j)) for s, j in zip(rows @ q, range(1800)) if j % 2)[:3]
        assert [(int(s), j) for s, j in window.best] == best
    assert verified < len(queries) * 1800 / 2


def brute_nearest(rows, every=20, top=20):
    rows = [(i, v) for i, v, _ in rows if i is not None and sane(v) and any(v)]
    size = max((len(v) for _, v in rows), default=0)
    points = np.array([padded(v, size) for _, v in rows]).reshape(len(rows), size)
    ids = np.array([i for i, _ in rows], dtype=np.int64)
    found = []
    for a in np.flatnonzero(ids % every == 0):
        scores = np.add.accumulate(points[a] * points, axis=1)[:, -1]
        order = [b for b in np.lexsort((ids, -scores)) if b != a][:top]
        found += [(int(ids[a]), rank, int(ids[b]), float(scores[b])) for rank, b in enumerate(order, start=1)]
    return sorted(found)


def nearest(frame, **options):
    return sorted(tuple(r) for r in posting_lists.nearest(frame, **options).collect())


def recall(found, wanted):
    by_query = collections.defaultdict(set)
    for query, _, i, _ in found:
        by_query[query].add(i)
    return sum(i in by_query[query] for query, _, i, _ in wanted) / len(wanted)


@pytest.mark.parametrize("kind", ["even", "clustered", "norms"])
def test_recall_and_scores(spark, kind, monkeypatch):
    monkeypatch.setattr(posting_lists, "LIST_ROWS", 16)
    rng = np.random.default_rng(4)
    points = rng.normal(size=(3000, 24))
    if kind == "clustered":
        points = rng.normal(size=(20, 24))[rng.integers(0, 20, 3000)] + 0.1 * points
    if kind == "norms":
        points *= rng.lognormal(0, 1, (3000, 1))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(points)]
    found, wanted = nearest(table_of(spark, rows)), brute_nearest(rows)
    assert recall(found, wanted) >= 0.9
    assert collections.Counter(r[0] for r in found) == collections.Counter(r[0] for r in wanted)
    for query, _, i, score in found:
        assert score == float(np.add.accumulate(points[query] * points[i])[-1])
    assert len({(r[0], r[2]) for r in found}) == len(found)
    for a, b in zip(found, found[1:]):
        assert a[0] != b[0] or (a[1] + 1 == b[1] and (-a[3], a[2]) < (-b[3], b[2]))


def test_copies_ties_and_unusable_rows(spark):
    same = [0.5, 0.25]
    rows = [(i, same, 1) for i in range(100)] + [(20, same, 1), (20, [1.0, 0.0], 1), (200, None, 1), (220, [0.0, 0.0], 1), (None, same, 1),
            (240, [math.nan, 1.0], 1), (260, [1.0, None], 1), (280, [], 1), (300, [2.0], 1), (320, [-1.0, -1.0], None)]
    assert nearest(table_of(spark, rows)) == brute_nearest(rows)


def test_nearest_of_few_rows(spark):
    assert nearest(table_of(spark, [])) == []
    assert nearest(table_of(spark, [(20, [1.0], 1)])) == []
    rows = [(20, [1.0, 2.0], 1), (21, [2.0, 1.0], 1), (40, [0.5, 0.5], 1)]
    assert nearest(table_of(spark, rows)) == brute_nearest(rows)


def test_long_lists_and_hot_bins_are_split(spark, monkeypatch):
    monkeypatch.setattr(posting_lists, "BIN_ROWS", 64)
    monkeypatch.setattr(posting_lists, "BIN_QUERIES", 7)
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.normal(size=(300, 8)), [1, 1, 1, 1, 0, 0, 0, 0] + 0.001 * rng.normal(size=(700, 8))])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(points)]
    assert recall(nearest(table_of(spark, rows)), brute_nearest(rows)) >= 0.9


def test_graph_reaches_every_centroid():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.01, (80, 5)) for c in range(0, 40, 4)])
    graph = posting_lists.fit_graph(points, 50)
    assert np.isfinite(graph.near(points[:3], np.inf, 0)).all()
    brute = np.sqrt(((points[:, None] - graph.centroids[None]) ** 2).sum(2)).argmin(1)
    assert (graph.near(points, 1.0, 8).argmin(1) == brute).mean() > 0.97


def test_a_balanced_tree_has_even_parts():
    points = np.random.default_rng(2).lognormal(size=(1000, 3))
    sizes = [len(p) for p in posting_lists._halves(points, np.arange(1000), 13, np.random.default_rng(0))]
    assert len(sizes) == 13 and max(sizes) - min(sizes) <= 3


def test_matrix_pads_short_vectors():
    import pyarrow as pa

    found = vectors.matrix(pa.array([[1.0], [2.0, 3.0], [], [4.0, 5.0, 6.0]]), 3)
    assert found.tolist() == [[1, 0, 0], [2, 3, 0], [0, 0, 0], [4, 5, 6]]


def test_a_bin_scores_few_rows_exactly():
    rng = np.random.default_rng(5)
    n, size, top, lists = 2_000, 6, 5, 40
    rows = rng.normal(size=(n, size))
    rows[1_000:1_100] = rows[:100]
    own = rng.integers(0, lists, n)
    other = np.where(rng.random(n) < 0.5, rng.integers(0, lists, n), -1)
    table = pa.table({"vec_id": np.arange(n), "first": np.ones(n, bool), "vector": rows.tolist(), "list": own,
                      "earlier": pa.array([[] if o < 0 else [o] for o in other.tolist()], pa.list_(pa.int32()))})
    held = posting_lists.Bin(size, 3.0, top, table)
    ids = np.arange(0, n, 4)
    queries = rows[ids]
    probed = [np.flatnonzero(rng.random(lists) < 0.6).tolist() for _ in ids]
    who, _ = held._candidates(queries, ids, probed, lists)
    assert np.bincount(who).max() <= top + posting_lists._MARGIN + 1
    who, found, scores = held.search(queries, ids, probed, lists)
    for i, at in enumerate(ids.tolist()):
        reads = np.isin(own, probed[i]) & ~np.isin(other, probed[i]) & (np.arange(n) != at)
        exact = np.add.accumulate(queries[i] * rows, axis=1)[:, -1]
        best = [j for j in np.lexsort((np.arange(n), -exact)).tolist() if reads[j]][:top]
        assert found[who == i].tolist() == best and scores[who == i].tolist() == exact[best].tolist()


def test_the_ratio_is_fitted_from_the_lists_of_neighbours_alone(monkeypatch):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(3_000, 5))
    points = posting_lists._as_points(rows, posting_lists._norms(rows).max())
    graph = posting_lists.fit_graph(points, 40)
    own = np.arange(0, len(rows), 300)
    queries = posting_lists._as_queries(rows[own])
    lists = posting_lists.lists_of(points, graph)
    needed = []
    for query, at in zip(queries, own):
        order = [j for j in np.argsort(-(points @ query)).tolist() if j != at][:7]
        distances = np.sqrt(posting_lists._squared(query[None], graph.centroids))[0]
        needed += [distances[lists[j]].min() / distances.min() for j in order]
    looked = []
    whole = posting_lists.lists_of
    monkeypatch.setattr(posting_lists, "lists_of", lambda p, g: looked.append(len(p)) or whole(p, g))
    assert np.isclose(posting_lists.fit_ratio(points, queries, own, graph, 7, 0.9), max(1, np.quantile(needed, 0.9)), rtol=1e-9)
    assert sum(looked) <= 7 * len(own)


def test_a_search_through_the_graph_holds_few_distances():
    rng = np.random.default_rng(7)
    points = rng.normal(size=(8_192, 6))
    graph = posting_lists.fit_graph(points, 4_096)
    tracemalloc.start()
    lists = posting_lists.lists_of(points[:600], graph)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    brute = np.sqrt(posting_lists._squared(points[:600], graph.centroids))
    assert np.mean([x[0] == b for x, b in zip(lists, brute.argmin(1))]) > 0.95
    assert most < 64 << 20  # 512 rows of distances, those not yet left, copies and orders of both: 100 MB


def test_a_query_is_handed_over_once_for_a_group_of_bins(spark):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(4_096, 6))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    graph, lists = posting_lists.fit_graph(posting_lists._as_points(points, 1.0), 512), 512
    plan = posting_lists.Index(None, graph, 3.0, np.arange(lists), np.ones(lists, int), np.full(lists, 8), 6, 1.0, 5)
    queries = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(300)), pa.array(np.arange(300)), pa.array(points[:300].tolist(), pa.list_(pa.float64()))],
        ["uid", "query_id", "vector"])
    parts = list(posting_lists.asking(queries, plan, 16))
    assert sum(p.num_rows for p in parts) == 300
    assert sum(p.nbytes for p in parts) < 300 * (8 * 6 + lists // 8 + 4 * 32 + 64)  # not lists times bins
    reads = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")[:lists].astype(bool)[None]
                            for p in parts for x in p.column("reads").to_pylist()])
    assert np.array_equal(reads, posting_lists.lists_to_read(posting_lists._as_queries(points[:300]), plan))
    for row, groups in zip(reads, [g for p in parts for g in p.column("groups").to_pylist()]):
        assert groups == np.unique(np.flatnonzero(row) // 16).tolist()


def test_groups_of_bins_and_copies_of_rows_give_all_that_is_near(spark, monkeypatch):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(1_500, 8))
    points[1_000:1_040] = points[:40]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(points)] + [(20, points[20].tolist(), 0), (40, points[40].tolist(), 0)]
    monkeypatch.setattr(posting_lists, "LIST_ROWS", 16)
    monkeypatch.setattr(posting_lists, "BIN_ROWS", 48)
    monkeypatch.setattr(posting_lists, "MAX_GROUPS", 7)
    monkeypatch.setattr(posting_lists, "BIN_QUERIES", 20)
    monkeypatch.setattr(posting_lists, "fit_ratio", lambda *_: 100.0)  # every list is read
    assert nearest(table_of(spark, rows)) == brute_nearest(rows)


def test_bins_of_long_vectors_hold_fewer_rows(spark, monkeypatch):
    monkeypatch.setattr(posting_lists, "BIN_VALUES", 8 * 50)
    rng = np.random.default_rng(10)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(400, 8)))]
    ready = posting_lists.prepared(table_of(spark, rows))
    index = posting_lists.build_index(ready)
    assert max(r["count"] for r in index.rows.groupBy("bin").count().collect()) <= 75  # 50 by a hash
    assert recall(nearest(table_of(spark, rows)), brute_nearest(rows)) >= 0.9
