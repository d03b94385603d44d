"""Hard negatives by exact inner products: cover trees over norm-augmented candidates, descended best first."""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codescope.plans.lineage import stored

from . import vectors

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these percentages of the positive's.
LOWEST_PERCENT, HIGHEST_PERCENT = 50, 95
#: Radii shrink by this factor from level to level; a node has at most so many children, a leaf so many rows.
BASE, MAX_CHILDREN, LEAF_ROWS = 1.3, 16, 512
#: Rows of one tree, the most roots, the rows of the sample that roots are chosen from, and anchors for one copy of a tree.
CELL_ROWS, MAX_ROOTS, SAMPLE_ROWS, CELL_ANCHORS = 4096, 1024, 8192, 1 << 15

_BATCH = 256
_EXACT = float(1 << 53)


def _augmented(rows: np.ndarray, longest: float) -> np.ndarray:
    """Rows with one more component that gives them all the norm ``longest``."""
    rest = np.sqrt(np.maximum(0, longest * longest - (rows * rows).sum(1, keepdims=True)))
    return np.concatenate([rows, rest], axis=1)


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    away = points - centre
    return np.sqrt(np.einsum("ij,ij->i", away, away))


def spread(points: np.ndarray, first: np.ndarray, until: float, most: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Farthest-first centres: (positions beside ``first``, nearest centre of each point, distance to it).

    Goes on until no point is farther than ``until`` from its centre or there are ``most`` centres; number 0 is ``first``.
    """
    distance, nearest = _distances(points, first), np.zeros(len(points), np.int64)
    chosen: list[int] = []
    while len(chosen) + 1 < most and len(points):
        far = int(distance.argmax())
        if distance[far] <= until:
            break
        chosen.append(far)
        new = _distances(points, points[far])
        closer = new < distance
        distance[closer], nearest[closer] = new[closer], len(chosen)
    return chosen, nearest, distance


@dataclass
class Tree:
    """Rows in tree order, and for every node its centre, covering radius, range of rows and of children."""

    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    first: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    bounds: np.ndarray  # first and last row, first and last child
    least: np.ndarray  # smallest id
    uniform: np.ndarray  # whether all rows have the label of the first one
    longest: float

    @classmethod
    def build(cls, rows, ids, labels, first, centre, longest) -> Tree:
        points = _augmented(rows, longest)
        order = np.lexsort((ids,))
        centres, radii, bounds = [centre[:-1]], [float(_distances(points, centre).max())], [[0, len(rows), 0, 0]]
        tops, node = [centre], 0
        while node < len(bounds):
            low, high = bounds[node][:2]
            at = order[low:high].copy()
            if high - low > LEAF_ROWS and radii[node] > 0:
                chosen, nearest, distance = spread(points[at], tops[node], radii[node] / BASE, MAX_CHILDREN)
                if chosen:
                    order[low:high] = at[np.argsort(nearest, kind="stable")]
                    sizes = np.bincount(nearest, minlength=len(chosen) + 1)
                    bounds[node][2] = len(bounds)
                    for i, size in enumerate(sizes.tolist()):
                        if size:
                            top = tops[node] if i == 0 else points[at[chosen[i - 1]]]
                            centres.append(top[:-1])
                            tops.append(top)
                            radii.append(float(distance[nearest == i].max()))
                            bounds.append([low, low + size, 0, 0])
                            low += size
                    bounds[node][3] = len(bounds)
            node += 1
        ids, labels = ids[order], labels[order]
        least = np.array([ids[a:b].min() for a, b, _, _ in bounds])
        uniform = np.array([(labels[a:b] == labels[a]).all() for a, b, _, _ in bounds])
        return cls(rows[order], ids, labels, first[order], np.array(centres), np.array(radii), np.array(bounds), least, uniform, longest)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: v for k, v in vars(self).items() if k != "longest"})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes, longest: float) -> Tree:
        with np.load(io.BytesIO(data), allow_pickle=False) as arrays:
            return cls(**{k: arrays[k] for k in arrays.files}, longest=longest)


def score_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) whole inner product of each query with any row within ``radii`` of ``centres``.

    A query is stretched to the norm of the augmented rows, so that distance and inner product determine each other.
    """
    norms = np.sqrt((queries * queries).sum(1, keepdims=True))
    stretch = np.where(norms > 0, longest / np.maximum(norms, 1e-300), 1.0)
    square = longest * longest + (norms * stretch) ** 2
    distance = np.sqrt(np.maximum(0, square - 2 * (queries @ centres.T) * stretch))
    low = (square - (distance + radii) ** 2) / (2 * stretch)
    high = (square - np.maximum(0, distance - radii) ** 2) / (2 * stretch)
    slack = 1e-9 * square / stretch + 1e-6
    return np.ceil(low - slack), np.floor(high + slack)


def dots(rows: np.ndarray, query: np.ndarray, longest: float) -> np.ndarray:
    """Inner products of whole numbers: in doubles where these are exact, else in integers of any size."""
    if longest * longest * 4 < _EXACT:
        return rows @ query
    return np.array([[int(x) for x in row] for row in rows], dtype=object) @ np.array([int(x) for x in query], dtype=object)


class Window_:
    """The ``count`` best rows with scores from ``low`` to ``high`` so far, as sorted pairs of minus the score and id.

    ``floor`` is a result that is known to stand at the end of ``count`` others or behind them; ``last`` and ``need`` are
    the pair and the score that a row must reach to be among the results.
    """

    __slots__ = ("low", "high", "count", "best", "last", "need")

    def __init__(self, low: float, high: float, count: int, floor: tuple | None = None):
        self.low, self.high, self.count, self.last = low, high, count, floor
        self.best: list[tuple] = []
        self.need = low if floor is None else max(low, -floor[0])

    def admits(self, low: float, high: float, least_id: int) -> bool:
        """Whether a row with a score between ``low`` and ``high`` and an id from ``least_id`` on may be a result."""
        top = high if high < self.high else self.high
        return top >= self.need and low <= self.high and (self.last is None or (-top, least_id) <= self.last)

    def add(self, found: list[tuple]) -> None:
        """Take in pairs of minus the score and id."""
        low, high = -self.high, -self.need
        fits = [pair for pair in found if low <= pair[0] <= high]
        if fits:
            self.best = heapq.nsmallest(self.count, self.best + fits)
            if len(self.best) == self.count and (self.last is None or self.best[-1] < self.last):
                self.last = self.best[-1]
                self.need = max(self.low, -self.last[0])


def descend(tree: Tree, query: np.ndarray, own_id: int, label: int, same: bool, windows: list[Window_], low, high) -> int:
    """Fill ``windows`` from ``tree``, best node first; returns how many rows were verified.

    ``low`` and ``high`` bound the scores of the nodes. Rows of the query's label count if ``same``, else all others.
    """
    heap, verified = [(-high[0], 0)], 0
    most = max(w.high for w in windows)
    while heap:
        _, node = heapq.heappop(heap)
        start, end, child, last = tree.bounds[node].tolist()
        if tree.uniform[node] and (tree.labels[start] == label) != same:
            continue
        least_id = int(tree.least[node])
        if not any(w.admits(low[node], high[node], least_id) for w in windows):
            continue
        if last:
            for c in range(child, last):
                heapq.heappush(heap, (-min(high[c], most), c))
            continue
        scores = dots(tree.rows[start:end], query, tree.longest)
        verified += end - start
        near = np.flatnonzero((scores >= min(w.need for w in windows)) & (scores <= most))
        near = near[(tree.labels[start:end][near] == label) == same]
        if not len(near):
            continue
        if same:
            own = (tree.ids[start:end][near] == own_id) & tree.first[start:end][near]
            for i in np.flatnonzero(own):
                own[i] = np.array_equal(tree.rows[start + near[i]], query)
            near = near[~own]
        found = list(zip((-scores[near]).tolist(), tree.ids[start:end][near].tolist()))
        for w in windows:
            w.add(found)
    return verified


@dataclass
class Forest:
    """One stored tree for every cell, and the roots that say which cells an anchor must see."""

    cells: DataFrame
    roots: np.ndarray
    radii: np.ndarray
    first_cell: np.ndarray
    splits: np.ndarray
    size: int
    longest: float


def build_forest(rows: DataFrame, most_equal: int) -> Forest | None:
    """Trees over all of ``rows(vec_id, label, vector)``; of rows alike in label and vector ``most_equal`` are needed.

    Roots are chosen farthest first from a bounded sample; every row goes to its nearest root, and what a root gathers
    is dealt by hash over cells of about ``CELL_ROWS`` rows. Covering radii are measured on all rows, so bounds hold
    whatever the sample was.
    """
    distinct = stored(vectors.distinct_rows(rows, most_equal, "label"))
    size, count = vectors.dimension(distinct), distinct.count()
    if not count:
        return None

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = vectors.matrix(batch.column(0), size)
                yield pa.RecordBatch.from_arrays([pa.array([float((found * found).sum(1).max())])], ["norm"])

    longest = math.sqrt(distinct.select("vector").mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0]) or 1.0
    order = F.xxhash64("vec_id", "label", "vector")
    share = min(1 << 30, (1 << 30) * 1.2 * SAMPLE_ROWS / count + (1 << 20))
    sample = distinct.where(F.pmod(order, F.lit(1 << 30)) < int(share)).orderBy(order, "vec_id").limit(SAMPLE_ROWS)
    points = _augmented(vectors.matrix(sample.select("vector").toArrow().column(0), size), longest)
    wanted = max(1, min(MAX_ROOTS, count // CELL_ROWS))
    start = int(_distances(points, points.mean(0)).argmin())
    chosen, _, _ = spread(points, points[start], 0.0, wanted)
    roots = points[[start, *chosen]]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside = _augmented(vectors.matrix(batch.column(2), size), longest)
            nearest = (inside @ roots.T).argmax(1) if len(inside) else np.zeros(0, np.int64)  # all norms are equal
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int32())], ["vec_id", "label", "vector", "first", "root"])

    placed = stored(distinct.select("vec_id", "label", "vector", "first").mapInArrow(
        place, "vec_id long, label long, vector array<double>, first boolean, root int"))
    sizes = np.zeros(len(roots), np.int64)
    for row in placed.groupBy("root").count().collect():
        sizes[row.root] = row["count"]
    splits = np.maximum(1, -(-sizes // CELL_ROWS))
    first_cell = np.cumsum(splits) - splits
    starts, counts = (F.array(*map(F.lit, x.tolist())) for x in (first_cell, splits))
    salt = F.pmod(F.xxhash64("vec_id", "label"), F.get(counts, F.col("root")))
    celled = placed.withColumn("cell", (F.get(starts, F.col("root")) + salt).cast("long"))

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        tree = Tree.build(
            vectors.matrix(table.column("vector"), size), table.column("vec_id").to_numpy(), table.column("label").to_numpy(),
            table.column("first").to_numpy(), roots[table.column("root")[0].as_py()], longest,
        )
        return pa.table({"cell": [key[0].as_py()], "root": pa.array([table.column("root")[0].as_py()], pa.int32()),
                         "radius": [float(tree.radii[0])], "tree": pa.array([tree.to_bytes()], pa.binary())})

    cells = stored(celled.groupBy("cell").applyInArrow(grow, "cell long, root int, radius double, tree binary"))
    radii = np.full(len(roots), -1.0)
    for row in cells.groupBy("root").agg(F.max("radius").alias("radius")).collect():
        radii[row.root] = row.radius
    return Forest(cells, roots, radii, first_cell, splits, size, longest)


_FOUND = "uid long, no int, score long, vec_id long"


def _bounded(scores: list[int]) -> list[int]:
    return [max(-(1 << 63), min(int(s), (1 << 63) - 1)) for s in scores]


def _make_windows(wanted: list[dict] | None, count: int, lowest: int, highest: int) -> list[Window_]:
    """Windows from the positives' scores, or one without bounds; each may know a floor."""
    found = []
    for w in wanted or []:
        if w["score"] is None:
            low, high = -math.inf, math.inf
        else:
            low, high = -(-lowest * w["score"] // 100), highest * w["score"] // 100
        floor = None if w["floor_id"] is None else (-w["floor_score"], w["floor_id"])
        found.append(Window_(low, high, count, floor))
    return found


def _asked(forest: Forest, anchors: DataFrame, count: int, percents: tuple[int, int], nearest: bool) -> DataFrame:
    """``anchors(uid, vec_id, label, vector, windows)`` with ``cell``: cells of the nearest root, or all others that may
    hold a result."""
    roots, radii, size, longest = forest.roots, forest.radii, forest.size, forest.longest
    first_cell, splits = forest.first_cell, forest.splits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                part = batch.slice(at, _BATCH)
                queries = vectors.matrix(part.column("vector"), size)
                low, high = score_bounds(queries, roots[:, :-1], np.maximum(radii, 0), longest)
                best = np.where(radii >= 0, queries @ roots[:, :-1].T, -np.inf).argmax(1)
                who, cells = [], []
                for i, wanted in enumerate(part.column("windows").to_pylist()):
                    windows = _make_windows(wanted, count, *percents)
                    for r in [best[i]] if nearest else range(len(roots)):
                        if radii[r] < 0 or (not nearest and r == best[i]):
                            continue
                        if any(w.admits(low[i, r], high[i, r], -(1 << 63)) for w in windows):
                            cells += range(first_cell[r], first_cell[r] + splits[r])
                            who += [i] * int(splits[r])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells, pa.int64()), *part.take(pa.array(who, pa.int64())).columns], ["cell", *part.schema.names])

    return anchors.mapInArrow(run, "cell long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema))


def _searched(forest: Forest, anchors: DataFrame, count: int, percents: tuple[int, int], same: bool, nearest: bool) -> DataFrame:
    """``(uid, no, score, vec_id)``: the ``count`` best rows of each window in each cell that an anchor is sent to."""
    size, longest = forest.size, forest.longest
    asks = stored(_asked(forest, anchors, count, percents, nearest))
    trees, asks = vectors.shared(forest.cells.select("cell", "tree"), asks, "cell", CELL_ANCHORS)
    columns = ["uid", "vec_id", "label", "vector", "windows"]
    kinds = {f.name: f.dataType for f in anchors.schema}
    trees = trees.select("cell", "share", F.lit(0).alias("kind"), "tree", *[F.lit(None).cast(kinds[c]).alias(c) for c in columns])
    asks = asks.select("cell", "share", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("tree"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            keys = np.array(batch.column("cell")) * 2 + np.array(batch.column("kind"))
            marks = np.flatnonzero((np.diff(keys) != 0) | (np.diff(np.array(batch.column("share"))) != 0)) + 1
            edges = [0, *marks.tolist(), batch.num_rows]
            for low, high in zip(edges[:-1], edges[1:]):
                if low == high:
                    continue
                if batch.column("kind")[low].as_py() == 0:
                    tree = Tree.from_bytes(batch.column("tree")[low].as_py(), longest)
                    continue
                for at in range(low, high, _BATCH):
                    part = batch.slice(at, min(_BATCH, high - at))
                    queries = vectors.matrix(part.column("vector"), size)
                    lowest, highest = score_bounds(queries, tree.centres, tree.radii, longest)
                    uids, ids, labels = (part.column(c).to_pylist() for c in ("uid", "vec_id", "label"))
                    out: list[list] = [[], [], [], []]
                    for i, wanted in enumerate(part.column("windows").to_pylist()):
                        windows = _make_windows(wanted, count, *percents)
                        descend(tree, queries[i], ids[i], labels[i], same, windows, lowest[i].tolist(), highest[i].tolist())
                        for no, w in enumerate(windows):
                            for score, vec_id in w.best:
                                for values, value in zip(out, (uids[i], no, -int(score), vec_id)):
                                    values.append(value)
                    out[2] = _bounded(out[2])
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["uid", "no", "score", "vec_id"])

    met = trees.union(asks).repartition("cell", "share").sortWithinPartitions("cell", "share", "kind")
    return met.mapInArrow(run, _FOUND)


def _best(found: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("uid", "no").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def _both_rounds(forest: Forest, anchors: DataFrame, count: int, percents: tuple[int, int], same: bool) -> DataFrame:
    """The ``count`` best rows of each window: first near the anchor, then wherever something better may be."""
    near = stored(_best(_searched(forest, anchors, count, percents, same, True), count))
    full = near.where(F.col("rank") == count).select("uid", F.struct("no", "score", "vec_id").alias("end"))
    ends = full.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("end.no", "end"))).alias("ends"))

    def with_floor(window: Column, no: Column) -> Column:
        end = F.col("ends")[no]
        return F.struct(window["score"].alias("score"), end["score"].alias("floor_score"), end["vec_id"].alias("floor_id"))

    known = anchors.join(ends, "uid", "left").select(
        "uid", "vec_id", "label", "vector", F.transform("windows", with_floor).alias("windows")
    )
    far = _searched(forest, known, count, percents, same, False)
    return _best(near.select("uid", "no", "score", "vec_id").union(far), count)


_SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    rows: DataFrame,
    every: int = 50,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percents: tuple[int, int] = (LOWEST_PERCENT, HIGHEST_PERCENT),
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows(vec_id, label, vector)`` hold vectors of whole numbers; anchors are the rows whose id ``every`` divides.
    Scores are inner products with the anchor, exact; higher ones come first, ties by smaller id. An anchor's
    positives are the first ``positives`` other rows of its label; for each of them the first ``negatives`` rows of
    other labels are returned whose scores lie between the two ``percents`` of the positive's.

    Rows without id, label or usable vector take no part; a shorter vector counts as continued by zeros. A repeated
    row is one more row: an anchor of its own, and a candidate for the other. Of rows alike in label and vector only
    the smallest ids can be results, so the rest are dropped before trees are built. Scores beyond 64 bits are ranked
    exactly and returned as the nearest long. An empty table gives an empty result; further columns are ignored.
    """
    ready = stored(
        rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector").where(
            F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vectors.usable("vector")
        )
    )
    forest = build_forest(ready, max(positives + 1, negatives))
    if forest is None:
        return rows.sparkSession.createDataFrame([], _SCHEMA)
    window = "score long, floor_score long, floor_id long"
    free = F.array(F.struct(*[F.lit(None).cast("long").alias(c.split()[0]) for c in window.split(", ")]))
    anchors = stored(
        ready.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", "vector",
                                                         free.alias("windows"))
    )
    liked = stored(_both_rounds(forest, anchors, positives, percents, True).select(
        "uid", (F.col("rank") - 1).alias("no"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    ))
    wanted = liked.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("no", "positive_score"))).alias("liked"))
    no_floor = [F.lit(None).cast("long").alias(c) for c in ("floor_score", "floor_id")]
    windows = F.transform("liked", lambda x: F.struct(x["positive_score"].alias("score"), *no_floor))
    asking = stored(anchors.drop("windows").join(wanted, "uid").select("uid", "vec_id", "label", "vector", windows.alias("windows")))
    found = _both_rounds(forest, asking, negatives, percents, False).withColumnsRenamed(
        {"vec_id": "negative_id", "score": "negative_score"}
    )
    named = found.join(liked, ["uid", "no"]).join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
