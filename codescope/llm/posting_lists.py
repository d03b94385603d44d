"""Approximate nearest neighbours by inner product: balanced posting lists behind a graph of their centroids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codescope.plans.lineage import stored

from . import vectors

TOP = 20
#: Vectors that the centroids, their graph and the ratio are fitted on, and the most components they may have together.
SAMPLE_ROWS, SAMPLE_VALUES = 1 << 16, 1 << 22
#: Vectors for each list, as long as lists do not exceed ``MAX_LISTS``; beyond that lists grow and are split into bins.
LIST_ROWS, MAX_LISTS = 64, 8192
#: A vector is also put into lists whose centroid is at most this much farther than the nearest one.
REPLICAS, BOUNDARY = 4, 1.06
#: Share of the sample's true neighbours whose list the ratio must reach.
REACHED = 0.97
DEGREE, POOL, WIDTH = 16, 48, 4
#: Rows of one bin, and queries that one copy of its rows serves; of either, components that a task holds at a time.
BIN_ROWS, BIN_QUERIES, BIN_VALUES = 1 << 14, 1 << 14, 1 << 20
#: Bins that follow each other are read by one task, if there are more than this.
MAX_GROUPS = 32

_BATCH = 512
#: Distances from points to all centroids that stand side by side: 8 MB.
_DISTANCES = 1 << 20
#: Nodes of the graph whose links are followed at once.
_LEAVING = 1 << 16
#: Queries whose scores with all rows of a bin stand side by side: 32 MB.
_ASKING = 256
_MARGIN = 8
#: Scores of unit vectors that differ by no more are told apart by exact ones.
_ALIKE = 1e-11


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T)


def _halves(points: np.ndarray, at: np.ndarray, count: int, rng: np.random.Generator) -> list[np.ndarray]:
    """``at`` parted into ``count`` sets of equal size, near ones next to each other, by repeated two-means."""
    if count <= 1 or len(at) <= 1:
        return [at]
    left = count // 2
    cut = len(at) * left // count
    a, b = points[rng.choice(at, 2, replace=False)]
    for _ in range(4):
        order = at[np.argsort(points[at] @ (b - a), kind="stable")]
        a, b = points[order[:cut]].mean(0), points[order[cut:]].mean(0)
    return _halves(points, order[:cut], left, rng) + _halves(points, order[cut:], count - left, rng)


@dataclass
class Graph:
    """Centroids in tree order, each linked to near ones in many directions and to its neighbours in that order."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    def near(self, points: np.ndarray, ratio: float, least: int) -> np.ndarray:
        """Distances from ``points`` to the centroids that a search through the graph meets, infinite for others.

        The search leaves the nearest centroids not yet left, ``WIDTH`` at a time, until ``least`` have been left, and
        then all that it meets within ``ratio`` times the distance of the nearest one.
        """
        n = len(self.centroids)
        distances = np.sqrt(_squared(points, self.centroids))
        met, waiting = np.zeros(distances.shape, bool), np.full(distances.shape, np.inf)
        met[:, self.entries] = True
        waiting[:, self.entries] = distances[:, self.entries]
        nearest, every = np.full(len(points), np.inf), np.arange(len(points))

        def leave(rows: np.ndarray, nodes: np.ndarray) -> None:
            waiting[rows, nodes] = np.inf
            for low in range(0, len(rows), _LEAVING):
                at = (rows[low : low + _LEAVING, None] * n + self.links[nodes[low : low + _LEAVING]]).ravel()
                at = at[~met.ravel()[at]]
                met.ravel()[at] = True
                waiting.ravel()[at] = distances.ravel()[at]

        for _ in range(-(-least // WIDTH)):
            nearest = np.minimum(nearest, waiting.min(1))
            rows, nodes = [], []
            for _ in range(min(WIDTH, n)):
                best = waiting.argmin(1)
                some = every[np.isfinite(waiting[every, best])]
                rows.append(some)
                nodes.append(best[some])
                waiting[some, best[some]] = np.inf
            leave(np.concatenate(rows), np.concatenate(nodes))
        while True:
            nearest = np.minimum(nearest, waiting.min(1))
            bound = np.where(met.all(1), -np.inf, nearest * ratio)  # once all are met there is nothing to look for
            rows, nodes = np.nonzero((waiting <= bound[:, None]) & np.isfinite(waiting))
            if not len(rows):
                return np.where(met, distances, np.inf)
            leave(rows, nodes)


def _together(values: int) -> int:
    """Points whose distances to ``values`` centroids stand side by side."""
    return max(1, min(_BATCH, _DISTANCES // max(1, values)))


def fit_graph(points: np.ndarray, lists: int, seed: int = 11) -> Graph:
    """Centroids of balanced parts of ``points`` and their graph."""
    rng = np.random.default_rng(seed)
    parts = [p for p in _halves(points, np.arange(len(points)), lists, rng) if len(p)]
    centroids = np.array([points[p].mean(0) for p in parts])
    n = len(centroids)
    links = np.repeat(np.arange(n)[:, None], DEGREE + 2, axis=1)
    for low in range(0, n, _together(n)):
        squared = _squared(centroids[low : low + _together(n)], centroids)
        pool = np.argsort(squared, axis=1, kind="stable")[:, : POOL + 1]
        for i, near in enumerate(pool.tolist(), start=low):
            chosen: list[int] = []
            for j in near:  # a centroid that is nearer to a chosen one is reached over that
                if j != i and len(chosen) < DEGREE:
                    if not chosen or ((centroids[chosen] - centroids[j]) ** 2).sum(1).min() > squared[i - low, j]:
                        chosen.append(j)
            chosen += [j for j in near if j != i and j not in chosen][: DEGREE - len(chosen)]
            chosen += [max(i - 1, 0), min(i + 1, n - 1)]
            links[i, : len(chosen)] = chosen
    entries = np.unique(np.linspace(0, n - 1, min(n, max(4, int(n**0.5)))).astype(np.int64))
    return Graph(centroids, links, entries)


def lists_of(points: np.ndarray, graph: Graph, replicas: int = REPLICAS, boundary: float = BOUNDARY) -> list[np.ndarray]:
    """The lists of each vector, nearest first: those within ``boundary`` of the nearest distance."""
    found, step = [], _together(len(graph.centroids))
    for low in range(0, len(points), step):
        distances = graph.near(points[low : low + step], boundary, 2 * replicas)
        every, k = np.arange(len(distances)), min(replicas, distances.shape[1])
        best, ahead = np.empty((len(distances), k), np.int64), np.empty((len(distances), k))
        for i in range(k):
            best[:, i] = distances.argmin(1)
            ahead[:, i] = distances[every, best[:, i]]
            distances[every, best[:, i]] = np.inf
        within = np.isfinite(ahead) & (ahead <= ahead[:, :1] * boundary)
        found += [b[w] for b, w in zip(best, within)]
    return found


def fit_ratio(points: np.ndarray, queries: np.ndarray, own: np.ndarray, graph: Graph, top: int, reached: float) -> float:
    """The distance ratio within which lists must be read to find the share ``reached`` of the true neighbours.

    ``queries`` are rows ``own`` of ``points`` as queries; their true neighbours in the sample are found by brute force.
    """
    nearest, shares = [], []
    for low in range(0, len(queries), 64):
        part = queries[low : low + 64]
        scores = part @ points.T
        scores[np.arange(len(part)), own[low : low + 64]] = -np.inf
        few = min(top, len(points) - 1)
        nearest.append(np.argpartition(-scores, max(few - 1, 0), axis=1)[:, :few])
        distances = np.sqrt(_squared(part, graph.centroids))
        shares.append(distances / np.maximum(distances.min(1, keepdims=True), 1e-300))
    met = np.unique(np.concatenate([best.ravel() for best in nearest])) if nearest else np.zeros(0, np.int64)
    lists = dict(zip(met.tolist(), lists_of(points[met], graph)))  # of the neighbours alone, however large the sample is
    needed = [
        share[lists[j]].min() for best, part in zip(nearest, shares) for row, share in zip(best.tolist(), part) for j in row
    ]
    return float(max(1.0, np.quantile(needed, reached))) if needed else 1.0


@dataclass
class Index:
    """``rows(bin, vec_id, first, vector, list, earlier)`` by bins, and what finds the bins of a query."""

    rows: DataFrame | None
    graph: Graph | None
    ratio: float
    first_bin: np.ndarray
    bins: np.ndarray
    own_rows: np.ndarray  # rows of each list for which it is the nearest
    size: int
    longest: float
    top: int


def _norms(rows: np.ndarray) -> np.ndarray:
    most = np.abs(rows).max(1, keepdims=True)
    return (most * np.sqrt(((rows / most) ** 2).sum(1, keepdims=True)))[:, 0]


def _as_points(rows: np.ndarray, longest: float) -> np.ndarray:
    """Rows of one norm, by one more component: the nearest of them to a query are those of largest inner product."""
    scaled = rows / longest
    rest = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(1, keepdims=True)))
    return np.concatenate([scaled, rest], axis=1)


def _as_queries(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([rows / _norms(rows)[:, None], np.zeros((len(rows), 1))], axis=1)


def prepared(rows: DataFrame) -> DataFrame:
    """``(vec_id, vector)`` of the rows that take part: an id, and a usable vector that is not zero."""
    vector = F.col("embedding").cast("array<double>")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(
        F.col("vec_id").isNotNull() & vectors.usable("vector") & F.exists("vector", lambda x: x != 0)
    )


def build_index(rows: DataFrame, top: int = TOP, reached: float = REACHED) -> Index:
    """Index every row of ``prepared`` ``rows`` for searches of the ``top`` nearest.

    Centroids are fitted on a bounded sample (by hash, at most ``SAMPLE_ROWS`` rows), every row is then put into its
    lists. Lists are packed into bins of about ``BIN_ROWS`` rows (fewer of long vectors) in tree order, so that a query
    meets few bins; a list that is longer is dealt over bins of its own by a hash.
    """
    distinct = stored(vectors.distinct_rows(rows, top + 1))
    size, count = vectors.dimension(distinct), distinct.count()
    if not count:
        return Index(distinct, None, 1.0, np.zeros(0), np.zeros(0), np.zeros(0), size, 1.0, top)

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([_norms(vectors.matrix(batch.column(0), size)).max()])], ["norm"])

    most = float(distinct.select("vector").mapInArrow(longest, "norm double").agg(F.max("norm")).first()[0])
    wanted = min(SAMPLE_ROWS, max(1, SAMPLE_VALUES // size))
    order = F.xxhash64("vec_id", "vector")
    share = min(1 << 30, (1 << 30) * 1.1 * wanted / count + (1 << 20))
    sample = distinct.where(F.pmod(order, F.lit(1 << 30)) < int(share)).orderBy(order, "vec_id").limit(wanted)
    sampled = vectors.matrix(sample.select("vector").toArrow().column(0), size)
    points = _as_points(sampled, most)
    graph = fit_graph(points, max(1, min(MAX_LISTS, count // LIST_ROWS, len(points) // 8)))
    asked = np.arange(0, len(points), max(1, len(points) // 512))
    ratio = fit_ratio(points, _as_queries(sampled[asked]), asked, graph, top, reached)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = lists_of(_as_points(vectors.matrix(batch.column(1), size), most), graph) if batch.num_rows else []
            lists = pa.array([x.tolist() for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["vec_id", "vector", "first", "lists"])

    assigned = stored(distinct.select("vec_id", "vector", "first").mapInArrow(
        assign, "vec_id long, vector array<double>, first boolean, lists array<int>"))
    sizes, own_rows = np.zeros((2, len(graph.centroids)), np.int64)
    each = assigned.select(F.posexplode("lists").alias("place", "list"))
    for row in each.groupBy("list").agg(F.count("*").alias("n"), F.count_if(F.col("place") == 0).alias("own")).collect():
        sizes[row.list], own_rows[row.list] = row.n, row.own
    most_rows = min(BIN_ROWS, max(1, BIN_VALUES // size))
    bins = np.maximum(1, -(-sizes // most_rows))
    first_bin, at, room = np.zeros(len(sizes), np.int64), 0, most_rows
    for i, n in enumerate(sizes.tolist()):
        if n > room and room < most_rows:
            at, room = at + 1, most_rows
        first_bin[i] = at
        at, room = (at + int(bins[i]), most_rows) if bins[i] > 1 else (at, room - n)
    placed = assigned.select("vec_id", "first", "vector", "lists", F.posexplode("lists").alias("place", "list"))
    starts, counts = (F.array(*map(F.lit, x.tolist())) for x in (first_bin, bins))
    salt = F.pmod(F.xxhash64("vec_id"), F.get(counts, F.col("list")))
    placed = placed.select(
        (F.get(starts, F.col("list")) + salt).cast("long").alias("bin"), "vec_id", "first", "vector", "list",
        F.slice("lists", 1, F.col("place")).alias("earlier"),
    )
    return Index(placed, graph, ratio, first_bin, bins, own_rows, size, most, top)


def _nth(query: np.ndarray) -> np.ndarray:
    """The place of each row among those of its query, which stand together."""
    begins = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    return np.arange(len(query)) - np.repeat(begins, np.diff(np.append(begins, len(query))))


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """Positions of each query's ``top`` candidates, by score descending, then id."""
    order = np.lexsort((ids, -scores, query))
    return order[_nth(query[order]) < top]


class Bin:
    """The rows of one bin, by list."""

    def __init__(self, index_size: int, longest: float, top: int, table: pa.Table):
        self.top = top
        ids, lists = table.column("vec_id").to_numpy(), table.column("list").to_numpy()
        order = np.lexsort((ids, lists))
        self.ids, self.lists = ids[order], lists[order]
        self.first = table.column("first").to_numpy(zero_copy_only=False)[order]
        self.rows = vectors.matrix(table.column("vector"), index_size)[order]
        self.longest, self.scaled = longest, self.rows / longest
        self.by_id = np.argsort(self.ids, kind="stable")
        self.sorted_ids = self.ids[self.by_id]
        earlier = table.column("earlier").to_pylist()
        self.earlier = np.full((len(order), max(1, REPLICAS - 1)), -1, np.int64)
        for to, at in enumerate(order.tolist()):
            self.earlier[to, : len(earlier[at])] = earlier[at]

    def _candidates(self, queries: np.ndarray, query_ids: np.ndarray, probed: list[list[int]] | np.ndarray, lists: int,
                    least: np.ndarray | None = None):
        """(query position, row): each query's best rows of all its lists here, ``top`` and some more, and all like the last.

        ``probed`` names lists, or says of every list and of none whether it is read. Rows that score less than ``least``
        are left out.
        """
        reads = probed
        if not isinstance(probed, np.ndarray):
            reads = np.zeros((len(queries), lists + 1), bool)  # the last column stands for no list
            for i, chosen in enumerate(probed):
                reads[i, chosen] = True
        norms = _norms(queries)
        unit = queries / norms[:, None]
        scores = np.full((len(queries), len(self.ids)), -np.inf)
        edges = np.flatnonzero(np.concatenate([[True], np.diff(self.lists) != 0, [True]]))
        for low, high in zip(edges[:-1], edges[1:]):
            asking = np.flatnonzero(reads[:, self.lists[low]])
            if len(asking) == len(queries):
                np.matmul(unit, self.scaled[low:high].T, out=scores[:, low:high])
            elif len(asking):
                scores[asking, low:high] = unit[asking] @ self.scaled[low:high].T
        again = reads[:, self.earlier[:, 0]]
        for earlier in self.earlier.T[1:]:
            again |= reads[:, earlier]
        np.putmask(scores, again, -np.inf)
        own = np.searchsorted(self.sorted_ids, query_ids, "left"), np.searchsorted(self.sorted_ids, query_ids, "right")
        for i in np.flatnonzero(own[0] < own[1]).tolist():
            for at in self.by_id[own[0][i] : own[1][i]]:
                if self.first[at] and np.array_equal(queries[i], self.rows[at]):
                    scores[i, at] = -np.inf
        keep, floor = self.top + _MARGIN, np.full(len(queries), -np.inf)
        if least is not None:
            floor = least / norms / self.longest - _ALIKE
            floor[~np.isfinite(floor)] = -np.inf
        many = np.flatnonzero(np.count_nonzero(scores >= floor[:, None], axis=1) > keep)
        if len(many):
            last = np.partition(scores[many], scores.shape[1] - keep, axis=1)[:, -keep]
            floor[many] = np.maximum(floor[many], last - _ALIKE)
        return np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))

    def search(self, queries: np.ndarray, query_ids: np.ndarray, probed: list[list[int]] | np.ndarray, lists: int,
               least: np.ndarray | None = None):
        """(query position, vec_id, score) of the best rows in the probed lists of this bin.

        ``probed`` names all lists of a query: a vector in several of them is scored in the first alone.
        """
        parts = [slice(low, low + _ASKING) for low in range(0, len(queries), _ASKING)]
        found = [self._candidates(queries[p], query_ids[p], probed[p], lists, None if least is None else least[p]) for p in parts]
        who = np.concatenate([p.start + asking for p, (asking, _) in zip(parts, found)])
        row = np.concatenate([at for _, at in found])
        scores = np.empty(len(who))
        for low in range(0, len(who), 1 << 14):
            part = slice(low, low + (1 << 14))
            scores[part] = np.add.accumulate(queries[who[part]] * self.rows[row[part]], axis=1)[:, -1]
        best = _best(who, self.ids[row], scores, self.top)
        return who[best], self.ids[row[best]], scores[best]


class Asked:
    """Queries that one task serves, and the best rows of the bins they have met so far.

    ``reads`` has a bit for each list, by query. What a query has found bounds what the next bins need to show.
    """

    def __init__(self, uids: np.ndarray, ids: np.ndarray, queries: np.ndarray, reads: np.ndarray, lists: int, top: int):
        self.uids, self.ids, self.queries, self.reads, self.lists, self.top = uids, ids, queries, reads, lists, top
        self.count = np.zeros(len(ids), np.int64)
        self.found, self.scores = np.zeros((len(ids), top), np.int64), np.zeros((len(ids), top))

    def meet(self, held: Bin) -> None:
        for low in range(0, len(self.ids), _ASKING):
            part = slice(low, low + _ASKING)
            reads = np.unpackbits(self.reads[part], axis=1, count=self.lists + 1, bitorder="little").view(bool)
            least = np.where(self.count[part] == self.top, self.scores[part, -1], -np.inf)
            who, found, scores = held.search(self.queries[part], self.ids[part], reads, self.lists, least)
            if not len(who):
                continue
            changed = low + np.unique(who)
            before, nth = np.nonzero(np.arange(self.top) < self.count[changed, None])
            who = np.concatenate([changed[before], low + who])
            found = np.concatenate([self.found[changed[before], nth], found])
            scores = np.concatenate([self.scores[changed[before], nth], scores])
            best = _best(who, found, scores, self.top)
            who, nth = who[best], _nth(who[best])
            self.found[who, nth], self.scores[who, nth] = found[best], scores[best]
            self.count[changed] = np.bincount(who - low, minlength=_ASKING)[changed - low]

    def results(self) -> Iterator[pa.RecordBatch]:
        """``(uid, query_id, vec_id, score)``."""
        for low in range(0, len(self.ids), _BATCH):
            who, nth = np.nonzero(np.arange(self.top) < self.count[low : low + _BATCH, None])
            who += low
            values = self.uids[who], self.ids[who], self.found[who, nth], self.scores[who, nth]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in values], ["uid", "query_id", "vec_id", "score"])


def lists_to_read(points: np.ndarray, index: Index) -> np.ndarray:
    """Which lists each query reads: those within the ratio, and the nearest ones until they hold ``top`` other rows."""
    distances = index.graph.near(points, index.ratio, 2 * REPLICAS)
    while True:
        within = distances <= distances.min(1, keepdims=True) * index.ratio
        order = np.argsort(distances, axis=1, kind="stable")
        met = np.isfinite(np.take_along_axis(distances, order, 1))
        held = np.cumsum(index.own_rows[order] * met, axis=1)
        needed = (held - index.own_rows[order] * met <= index.top) & met
        np.put_along_axis(needed, order, needed.copy(), 1)
        lacking = (held[:, -1] <= index.top) & ~met.all(1)
        if not lacking.any():
            return within | needed
        distances[lacking] = np.sqrt(_squared(points[lacking], index.graph.centroids))  # the graph has shown too few


def asking(batch: pa.RecordBatch, index: Index, together: int) -> Iterator[pa.RecordBatch]:
    """``(uid, query_id, vector)`` with the lists that each query reads, one bit for each, and the groups of bins that hold them.

    One row for each query, whatever the number of lists and bins.
    """
    groups = int((index.first_bin + index.bins).max() - 1) // together + 1
    first, last = index.first_bin // together, (index.first_bin + index.bins - 1) // together
    step = _together(len(index.graph.centroids))
    for low in range(0, batch.num_rows, step):
        part = batch.slice(low, step)
        within = lists_to_read(_as_queries(vectors.matrix(part.column(2), index.size)), index)
        who, chosen = np.nonzero(within)
        edges = np.zeros((part.num_rows, groups + 1), np.int64)
        np.add.at(edges, (who, first[chosen]), 1)
        np.add.at(edges, (who, last[chosen] + 1), -1)
        bits = np.packbits(np.pad(within, ((0, 0), (0, 1))), axis=1, bitorder="little")
        where = [np.flatnonzero(x).astype(np.int32) for x in np.cumsum(edges, axis=1)]
        yield pa.RecordBatch.from_arrays(
            [*part.columns, pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(where, pa.list_(pa.int32()))],
            ["uid", "query_id", "vector", "reads", "groups"],
        )


def search(index: Index, queries: DataFrame) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the nearest rows found for each of the ``prepared`` ``queries``.

    Of the rows with the query's own id and vector one is its own and is left out. Every query goes to the bins of
    the lists within the fitted ratio, and of more until these hold ``top`` rows. A task reads the bins of a group one
    after the other, for all queries that ask for them; what very many queries ask for is repeated, so that no task
    serves more than ``BIN_QUERIES`` of them.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    if index.graph is None:
        return queries.sparkSession.createDataFrame([], schema)
    size, top, longest, lists = index.size, index.top, index.longest, len(index.graph.centroids)
    plan = replace(index, rows=None)  # what tasks need of it
    together = max(1, -(-int((index.first_bin + index.bins).max()) // MAX_GROUPS))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from asking(batch, plan, together)

    asked = queries.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").alias("query_id"), "vector")
    asked = stored(stored(asked).mapInArrow(
        probe, "uid long, query_id long, vector array<double>, reads binary, groups array<int>"))
    probes = asked.select(F.explode("groups").alias("group"), "uid", "query_id", "vector", "reads")
    rows = index.rows.withColumn("group", F.expr(f"cast(bin div {together} as int)"))
    rows, probes = vectors.shared(rows, probes, "group", min(BIN_QUERIES, max(1, BIN_VALUES // size)))
    none = F.lit(None)
    wanting = probes.select(
        "group", "share", F.lit(-1).cast("long").alias("bin"), "uid", F.col("query_id").alias("vec_id"), F.lit(False).alias("first"),
        "vector", F.lit(-1).alias("list"), none.cast("array<int>").alias("earlier"), "reads",
    )
    rows = rows.select(
        "group", "share", "bin", F.lit(0).cast("long").alias("uid"), "vec_id", "first", "vector", "list", "earlier",
        none.cast("binary").alias("reads"),
    )

    def served(parts: list[pa.RecordBatch]) -> Asked:
        table = pa.Table.from_batches(parts)
        reads = np.frombuffer(b"".join(table.column("reads").to_pylist()), np.uint8).reshape(len(table), -1)
        ids, uids = table.column("vec_id").to_numpy(), table.column("uid").to_numpy()
        return Asked(uids, ids, vectors.matrix(table.column("vector"), size), reads, lists, top)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, here = None, [], None  # key: (group, share, bin) of the parts, which for queries is the bin -1
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("group", "share", "bin")]))
            edges = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for low, high in zip(edges[:-1], edges[1:]):
                now = keys[low]
                if now != key:
                    here = ended(key, parts, here)
                    if here is not None and now[:2] != key[:2]:
                        yield from here.results()
                    key, parts = now, []
                parts.append(batch.slice(low, high - low))
        here = ended(key, parts, here)
        if here is not None:
            yield from here.results()

    def ended(key: tuple[int, int, int] | None, parts: list[pa.RecordBatch], here: Asked | None) -> Asked | None:
        if key is None:
            return None
        if key[2] < 0:
            return served(parts)
        names = ["vec_id", "first", "vector", "list", "earlier"]
        here.meet(Bin(size, longest, top, pa.Table.from_batches([part.select(names) for part in parts])))
        return here

    met = wanting.union(rows).repartition("group", "share").sortWithinPartitions("group", "share", "bin")
    found = met.mapInArrow(meet, "uid long, query_id long, vec_id long, score double")
    order = Window.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, every: int = 20, top: int = TOP, reached: float = REACHED) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows of ``rows(vec_id, embedding)`` whose id ``every`` divides.

    Nearness is the inner product in doubles, summed from the first component on; ties go to the smaller id. Vectors
    that are null, empty or zero or have a null or non-finite component take no part, nor do rows without an id. A
    vector that is shorter than others counts as continued by zeros. A repeated row is one more query and one more
    candidate. An empty table gives an empty result; further columns are ignored.

    Approximate: lists are read within a distance ratio that found the share ``reached`` of the true neighbours in the
    sample. What is found is scored exactly.
    """
    ready = stored(prepared(rows))
    return search(build_index(ready, top, reached), ready.where(F.col("vec_id") % every == 0))
