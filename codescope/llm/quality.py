"""Quality of documents by co-training two classifiers, one on the text and one on the page's metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import WordHasher, text_buffers

#: Labelled and unlabelled documents that are sampled, at most; every third labelled one calibrates.
LABELLED, UNLABELLED = 12_000, 12_000
ROUNDS = 4
#: Pseudo-labels given per round and view, at most, and the probability they need.
EXCHANGED, CONFIDENT = 1_000, 0.97
#: Documents below this probability of good quality are rejected.
KEEP = 0.5
HASHED = 64

_SENTENCE_MARKS = np.zeros(256, bool)
_SENTENCE_MARKS[list(b".,;:?!'\"()-")] = True
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = True
_BYTE_KINDS = {
    "upper": np.isin(np.arange(256), np.arange(0x41, 0x5B)),
    "digit": np.isin(np.arange(256), np.arange(0x30, 0x3A)),
    "mark": _SENTENCE_MARKS,
    "symbol": _SYMBOLS,
    "wide": np.arange(256) >= 0x80,
    "line": np.arange(256) == 0x0A,
    "bang": np.arange(256) == 0x21,
    "bar": np.arange(256) == 0x7C,
}
TEXT_FEATURES = [*_BYTE_KINDS, "words", "word_bytes", "distinct", "repeats", "repeats_2", "commonest"]


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of shares and logarithms for each text, from whole texts; null and empty texts are all zero."""
    offsets, data = text_buffers(texts)
    out = np.zeros((len(texts), len(TEXT_FEATURES)), np.float32)
    for first, counts, hashes in WordHasher().rows(texts):
        last = first + len(counts)
        low, high = offsets[first], offsets[last]
        part, inner = data[low:high], offsets[first : last + 1] - low
        sizes = np.maximum(np.diff(inner), 1)
        for i, table in enumerate(_BYTE_KINDS.values()):
            out[first:last, i] = np.diff(np.searchsorted(np.flatnonzero(table[part]), inner)) / sizes
        rows = np.repeat(np.arange(len(counts)), counts)
        n = np.maximum(counts, 1)
        order = np.lexsort((hashes, rows))
        same = np.zeros(len(order), bool)
        same[1:] = (rows[order][1:] == rows[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
        starts = np.flatnonzero(~same)
        lengths = np.diff(np.append(starts, len(order)))
        commonest = np.zeros(len(counts))
        np.maximum.at(commonest, rows[order][starts], lengths)
        at = len(_BYTE_KINDS)
        out[first:last, at] = np.log1p(counts)
        out[first:last, at + 1] = np.log1p(sizes / n) * (counts > 0)
        out[first:last, at + 2] = np.bincount(rows[order][starts], minlength=len(counts)) / n
        for step in (1, 2):
            again = (hashes[step:] == hashes[:-step]) & (rows[step:] == rows[:-step])
            out[first:last, at + 2 + step] = np.bincount(rows[step:][again], minlength=len(counts)) / n
        out[first:last, at + 5] = commonest / n
    return out


def page_features(source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """Hashed source and language, and the logarithm of the stated length; null is a value of its own."""
    out = np.zeros((len(source), HASHED + 2), np.float32)
    for name, column in (("source", source), ("lang", lang)):
        values = column.dictionary_encode()
        places = np.array([_bucket(f"{name}={v}") for v in values.dictionary.to_pylist()] + [_bucket(f"{name} is null")])
        numbers = values.indices.fill_null(len(places) - 1).to_numpy(zero_copy_only=False)
        np.add.at(out, (np.arange(len(source)), places[numbers]), 1)
    sizes = n_chars.cast(pa.float64()).fill_null(-1).to_numpy(zero_copy_only=False)
    out[:, HASHED] = np.log1p(np.maximum(sizes, 0))
    out[:, HASHED + 1] = sizes < 0
    return out


def _bucket(value: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(value.encode(), 1) % HASHED


@dataclass
class Logistic:
    """Logistic regression on standardised features and their squares."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        centre, spread = x.mean(axis=0), x.std(axis=0)
        model = cls(centre, np.where(spread > 1e-6, spread, 1.0), np.zeros(2 * x.shape[1] + 1))
        z = model._expand(x)
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-3
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ model.weights, -30, 30)))
            curve = np.maximum(p * (1 - p), 1e-6)
            hessian = (z * curve[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(hessian, z.T @ (p - y) + penalty * model.weights)
            model.weights -= step
            if np.abs(step).max() < 1e-5:
                break
        return model

    def _expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.spread, -8, 8)
        return np.hstack([z, z * z / 8, np.ones((len(z), 1))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self._expand(x) @ self.weights if len(x) else np.zeros(0)


def _calibrated(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make ``logits`` log odds of ``y``."""
    x = np.stack([np.clip(logits, -15, 15), np.ones(len(logits))], axis=1)
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (p - goal))
        w -= np.clip(step, -2, 2)
    return float(max(w[0], 0.0)), float(w[1])


@dataclass
class CoTrained:
    """Both views, the calibration of each, and the log odds of good quality among labelled documents."""

    views: list[Logistic]
    scales: list[tuple[float, float]]
    prior: float

    def log_odds(self, features: list[np.ndarray]) -> np.ndarray:
        """One column for each view, and the combined one: given the label the views are taken as independent."""
        each = [a * np.clip(v.logits(x), -15, 15) + b for v, x, (a, b) in zip(self.views, features, self.scales)]
        return np.stack([*each, sum(each) - self.prior * (len(each) - 1)], axis=1)


def co_train(features: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS) -> CoTrained | None:
    """Two views of labelled rows and of a pool of unlabelled ones; None unless both labels occur often enough.

    In every round each view is fitted and calibrated; the pool's documents of which it is most certain, in
    proportion to the labels' shares, are given to the other view with its label. A view that is never certain, like
    metadata that says nothing, gives none.
    """
    held = np.arange(len(y)) % 3 == 2
    if min(y[~held].sum(), (1 - y[~held]).sum(), y[held].sum(), (1 - y[held]).sum()) < 2:
        return None
    prior = float(np.log(y.mean() / (1 - y.mean())))
    given: list[dict[int, int]] = [{}, {}]  # pseudo-labels that each view has received
    for last in range(rounds + 1):
        views, scales = [], []
        for x, more, labels in zip(features, pool, given):
            rows, values = np.array(list(labels), int), np.array(list(labels.values()), float)
            view = Logistic.fit(np.vstack([x[~held], more[rows]]), np.concatenate([y[~held], values]))
            views.append(view)
            scales.append(_calibrated(view.logits(x[held]), y[held]))
        if last == rounds or not len(pool[0]):
            break
        for i, (view, more, (a, b)) in enumerate(zip(views, pool, scales)):
            odds = a * np.clip(view.logits(more), -15, 15) + b
            for label, sign, share in ((1, 1, y.mean()), (0, -1, 1 - y.mean())):
                best = np.argsort(-sign * odds, kind="stable")[: int(EXCHANGED * share)]
                sure = best[sign * odds[best] >= np.log(CONFIDENT / (1 - CONFIDENT))]
                given[1 - i].update((int(row), label) for row in sure if int(row) not in given[1 - i])
    return CoTrained(views, scales, prior)


def _features(batch: pa.RecordBatch, at: dict[str, int]) -> list[np.ndarray]:
    text, source, lang, n_chars = (batch.column(at[c]) for c in ("text", "source", "lang", "n_chars"))
    return [text_features(text), page_features(source, lang, n_chars)]


def _sampled(docs: DataFrame, ids: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Both views and the labels (-1: none) of the documents in ``ids(doc_id, label)``, in order of the id's hash.

    Of the rows that share an id the one with the smallest features is taken, so reruns agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = np.hstack(_features(batch, {"text": 2, "source": 3, "lang": 4, "n_chars": 5})).astype(np.float32)
            rows = pa.array(list(views), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], ["doc_id", "label", "x"])

    rows = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    rows = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text", "source", "lang", "n_chars")
    views = rows.mapInArrow(run, "doc_id {kind}, label int, x array<float>".format(kind=docs.schema["doc_id"].dataType.simpleString()))
    single = views.groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("row"))  # one row of a repeated id
    found = single.select(F.xxhash64("doc_id").alias("place"), "row.*").orderBy("place", "label", "x").collect()
    width = len(TEXT_FEATURES)
    x = np.array([r.x for r in found], np.float32).reshape(len(found), width + HASHED + 2)
    return [x[:, :width], x[:, width:]], np.array([r.label for r in found], float)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> CoTrained | None:
    """A model from at most ``labelled`` rows of ``labels(doc_id, quality)`` and ``unlabelled`` other documents.

    Both samples are those with the smallest hashes of the id; only their feature rows come to the driver. Labels
    other than 0 and 1 are ignored, and of several labels of one document the smallest counts.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    usable = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    known = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    spare = docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(unlabelled)
    ids = spare.distinct().select("doc_id", F.lit(-1).alias("label")).union(known).groupBy("doc_id").agg(F.max("label").alias("label"))
    views, y = _sampled(docs, ids)
    return co_train([v[y >= 0] for v in views], y[y >= 0], [v[y < 0] for v in views]) if len(y) else None


def scored(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """``docs`` with ``p_text``, ``p_page`` and ``p_quality``: the probability of good quality by either view and both.

    Every row is scored where it is read, from its whole text; nothing is shuffled. Null and empty texts, null
    metadata, repeated rows and very long texts are scored like any other. If there was nothing to train on all three
    are 1. Columns of these names are replaced; an empty table gives an empty result.
    """
    new = ["p_text", "p_page", "p_quality"]
    docs = docs.drop(*new)
    if model is None:
        return docs.select("*", *[F.lit(1.0).alias(c) for c in new])
    at = {c: docs.columns.index(c) for c in ("text", "source", "lang", "n_chars")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = model.log_odds(_features(batch, at))
            more = [pa.array(column) for column in (1 / (1 + np.exp(-np.clip(odds, -50, 50)))).T]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *new])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in new]]))
