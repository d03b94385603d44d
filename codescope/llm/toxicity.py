"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel of two words counts the triples of symbols that both hold in the same order, each weighted by a decay to
the power of the stretch it spans, so gaps and inserted characters cost something but do not hide an insult. A value
of the kernel against landmark words is a sum over triples, and so is the decision of the machine: after training all
landmarks are folded into one weight per triple, and scoring a text takes one pass of table lookups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescope.plans.joins import fits_broadcast
from codescope.plans.lineage import stored

from .words import ASCII_PUNCTUATION, SPACES, blocks, text_buffers

DECAY, SPAN = 0.5, 8
SYMBOLS = 64
#: Documents of each label that calibrate, at most.
TRAIN_DOCUMENTS = 2_000
POSITIVE_WORDS, NEGATIVE_WORDS, HARD_WORDS = 1_500, 12_000, 5_000
LANDMARKS, CLEAN_LANDMARKS = 64, 40
#: Share of the words learned as toxic that may be as frequent in clean texts.
FALSE_MARKS = 0.01
ROUNDS = 3
COST = 1e4
THRESHOLD = 0.3
#: Folds by remainder of CRC-32 of the id; one is held out.
FOLDS, HELD_OUT = 4, 2
_BLOCK = 1 << 18
#: Bytes that successive pieces of one long text share, so that an insult that is spelled out is whole in one of them.
_OVERLAP = 512
#: Words are learned in parts of at most this many symbols, each beginning in the middle of the one before.
_PART = 64
#: Bins in which the evidence of words is counted, ten for each unit of natural logarithm.
_BINS = 5_000


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each byte (0: separator), and whether the byte counts: punctuation and UTF-8 lead bytes do not."""
    codes = np.arange(256) % (SYMBOLS - 37) + 37
    codes[list(range(0x61, 0x7B))] = np.arange(1, 27)
    codes[list(range(0x30, 0x3A))] = np.arange(27, 37)
    codes[SPACES] = 0
    counts = np.ones(256, bool)
    counts[list(ASCII_PUNCTUATION)] = False
    counts[0xC0:] = False
    return codes.astype(np.uint8), counts


_CODES, _COUNTS = _codes()


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts, ""))


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their row offsets; separators between single characters are left out, so spelled words close up."""
    for drop_spelled in (False, True):
        if not drop_spelled:
            keep, data = _COUNTS[data], _CODES[data]
        else:
            gap = np.ones(len(data) + 2, bool)
            gap[1:-1] = data == 0
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            single = ~gap[1:-1] & (gap[:-2] | edge[:-1]) & (gap[2:] | edge[1:])
            around = np.zeros(len(data) + 2, bool)
            around[1:-1] = single
            keep = ~(gap[1:-1] & around[:-2] & around[2:] & ~edge[:-1] & ~edge[1:])
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        data = data[keep]
    return data, offsets


def _bounds(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = codes != 0
    edge = np.zeros(len(codes) + 1, bool)
    edge[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def _norms(sizes: np.ndarray) -> np.ndarray:
    """The length of a word's vector of triples if these were all different; it depends on the word's length only."""
    total = np.zeros(len(sizes))
    for last in range(2, SPAN):
        total += (last - 1) * np.maximum(sizes - last, 0) * DECAY ** (2 * (last + 1))
    return np.sqrt(np.maximum(total, DECAY**6))


def triple_sums(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each word the sum over its triples of decay to the span times ``weights`` of the triple, over its norm."""
    if not len(starts):
        return np.zeros(0)
    place = np.full(len(codes), -1, np.int32)
    sizes = ends - starts
    total = int(sizes.sum())
    inner = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place[np.repeat(starts, sizes) + inner] = inner
    third = codes.astype(np.int32)
    second, first = third << 6, third << 12
    sums = np.zeros(len(codes), np.float32)
    for last in range(2, min(SPAN, len(codes))):
        n = len(codes) - last
        part = np.zeros(n, np.float32)
        outer = first[:n] | third[last:]
        for middle in range(1, last):
            part += weights[outer | second[middle : middle + n]]
        part[place[last:] < last] = 0
        sums[last:] += part * np.float32(DECAY ** (last + 1))
    return np.add.reduceat(sums, starts) / _norms(sizes)


def triples_of(word: np.ndarray) -> np.ndarray:
    """The dense vector of a word's weighted triples, over its norm."""
    vector = np.zeros(SYMBOLS**3)
    word = word.astype(np.int64)
    for last in range(2, min(SPAN, len(word))):
        for middle in range(1, last):
            n = len(word) - last
            at = word[:n] << 12 | word[middle : middle + n] << 6 | word[last:]
            np.add.at(vector, at, DECAY ** (last + 1))
    return vector / _norms(np.array([len(word)]))[0]


@dataclass
class Model:
    """``weights`` of triples, ``bias``, and the calibration ``slope`` and ``offset`` of the largest decision."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def words(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends = _bounds(codes, offsets)
        return starts, ends, triple_sums(codes, starts, ends, self.weights) + self.bias

    def largest(self, texts: pa.Array) -> np.ndarray:
        """The decision of each text's most toxic word; the bias, that of no evidence, for texts without words."""
        offsets, data = text_buffers(_lower(texts))
        best = np.full(len(texts), self.bias)
        for first, last in blocks(offsets, _BLOCK):
            for low, high, inner in _pieces(data, offsets, first, last):
                codes, ends = symbols(data[low:high], inner)
                starts, _, values = self.words(codes, ends)
                at = np.searchsorted(starts, ends)
                filled = np.flatnonzero(at[1:] > at[:-1])
                if len(filled):
                    found = np.maximum.reduceat(values, at[:-1][filled])
                    best[first + filled] = np.maximum(best[first + filled], found)
        return best

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.largest(texts) + self.offset, -50, 50)))


def _pieces(data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Byte ranges with the offsets of their rows; one row that is longer than a block comes in overlapping pieces of whole words."""
    low, high = int(offsets[first]), int(offsets[last])
    if last > first + 1 or high - low <= _BLOCK:
        yield low, high, offsets[first : last + 1] - low
        return
    while low < high:
        end = min(low + _BLOCK, high)
        while end < high:
            gaps = np.flatnonzero(SPACES[data[low:end]])
            if len(gaps):
                end = low + int(gaps[-1]) + 1
                break
            end = min(end + _BLOCK, high)
        yield low, end, np.array([0, end - low])
        if end == high:
            return
        gaps = np.flatnonzero(SPACES[data[max(low, end - _OVERLAP) : end]])
        again = max(low, end - _OVERLAP) + int(gaps[0]) + 1 if len(gaps) else end
        low = again if again > low else end


# ---- training --------------------------------------------------------------------------------------------------


def _parts(word: bytes) -> list[bytes]:
    """``word``, or if it is longer than ``_PART`` overlapping parts of it."""
    if len(word) <= _PART:
        return [word]
    return [word[at : at + _PART] for at in range(0, len(word) - _PART // 2, _PART // 2)]


def marked_words(counts: DataFrame, toxic_share: float, false_share: float = FALSE_MARKS) -> DataFrame:
    """``(word, t, evidence)`` of the words of ``counts(word, t, c)`` that mark toxic texts.

    A word in ``t`` toxic and ``c`` clean texts has as evidence the exponent of Chernoff's bound on the chance of that
    many toxic ones, were it as frequent in both. Benjamini and Hochberg's procedure bounds the share of false marks;
    words too rare to reach the bound even if all their texts were toxic (Tarone) are not counted as tested. The same
    rule at any size: more marks never make it stricter. Only a histogram of fixed size comes to the driver.
    """
    n, x, p = F.col("t") + F.col("c"), F.col("t") / (F.col("t") + F.col("c")), toxic_share

    def part(share: Column, null: float) -> Column:
        return F.when(share > 0, share * F.log(share / null)).otherwise(0.0)

    evidence = F.when(x > p, n * (part(x, p) + part(1 - x, 1 - p))).otherwise(0.0)
    most = -math.log(p)
    weighed = counts.where("t + c > 0").select("word", "t", evidence.alias("evidence"), (n * most).alias("possible"))

    def binned(name: str) -> Column:
        return F.least(F.floor(F.col(name) * 10), F.lit(_BINS)).cast("int")

    histogram = np.zeros((2, _BINS + 1))
    for kind, name in enumerate(("evidence", "possible")):
        for row in weighed.groupBy(binned(name).alias("bin")).count().collect():
            histogram[kind, row.bin] = row["count"]
    upto, testable = histogram[:, ::-1].cumsum(axis=1)[:, ::-1]
    levels = np.arange(_BINS + 1) / 10
    tested = np.maximum(1, testable[np.searchsorted(levels, -math.log(false_share))])
    fits = np.flatnonzero((upto > 0) & (levels >= np.log(tested / (false_share * np.maximum(upto, 1)))))
    return weighed.where(binned("evidence") >= int(fits[0]) if len(fits) else F.lit(False)).drop("possible")


def _training_words(docs: DataFrame) -> DataFrame:
    """``(toxic, word)``: the distinct words of each labelled text, as hex of their symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffers(_lower(batch.column(1)))
            toxic, words = [], []
            for row, label in enumerate(batch.column(0).to_pylist()):
                piece = data[offsets[row] : offsets[row + 1]]
                codes, ends = symbols(piece, np.array([0, len(piece)]))
                raw = codes.tobytes()
                own = {part for w in raw.split(b"\0") if len(w) >= 3 for part in _parts(w)}
                toxic += [label] * len(own)
                words += own
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(words, pa.binary())], ["toxic", "word"])

    return docs.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, "toxic int, word binary")


def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    return np.frombuffer(b"\0".join(words) + b"\0", np.uint8), starts, starts + sizes


def _landmarks(ranked: list[bytes], count: int, alike: float = 0.8) -> list[bytes]:
    """The first ``count`` words of ``ranked`` that are not much like an earlier one."""
    chosen: list[bytes] = []
    best = np.zeros(len(ranked))
    flat = _flat(ranked) if ranked else None
    for i, word in enumerate(ranked):
        if best[i] < alike:
            chosen.append(word)
            vector = triples_of(np.frombuffer(word, np.uint8))
            best = np.maximum(best, triple_sums(*flat, (vector / max(1e-9, float(vector @ vector))).astype(np.float32)))
        if len(chosen) == count:
            break
    return chosen


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = COST) -> np.ndarray:
    """Primal Newton steps for a linear support vector machine with squared hinge loss; the last column is the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        margin = 1 - y * (x @ w)
        active = margin > 0
        xa, ca = x[active], cost * weight[active]
        gradient = ridge @ w - (xa * (ca * y[active] * margin[active])[:, None]).sum(axis=0)
        step = np.linalg.solve(ridge + (xa * ca[:, None]).T @ xa, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _fit(positive: list[bytes], texts: list[int], negative: list[bytes], like: list[bytes]) -> Model:
    """Nystroem features against landmarks, the machine on them, and its folding into triple weights.

    Landmarks are marked words that differ from each other, and of ``like``, the clean words that an earlier machine
    took for toxic, some that do: against these alone can it tell a mark from a clean word of nearly the same
    triples. A positive counts by the number of ``texts`` it stands for; both kinds weigh the same together.
    """
    marks = _landmarks(positive, LANDMARKS)
    marks += [w for w in _landmarks(like, CLEAN_LANDMARKS) if w not in marks]
    vectors = np.empty((len(marks), SYMBOLS**3), np.float32)
    for vector, word in zip(vectors, marks):
        vector[:] = triples_of(np.frombuffer(word, np.uint8))
    flat = _flat(positive + negative)
    against = np.stack([triple_sums(*flat, v) for v in vectors], axis=1)
    values, basis = np.linalg.eigh((vectors @ vectors.T).astype(float))
    strong = values > 1e-6 * values.max()
    root = basis[:, strong] / np.sqrt(values[strong])
    x = np.hstack([against @ root, np.ones((len(against), 1))])
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    weight = np.concatenate([np.array(texts) / sum(texts), np.full(len(negative), 1 / len(negative))])
    w = _squared_hinge(x, y, weight)
    return Model(((root @ w[:-1]) @ vectors).astype(np.float32), float(w[-1]))


def _platt(decisions: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, with Platt's softened targets."""
    many, few = labels.sum(), len(labels) - labels.sum()
    goal = np.where(labels == 1, (many + 1) / (many + 2), 1 / (few + 2))
    x = np.stack([decisions, np.ones(len(decisions))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        curve = np.maximum(p * (1 - p), 1e-9) * weight
        step = np.linalg.solve((x * curve[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ ((p - goal) * weight) + 1e-3 * w)
        w -= np.clip(step, -5, 5)
    return float(max(w[0], 1e-3)), float(w[1])


def fold(doc_id: str | Column = "doc_id") -> Column:
    """CRC-32 of the id as text, modulo ``FOLDS``; null as empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, documents: int = TRAIN_DOCUMENTS) -> Model | None:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)`` outside the held-out fold; None without both kinds.

    Words are counted by Spark over all labelled texts. Those that mark toxic ones (``marked_words``) stand for their
    sentences as positives, at most ``POSITIVE_WORDS`` of the most evident; words of clean texts are negatives, to
    which each round adds those that the last machine found most toxic. At most ``documents`` rows of each label, the
    first by a hash of the id, calibrate the decisions, and their words are left out of the counts. Only bounded lists
    of words and decisions come to the driver. Of several labels of one document the largest counts.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold() != HELD_OUT))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    if len(share) < 2:
        return None
    # a quarter of the ids, as far as the bound goes, calibrates; all others are counted
    spare = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    held = reduce(DataFrame.union, [spare.where(F.col("toxic") == k).orderBy(*order).limit(documents) for k in (1, 0)])
    parted = stored(usable.join(held.select("doc_id", F.lit(0).alias("part")), "doc_id", "left").fillna(1, ["part"]))
    labelled = F.broadcast(parted) if fits_broadcast(parted) else parted
    rows = docs.select("doc_id", "text").where("text is not null").join(labelled, "doc_id")
    counts = stored(
        _training_words(rows.where("part > 0")).groupBy("word").agg(
            F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")
        )
    )
    kinds = {r.toxic: r["count"] for r in rows.where("part > 0").groupBy("toxic").count().collect()}
    if len(kinds) < 2:
        return None
    marked = marked_words(counts, kinds[1] / (kinds[0] + kinds[1])).orderBy(F.desc("evidence"), "word").limit(POSITIVE_WORDS).collect()
    positive, texts = [bytes(r.word) for r in marked], [r.t for r in marked]
    clean = counts.where("c > 0").select("word").orderBy(F.xxhash64("word")).limit(NEGATIVE_WORDS).collect()
    known = set(positive)
    negative = [w for r in clean if (w := bytes(r.word)) not in known]
    if not positive or not negative:
        return None
    model = _fit(positive, texts, negative, [])
    like: list[bytes] = []
    for _ in range(ROUNDS):
        hard = [w for w in _hardest(counts.where("c > 0").select("word"), model, HARD_WORDS) if w not in known]
        negative = list(dict.fromkeys(hard + negative))
        like = list(dict.fromkeys(like + hard[:HARD_WORDS // 5]))
        model = _fit(positive, texts, negative, like)
    held = decisions(rows.where("part = 0").select("toxic", "text"), model, "toxic").toPandas()
    if held.toxic.nunique() == 2:
        seen = held.toxic.map(held.toxic.value_counts()).to_numpy(float)
        weight = held.toxic.map(share).to_numpy(float) / seen
        model.slope, model.offset = _platt(held.decision.to_numpy(), held.toxic.to_numpy(float), weight / weight.mean())
    return model


def _hardest(words: DataFrame, model: Model, count: int) -> list[bytes]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            if own:
                values = triple_sums(*_flat(own), model.weights)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.astype(float))], ["word", "value"])

    scored = words.mapInArrow(run, "word binary, value double")
    return [bytes(r.word) for r in scored.orderBy(F.desc("value"), "word").limit(count).collect()]


def decisions(docs: DataFrame, model: Model, key: str) -> DataFrame:
    """``key`` and the ``decision`` of each text's most toxic word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.largest(batch.column(1)))], [key, "decision"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, decision double")


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, score)`` for each row of ``docs``: the calibrated probability that its text is toxic.

    A text is as toxic as its most toxic word, whole texts are read, and nothing is shuffled. Null and empty texts,
    and all texts if there was nothing to train on, get the score of no evidence. Repeated rows and null ids are
    returned as they come, an empty table gives an empty result; further columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.probabilities(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
