"""Benchmark decontamination: short test items found inside long documents by size-partitioned MinHash containment.

A MinHash signature of a long document says nothing about a short item: of twenty thousand shingles hardly one of the
item's is among the smallest. So the sketch is taken of the item, the smaller side, and its size follows the item's
size class: an item of at most ``u`` shingles, of which a share ``t`` must be found, is represented by its
``u - ceil(t * u) + 1`` shingles of smallest hash. A document that contains the share ``t`` of an item must contain
one of them, whatever the document's length, so the search loses nothing. Classes also bound the hashes that can
match: a document's shingle above a class's largest sketch hash is never looked up there.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .words import ASCII_PUNCTUATION, SPACES_AND_PUNCTUATION, WordHasher, shingle_hashes

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
#: Bytes of item texts in one index; a larger benchmark is searched in several passes over the documents.
INDEX_BYTES = 8 << 20

_WORD = re.compile(b"[^\\x20\\x09-\\x0D" + re.escape(ASCII_PUNCTUATION) + b"]+")


def _lower(text: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(text, ""))


def shingles(lowered: bytes, size: int) -> set[bytes]:
    """Distinct runs of ``size`` words joined by spaces; all words where there are fewer, nothing where there are none."""
    words = _WORD.findall(lowered)
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def needed(size: int, share: float) -> int:
    """The number of ``size`` shingles that make at least ``share``."""
    return max(1, math.ceil(size * share - 1e-9))


class ContainmentIndex:
    """MinHash sketches of items by size class, and the whole shingle sets to verify with."""

    def __init__(self, items: list[tuple], shingle_words: int, share: float):
        self.shingle_words, self.share, self.hasher = shingle_words, share, WordHasher(SPACES_AND_PUNCTUATION)
        self.items, sketches = [], defaultdict(list)
        lowered = _lower(pa.array([text for _, text in items], pa.string()))
        hashes = self._hashes(lowered)
        for (item, _), text, own in zip(items, lowered, hashes):
            exact = shingles(text.as_py().encode(), shingle_words)
            if not exact:
                continue
            size_class = len(exact).bit_length()  # items of 2**(c-1) to 2**c - 1 shingles
            largest = (1 << size_class) - 1
            kept = np.unique(own)[: largest - needed(largest, share) + 1]
            sketches[size_class].append((kept, len(self.items)))
            self.items.append((item, exact))
        self.classes = []
        for _, members in sorted(sketches.items()):
            values = np.concatenate([kept for kept, _ in members])
            numbers = np.concatenate([np.full(len(kept), number) for kept, number in members])
            order = np.argsort(values, kind="stable")
            self.classes.append((values[order], numbers[order]))

    def _hashes(self, column: pa.Array) -> list[np.ndarray]:
        found = []
        for _, counts, words in self.hasher.rows(column):
            rows, hashes = shingle_hashes(counts, words, self.shingle_words)
            order = np.argsort(rows, kind="stable")
            found += np.split(hashes[order], np.cumsum(np.bincount(rows, minlength=len(counts)))[:-1])
        return found

    def candidates(self, column: pa.Array) -> dict[int, set[int]]:
        """Row -> numbers of the items of which it has a sketch hash."""
        found: dict[int, set[int]] = defaultdict(set)
        for first, counts, words in self.hasher.rows(column):
            rows, hashes = shingle_hashes(counts, words, self.shingle_words)
            for values, numbers in self.classes:
                below = np.flatnonzero(hashes <= values[-1])
                low = np.searchsorted(values, hashes[below], side="left")
                hit = np.flatnonzero(values[np.minimum(low, len(values) - 1)] == hashes[below])
                for at in hit:
                    value, row = hashes[below[at]], first + int(rows[below[at]])
                    high = np.searchsorted(values, value, side="right")
                    found[row].update(numbers[low[at] : high].tolist())
        return found

    def search(self, ids: pa.Array, texts: pa.Array) -> list[tuple]:
        """(document, item, shared shingles, shingles of the item, containment) of all rows that hold an item."""
        lowered, found = _lower(texts), []
        for row, numbers in sorted(self.candidates(lowered).items()):
            own = shingles(lowered[row].as_py().encode(), self.shingle_words)
            for number in sorted(numbers):
                item, exact = self.items[number]
                shared = len(exact & own)
                if shared >= needed(len(exact), self.share):
                    found.append((ids[row].as_py(), item, shared, len(exact), shared / len(exact)))
        return found


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    share: float = CONTAINMENT,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_shingles, containment)`` for every item of which a document has ``share``.

    Words are runs of bytes other than white space and ASCII punctuation, in lower case; shingles are distinct runs
    of ``shingle_words`` words, or the whole sequence of a text with fewer, which therefore only matches a document
    of just these words. Items without words match nothing. Documents are read once per ``index_bytes`` of item
    texts and are not shuffled, so no document and no passage is hot. A null text has no words; null ids are returned
    as null; repeated documents and repeated items give a row each. Either table may be empty; further columns are
    ignored.
    """
    kinds = [docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType]
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, n_shared long, n_shingles long, containment double"
    types = [*map(to_arrow_type, kinds), pa.int64(), pa.int64(), pa.float64()]
    names = ["doc_id", "item_id", "n_shared", "n_shingles", "containment"]
    read, result = docs.select("doc_id", "text"), None
    for items in _slices(benchmark, index_bytes):

        def run(batches: Iterator[pa.RecordBatch], items: list[tuple] = items) -> Iterator[pa.RecordBatch]:
            index = ContainmentIndex(items, shingle_words, share)
            for batch in batches:
                columns = list(zip(*index.search(batch.column(0), batch.column(1)))) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        part = read.mapInArrow(run, schema)
        result = part if result is None else result.union(part)
    return result


def _slices(benchmark: DataFrame, limit: int) -> Iterator[list[tuple]]:
    """The items in lists of bounded size, streamed through the driver one partition at a time."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        text = row.text or ""
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append((row.item_id, text))
        size += len(text)
    yield held


def clean_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    share: float = CONTAINMENT,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item of ``benchmark`` as ``contaminated`` defines it.

    Rows are judged one by one where they are read, so repeated or null ids need no rule and nothing is shuffled.
    """
    text = docs.columns.index("text")
    for items in _slices(benchmark, index_bytes):

        def run(batches: Iterator[pa.RecordBatch], items: list[tuple] = items) -> Iterator[pa.RecordBatch]:
            index = ContainmentIndex(items, shingle_words, share)
            for batch in batches:
                rows = pa.array(np.arange(batch.num_rows))
                bad = [row for row, *_ in index.search(rows, batch.column(text))]
                kept = np.ones(batch.num_rows, bool)
                kept[bad] = False
                yield batch.filter(pa.array(kept))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
