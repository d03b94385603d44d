"""Phrase collocations by dynamic itemset counting over shards that are scanned in turn."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codescope.plans.joins import SALTS, list_join
from codescope.plans.lineage import discard, stored

from . import words

MIN_COUNT = 30
MAX_WORDS = 4
SHARDS = 3
TOP = 2000
NO_LANGUAGE = "und"
#: A candidate goes where a longer one that holds it has at least this percentage of its count.
ABSORBED_PERCENT = 80
SCORE_SCALE = 2_000_000
#: Slots of phrases of each length for tables of up to 1 GB of text, and the bound beyond it: there are so many more that
#: ``SLOT_BYTES`` of text or less come to each. A task holds a bit and half a bit for each slot: 190 MB at the bound.
SLOTS, MAX_SLOTS, SLOT_BYTES = 1 << 23, 1 << 29, 128
#: Beyond ``SLOTS``, by how many bits fewer slots phrases of each length have: pairs are most, for nearly all words are frequent.
FEWER = {1: 3, 2: 0, 3: 1, 4: 2}

_BLOCK = 1 << 20
#: Words and phrases whose slots a task gathers before it counts them.
_PENDING = 1_000_000
#: Strings cut out of a block at once.
_STRINGS = 1 << 14
#: Rows of counts that are handed over at once.
_ROWS = 1 << 16
#: Slots whose counts stand in one row of the state.
_SLOT_ROW = 1 << 15
#: Phrases counted by themselves, and bytes of them, that a task gathers before it hands them over.
_SPELLED, _SPELLED_BYTES = 1 << 18, 8 << 20
#: They are dealt into one part for so many slots, but no fewer parts than this.
_BUCKET_SLOTS, _BUCKETS = 1 << 18, 1 << 8
_NEVER = 255
_LANGUAGE_STEP = np.uint64(0xD1B54A32D192ED03)
_WORD, _BLANK, _STOP = 0, 1, 2
_KIND = np.full(256, _WORD, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _STOP
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _chunks(data: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """One long text in parts: (bytes, where the part's own words end).

    A part ends behind a stop, where no phrase crosses; failing that behind a blank, and then the bytes go on for the
    words that phrases beginning before the end still need.
    """
    at = 0
    while at < len(data):
        end = min(at + _BLOCK, len(data))
        kinds = _KIND[data[at:end]]
        if end < len(data) and len(stops := np.flatnonzero(kinds == _STOP)):
            end = at + int(stops[-1]) + 1
        while end < len(data) and _KIND[data[end - 1]] == _WORD:  # within a word
            gaps = np.flatnonzero(_KIND[data[end : end + _BLOCK]] != _WORD)
            end = end + int(gaps[0]) + 1 if len(gaps) else min(end + _BLOCK, len(data))
        more, needed = end, 0
        while more < len(data) and _KIND[data[more - 1]] != _STOP and needed < MAX_WORDS:
            gaps = np.flatnonzero(_KIND[data[more : more + _BLOCK]] != _WORD)
            more = more + int(gaps[0]) + 1 if len(gaps) else min(more + _BLOCK, len(data))
            needed += len(gaps) > 0 and _KIND[data[more - 2]] == _WORD
        yield np.append(data[at:more], np.uint8(0x0A)), end - at
        at = end


def _slices(starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """The strings ``data[starts[i]:ends[i]]``; the places of few strings' bytes stand in memory at a time."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    found = np.empty(offsets[-1], np.uint8)
    for low in range(0, len(starts), _STRINGS):
        part = slice(low, low + _STRINGS)
        begin = offsets[low]
        end = offsets[min(low + _STRINGS, len(starts))]
        shift = (starts[part] - (offsets[low:-1][:_STRINGS] - begin)).astype(np.int32)
        places = np.repeat(shift, (ends - starts)[part])
        places += np.arange(end - begin, dtype=np.int32)
        found[begin:end] = data[places]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(found))


class Reached:
    """The first step after which each slot had counted the threshold, or ``_NEVER``.

    A bit says whether a slot has; the steps of those that have stand in order, found by counting the bits before. Bits are
    set where they are first asked for, so that the driver has none and tasks do not keep the places.
    """

    def __init__(self, slots: int, places: np.ndarray, steps: np.ndarray):
        self.slots, self.places, self.steps, self.bits = slots, places, steps, None

    def __reduce__(self):
        """Tasks receive the slots that have reached the threshold, which are few, by their distances from each other."""
        gaps = np.diff(self.places, prepend=np.int32(0))
        wide = gaps >= 255
        return _set, (self.slots, np.where(wide, 255, gaps).astype(np.uint8), gaps[wide], self.steps)

    def with_more(self, places: np.ndarray, step: int) -> Reached:
        places = np.concatenate([self.places, places])
        order = np.argsort(places, kind="stable")
        return Reached(self.slots, places[order], np.append(self.steps, np.full(len(places) - len(self.steps), step, np.uint8))[order])

    def _set(self) -> None:
        self.bits, self.before = np.zeros(-(-self.slots // 64), np.uint64), np.zeros(-(-self.slots // 64), np.int32)
        for low in range(0, len(self.places), _ROWS):
            some = self.places[low : low + _ROWS]
            np.bitwise_or.at(self.bits, some >> 6, np.uint64(1) << (some & 63).astype(np.uint64))
        np.cumsum(np.bitwise_count(self.bits[:-1]), out=self.before[1:])
        self.places = None

    def of(self, slot: np.ndarray) -> np.ndarray:
        if self.bits is None:
            self._set()
        found = np.full(len(slot), _NEVER, np.int16)
        row, bit = slot >> 6, (slot & 63).astype(np.uint64)
        bits = self.bits[row]
        at = np.flatnonzero((bits >> bit) & np.uint64(1))
        below = bits[at] & ((np.uint64(1) << bit[at]) - np.uint64(1))
        found[at] = self.steps[self.before[row[at]] + np.bitwise_count(below)]
        return found


class Scan:
    """What one scan of a shard counts at ``step``.

    Every phrase has a slot by hash among the phrases of its length, and ``reached[m]`` tells the first step after
    which the slot had counted the threshold. Once the slots of both its subphrases have, a phrase is counted in its
    slot; once its own has, it is counted by itself, for one cycle. All this follows from the arrays alone, so each
    phrase sees every shard exactly once, and a slot has never counted less than any of its phrases.
    """

    def __init__(self, step: int, shards: int, reached: dict[int, Reached | np.ndarray]):
        self.step, self.shards = step, shards
        self.reached = {m: _sparse(r) for m, r in reached.items()}
        self.hasher = words.WordHasher()
        self.pending: dict[int, list[np.ndarray]] = {m: [] for m in reached}
        self.waiting = 0
        slots = [r.slots for r in self.reached.values()]
        self.buckets = min([*slots, max(_BUCKETS, max(slots) // _BUCKET_SLOTS)])
        self.told: list[pa.Table] = []

    def __reduce__(self):
        return Scan, (self.step, self.shards, self.reached)

    def batch(self, column: pa.Array, languages: list[str]) -> Iterator[pa.RecordBatch]:
        """What is to be handed over of these texts, and of those before."""
        codes, names = pd.factorize(np.array(languages, dtype=object))
        offsets, _ = words.text_buffers(column)
        for first, last in words.blocks(offsets, _BLOCK):
            some = pc.fill_null(column.slice(first, last - first).cast(pa.large_string()), "")
            ended = pc.binary_join_element_wise(some, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
            starts, part = words.text_buffers(ended)
            if last == first + 1 and len(part) > _BLOCK:
                for chunk, end in _chunks(part):
                    yield from self._counts(chunk, np.zeros(1, np.int64), codes[first:last], names, end)
            else:
                yield from self._counts(part, starts[:-1], codes[first:last], names, len(part))

    def rest(self) -> Iterator[pa.RecordBatch]:
        """What is left to be handed over at the end of a task."""
        yield from map(_packed, self.flush())
        if self.told:
            yield _dealt(_combined(self.told))
            self.told.clear()

    def _counts(self, data, row_starts, row_codes, names, end) -> Iterator[pa.RecordBatch]:
        kinds = _KIND[data]
        inside = kinds == _WORD
        begin, behind = inside.copy(), ~inside
        begin[1:] &= ~inside[:-1]
        behind[0] = False
        behind[1:] &= inside[:-1]
        starts = np.flatnonzero(begin)
        if not len(starts):
            return
        piece = np.cumsum(kinds == _STOP, dtype=np.int32)[starts]
        plain = _LOWER[data]
        plain[behind] = 0x20
        plain = plain[inside | behind]
        at = np.concatenate([[0], np.flatnonzero(plain == 0x20) + 1])
        own = int(np.searchsorted(starts, end))
        language = row_codes[np.searchsorted(row_starts, starts, side="right") - 1]

        spelled = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(plain))
        encoded = spelled.dictionary_encode()
        hashes = np.concatenate([h for _, _, h in self.hasher.rows(encoded.dictionary)])
        word = encoded.indices.to_numpy().astype(np.int64)
        if self.step < self.shards:
            sizes = np.bincount(language[:own], minlength=len(names))
            seen = np.flatnonzero(sizes)
            yield from self._tell(names, seen, pa.array([""] * len(seen), pa.string()), np.zeros(len(seen)), sizes[seen])
        language_hash = words.mixed(pd.util.hash_array(names.astype(object), categorize=False).astype(np.uint64)) * _LANGUAGE_STEP
        by_word = hashes[word]
        value = words.mixed(by_word + language_hash[language])
        at_words, since = np.arange(len(starts)), np.zeros(len(starts), np.int16)  # where phrases begin; from which step on
        for m in range(1, MAX_WORDS + 1):
            slot = (value & np.uint64(self.reached[m].slots - 1)).astype(np.int32)
            reach = self.reached[m].of(slot)
            mine = at_words < own
            hashed = mine & (reach >= self.step) & (self.step < since + self.shards)
            if hashed.any():
                self.pending[m].append(slot[hashed])
                self.waiting += len(self.pending[m][-1])
                if self.waiting > _PENDING:
                    yield from map(_packed, self.flush())
            began = np.maximum(reach + 1, since)
            exact = mine & (began <= self.step) & (self.step < began + self.shards)
            if exact.any():
                yield from self._spelled(m, at_words[exact], slot[exact], word, language, at, plain, names)
            if m == MAX_WORDS:
                return
            # phrases of one word more, the slots of both of whose parts have reached the threshold
            whole = np.full(len(starts) + 1, _NEVER, np.int16)
            whole[at_words] = np.maximum(reach, since - 1)  # a part itself is met from ``since`` on, whenever its slot was full
            both = np.maximum(whole[:-1], whole[1:])
            both[:-1][piece[1:] != piece[:-1]] = _NEVER
            both[-1] = _NEVER
            following = np.flatnonzero(both < self.step)
            if not len(following):
                return
            spread = np.zeros(len(starts), np.uint64)
            spread[at_words] = value
            value = words.mixed(spread[following] * np.uint64(2 * m + 1) + by_word[following + m])
            at_words, since = following, both[following] + 1

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Counts of the slots met since the last time."""
        for m, met in self.pending.items():
            if met:
                slots, counts = np.unique(np.concatenate(met), return_counts=True)
                met.clear()
                for low in range(0, len(slots), _ROWS):
                    some = slots[low : low + _ROWS]
                    nothing = pa.nulls(len(some), pa.string())
                    kinds = (nothing, nothing, pa.array(np.full(len(some), m, np.int32)), pa.array(some),
                             pa.array(counts[low : low + _ROWS].astype(np.int64)))
                    yield pa.RecordBatch.from_arrays(list(kinds), ["lang", "phrase", "m", "slot", "n"])
        self.waiting = 0

    def _spelled(self, m, counted, slot, word, language, at, plain, names) -> Iterator[pa.RecordBatch]:
        """Count the phrases that begin at the words ``counted``, told apart by their words."""
        codes = language[counted].astype(np.int64)
        for i in range(m):
            codes, uniques = pd.factorize(codes * (int(word.max()) + 1) + word[counted + i])
        first = np.empty(len(uniques), np.int64)
        first[codes[::-1]] = np.arange(len(counted) - 1, -1, -1)
        begin = counted[first]
        text = _slices(at[begin], at[begin + m] - 1, plain).cast(pa.string())
        yield from self._tell(names, language[begin], text, slot[first], np.bincount(codes))

    def _tell(self, names: np.ndarray, codes: np.ndarray, phrases: pa.Array, slots: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Keep counts of phrases until there are many, add up those of the same phrase, and hand over what stays many."""
        buckets = pa.array((slots.astype(np.int64) & (self.buckets - 1)).astype(np.int32))
        langs = pa.array(names, pa.string()).take(pa.array(codes))
        self.told.append(pa.table([langs, phrases, buckets, pa.array(counts.astype(np.int64))], ["lang", "phrase", "bucket", "n"]))
        if sum(map(len, self.told)) > _SPELLED or sum(t.nbytes for t in self.told) > _SPELLED_BYTES:
            together = _combined(self.told)
            self.told = [together]
            if len(together) > _SPELLED // 2 or together.nbytes > _SPELLED_BYTES // 2:
                self.told.clear()
                yield _dealt(together)
                del together
                pa.default_memory_pool().release_unused()


def _set(slots: int, near: np.ndarray, wide: np.ndarray, steps: np.ndarray) -> Reached:
    gaps = near.astype(np.int32)
    gaps[near == 255] = wide
    found = Reached(slots, np.cumsum(gaps, dtype=np.int32), steps)
    found._set()
    return found


def _sparse(reached: Reached | np.ndarray) -> Reached:
    if isinstance(reached, Reached):
        return reached
    places = np.flatnonzero(reached != _NEVER).astype(np.int32)
    return Reached(len(reached), places, reached[places])


def _combined(told: list[pa.Table]) -> pa.Table:
    """One row for each phrase of a language."""
    groups = pa.concat_tables(told).combine_chunks().group_by(["lang", "phrase"], use_threads=False)
    found = groups.aggregate([("bucket", "max"), ("n", "sum")])
    return found.rename_columns({"bucket_max": "bucket", "n_sum": "n"}).select(["lang", "phrase", "bucket", "n"])


def _dealt(together: pa.Table) -> pa.RecordBatch:
    """Phrases and their counts in ``_SCHEMA``, with 0 for ``m``: one row for each language and bucket."""
    codes, names = pd.factorize(together.column("lang").to_numpy())
    buckets = together.column("bucket").to_numpy()
    order = np.lexsort((buckets, codes))
    codes, buckets, counts = codes[order], buckets[order], together.column("n").to_numpy()[order]
    phrases = together.column("phrase").combine_chunks().cast(pa.large_string()).take(pa.array(order))
    line = pa.scalar("\n", pa.large_string())  # which no phrase holds
    offsets, data = words.text_buffers(pc.binary_join_element_wise(phrases, pa.scalar("", pa.large_string()), line))
    edges = np.flatnonzero((codes[1:] != codes[:-1]) | (buckets[1:] != buckets[:-1])) + 1
    first, last = np.append(0, edges), np.append(edges, len(codes))
    held = [np.int64(b - a).tobytes() + counts[a:b].tobytes() + data[offsets[a] : offsets[b]].tobytes()
            for a, b in zip(first.tolist(), last.tolist())]
    kinds = pa.array(names[codes[first]], pa.string()), pa.array(np.zeros(len(first), np.int32)), pa.array(buckets[first])
    return pa.RecordBatch.from_arrays([*kinds, pa.array(held, pa.binary())], ["lang", "m", "slot", "held"])


def _told(held: list[pa.BinaryScalar]) -> pa.Table:
    """``(phrase, n)`` of rows that ``_dealt`` has made, summed by phrase."""
    counts, texts = [], []
    for each in held:
        data = each.as_buffer()
        n = int(np.frombuffer(data, np.int64, 1)[0])
        counts.append(np.frombuffer(data, np.int64, n, 8))
        texts.append(np.frombuffer(data, np.uint8, offset=8 + 8 * n))
    text = np.concatenate(texts)
    ends = np.flatnonzero(text == 0x0A)
    offsets = np.append(0, ends - np.arange(len(ends)))
    text = np.ascontiguousarray(text[text != 0x0A])
    phrases = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text))
    groups = pa.table({"phrase": phrases, "n": np.concatenate(counts)}).group_by("phrase", use_threads=False)
    return groups.aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})


def _totals(batches: Iterator[pa.RecordBatch], min_count: int) -> Iterator[pa.RecordBatch]:
    """``(lang, phrase, m, n)`` of the phrases of ``min_count`` or more, from rows ``(lang, slot, held)`` in order of the first
    two; with 0 for ``m`` and no phrase, the words of a language."""
    def rows(lang: str, held: list[pa.BinaryScalar]) -> pa.RecordBatch:
        table = _told(held)
        phrases, counts = table.column("phrase").combine_chunks(), table.column("n").to_numpy()
        blanks = pc.count_substring(phrases, " ").to_numpy(zero_copy_only=False)
        m = np.where(pc.equal(phrases, "").to_numpy(zero_copy_only=False), 0, blanks + 1).astype(np.int32)
        some = np.flatnonzero((m == 0) | (counts >= min_count))
        values = [pa.array([lang] * len(some), pa.string()), phrases.take(pa.array(some)).cast(pa.string()), pa.array(m[some]), pa.array(counts[some])]
        return pa.RecordBatch.from_arrays(values, ["lang", "phrase", "m", "n"])

    key, held = None, []
    for batch in batches:
        for at, now in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if now != key:
                if held:
                    yield rows(key[0], held)
                key, held = now, []
            held.append(batch.column(2)[at])
    if held:
        yield rows(key[0], held)


def _held(counts: np.ndarray, places: np.ndarray) -> bytes:
    """Counts and their places in a row of ``_SLOT_ROW`` slots. Counts past 32 bits are cut there: they only meet the threshold."""
    return np.minimum(counts, (1 << 32) - 1).astype(np.uint32).tobytes() + places.astype(np.uint16).tobytes()


def _add(sums: np.ndarray, held: pa.BinaryScalar) -> None:
    """Add what ``_held`` has written; the places in it are distinct."""
    data = held.as_buffer()
    n = data.size // 6
    sums[np.frombuffer(data, np.uint16, n, 4 * n)] += np.frombuffer(data, np.uint32, n)


_SCHEMA = "lang string, m int, slot int, held binary"
_STATE = "m int, slot int, held binary, reached binary"


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``batch`` of ``Scan.flush`` in ``_SCHEMA``: counts of slots, which come in order, as one row for each ``_SLOT_ROW`` slots."""
    slots, counts = batch.column(3).to_numpy(), batch.column(4).to_numpy()
    rows, first = np.unique(slots // _SLOT_ROW, return_index=True)
    held = [_held(counts[a:b], slots[a:b] % _SLOT_ROW) for a, b in zip(first, [*first[1:], len(slots)])]
    m = np.full(len(rows), batch.column(2)[0].as_py(), np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(len(rows), pa.string()), pa.array(m), pa.array(rows.astype(np.int32)), pa.array(held, pa.binary())],
        ["lang", "m", "slot", "held"])


def _summed(batches: Iterator[pa.RecordBatch], min_count: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(m, slot, held)`` in order of the first two, summed: counts below the threshold, and the slots that have reached it."""
    def row(key: tuple[int, int], sums: np.ndarray) -> pa.RecordBatch:
        below, reached = np.flatnonzero((sums > 0) & (sums < min_count)), np.flatnonzero((sums > 0) & (sums >= min_count))
        held = _held(sums[below], below) if len(below) else None
        full = (reached + key[1] * _SLOT_ROW).astype(np.int32).tobytes() if len(reached) else None
        values = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([held], pa.binary()), pa.array([full], pa.binary())]
        return pa.RecordBatch.from_arrays(values, ["m", "slot", "held", "reached"])

    key, sums = None, np.zeros(_SLOT_ROW, np.int64)
    for batch in batches:
        for at, now in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if now != key:
                if key is not None:
                    yield row(key, sums)
                key, sums = now, np.zeros(_SLOT_ROW, np.int64)
            _add(sums, batch.column(2)[at])
    if key is not None:
        yield row(key, sums)


def _slots(texts: DataFrame, min_count: int) -> int:
    """A power of two, eight times the number of phrases that can reach the threshold, if that is ``SLOTS`` at most; else so
    many that rare phrases, which share slots, do not reach the threshold together."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    few = max(1 << 12, 1 << int(8 * (size // 2 + 1) // min_count).bit_length())
    return max(min(SLOTS, few), min(MAX_SLOTS, 1 << int(size // SLOT_BYTES).bit_length()))


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, m, f)`` of every phrase of one to ``MAX_WORDS`` words with ``f >= min_count``; ``(lang, n)``.

    Texts are dealt into ``shards`` by hash and scanned shard after shard, round and round; lengths interleave. All
    words are counted from the first scan on. A phrase becomes active in the scan after that in which both
    subphrases of one word less have reached ``min_count``. It is counted in a slot that it shares by hash with few
    others, until that reaches ``min_count``, and from then on by itself until it has seen every shard once; scans end
    when no phrase is active. A phrase is no more frequent than its parts or its slot, so none that reaches the
    threshold is missed, and what is counted by itself is counted exactly.

    Slots bound what is kept of rare phrases, six bytes each; they grow with the text, or else rare phrases would fill
    them together and all be counted by themselves. Tasks receive the slots that have reached the threshold. Counts are
    summed in tasks, then, many slots in a row, by slot; phrases counted by themselves are added up at the end, many of a
    language in a row.
    """
    if not 1 <= shards <= 60:
        raise ValueError("shards must be between 1 and 60")
    dealt = docs.select(
        F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text",
        F.pmod(F.xxhash64("text", "doc_id"), F.lit(shards)).cast("int").alias("shard"),
    ).where("text is not null")
    texts = stored(dealt, by=["shard"])
    slots = _slots(texts, min_count)
    none = np.zeros(0, np.int32)
    reached = {m: Reached(max(min(slots, SLOTS), slots >> FEWER[m]), none, none.astype(np.uint8)) for m in range(1, MAX_WORDS + 1)}
    state, counted, last, step = None, [], -1, 0

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _summed(batches, min_count)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _totals(batches, min_count)

    while step < shards or step <= last + shards:
        scan = Scan(step, shards, reached)

        def run(batches: Iterator[pa.RecordBatch], scan: Scan = scan) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from scan.batch(batch.column(1), batch.column(0).to_pylist())
            yield from scan.rest()

        found = stored(texts.where(F.col("shard") == step % shards).select("lang", "text").mapInArrow(run, _SCHEMA))
        counted.append(stored(found.where("m = 0").select("lang", "slot", "held")))
        held = found.where("m > 0").select("m", "slot", "held")
        if state is not None:  # slots that have reached the threshold need no more counts
            held = held.union(state.where("held is not null").select("m", "slot", "held"))
        merged = stored(held.repartition("m", "slot").sortWithinPartitions("m", "slot").mapInArrow(merge, _STATE))
        discard(found)
        if state is not None:
            discard(state)
        state = merged
        fresh = state.where("reached is not null").select("m", "reached").toArrow()
        if fresh.num_rows:
            places = [np.frombuffer(x, np.int32) for x in fresh.column("reached").to_pylist()]
            lengths = np.array(fresh.column("m").to_pylist())
            for m in np.unique(lengths).tolist():
                reached[m] = reached[m].with_more(np.concatenate([places[i] for i in np.flatnonzero(lengths == m)]), step)
            last = step
        step += 1
    discard(state)
    spelled = reduce(DataFrame.unionByName, counted).repartition("lang", "slot").sortWithinPartitions("lang", "slot")
    total = stored(spelled.mapInArrow(totals, "lang string, phrase string, m int, n long"))
    frequent = total.where("m > 0").select("lang", "phrase", "m", F.col("n").alias("f"))
    sizes = total.where("m = 0").select("lang", "n")
    for part in counted:
        discard(part)
    discard(texts)
    return frequent, sizes


def _part(first: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice("words", first, length), " ")


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, shards: int = SHARDS, top: int = TOP, absorbed_percent: int = ABSORBED_PERCENT
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of two to four words of every language.

    A-Z count as lower case; texts are parted at ``.,;:!?`` and line ends, and words at blanks. ``n`` is the number of
    words of the language, ``a`` that of the phrase, ``l`` and ``r`` those of its two parts where it scores lowest,
    the shorter first part among equals; the score is ``floor(2000000 a / (l + r))`` in exact decimals. A phrase inside
    a longer one that has ``absorbed_percent`` of its count is left out. Order: score and ``a`` descending, phrase by
    bytes.

    A null language is ``und``, null texts have no words, and every repeated row counts. An empty table gives an
    empty result; further columns are ignored. Sums of one hot word are combined before they are shuffled, and its
    joins are salted where they are not measured as small.
    """
    frequent, sizes = phrase_counts(docs, min_count, shards)
    candidates = frequent.where("m > 1").withColumn("words", F.split("phrase", " "))
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1))).select(
        "lang", "phrase", "m", F.col("f").alias("a"), "k", _part(1, F.col("k")).alias("first"),
        _part(F.col("k") + 1, F.col("m") - F.col("k")).alias("rest"),
    )
    known = frequent.select("lang", "phrase", "f")
    cut = list_join(cut, known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = list_join(cut, known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = f"cast({SCORE_SCALE} as decimal(18,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"
    scored = cut.withColumn("score", F.expr(exact)).groupBy("lang", "phrase", "m", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("lowest")
    )
    inner = [
        F.struct(_part(i, size).alias("phrase")) for size in range(2, MAX_WORDS) for i in range(1, MAX_WORDS - size + 2)
    ]
    spans = [F.col("m") >= i + size - 1 for size in range(2, MAX_WORDS) for i in range(1, MAX_WORDS - size + 2)]
    shorter = [F.col("m") > size for size in range(2, MAX_WORDS) for _ in range(1, MAX_WORDS - size + 2)]
    held = candidates.where("m > 2").select(
        "lang", F.col("f").alias("longer"),
        F.explode(F.array(*[F.when(fits & less, part) for part, fits, less in zip(inner, spans, shorter)])).alias("part"),
    ).where("part is not null").groupBy("lang", F.col("part.phrase").alias("phrase")).agg(F.max("longer").alias("longer"))
    wide = [F.col(c).cast("decimal(22,0)") for c in ("longer", "a")]
    left = scored.join(held, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (wide[0] * 100 < wide[1] * absorbed_percent)
    )
    order = [F.col("lowest.score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("nth") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("lowest.l").alias("l"), F.col("lowest.r").alias("r"),
        "n", F.col("lowest.score").cast("long").alias("score"),
    )
