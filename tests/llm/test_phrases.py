import collections
import pickle
import random
import re
import tracemalloc

import numpy as np
import pytest

from codescope.llm import phrases
from tests.llm.conftest import AWKWARD

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def brute_counts(rows):
    """Every phrase of one to four words with its count, by language."""
    counts, sizes = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    counts[lang, tuple(words[i : i + m])] += 1
    return counts, {k: n for k, n in sizes.items() if n}


def brute_collocations(rows, least, top=2000, percent=80):
    f, sizes = brute_counts(rows)
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    absorbed = set()
    for (lang, words), longer in candidates.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                inner = lang, words[i : i + size]
                if 100 * longer >= percent * f[inner]:
                    absorbed.add(inner)
    found = collections.defaultdict(list)
    for (lang, words), a in candidates.items():
        if (lang, words) in absorbed:
            continue
        cuts = [(2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, sizes[lang], -s)
        for lang, rows_ in found.items() for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:top], start=1)
    )


@pytest.fixture(scope="module")
def mixed_rows():
    rng = random.Random(5)
    vocabulary = ["the", "The", "of", "a", "b", "ß", "日本", "x" * 40, "e f"]
    rows = []
    for _ in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        text = "".join(w + rng.choice([" ", " ", "\t", "  ", ", ", ".", "\n", " ; "]) for w in words)
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    return rows + [("en", "new york city hall. " * 50), ("de", "a a a a a a " * 40), ("en", None), (None, ""), ("fr", " .,\n")]


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "k", 1) for i, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, phrase string, slot int")


def result(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("shards,least,slots", [(3, 30, None), (1, 5, None), (7, 12, 64)])
def test_against_brute_force(spark, mixed_rows, monkeypatch, shards, least, slots):
    if slots:  # slots shared by many phrases only cost work
        monkeypatch.setattr(phrases, "_slots", lambda *_: slots)
    wanted = brute_collocations(mixed_rows, least)
    assert result(phrases.collocations(table_of(spark, mixed_rows), least, shards)) == wanted
    assert wanted


def test_slots_filled_by_others_before_a_phrase_is_met(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_slots", lambda *_: 64)
    rng = random.Random(9)
    told = [" ".join(f"p{i}w{j}" for j in range(5)) for i in range(40)]
    rows = [("en", rng.choice(told)) for _ in range(700)]
    counts, _ = brute_counts(rows)
    frequent, _ = phrases.phrase_counts(table_of(spark, rows), 12, 3)
    assert result(frequent.select("lang", "phrase", "f")) == sorted(
        (lang, " ".join(words), n) for (lang, words), n in counts.items() if n >= 12)


def test_long_texts_are_cut_without_losing_phrases(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_BLOCK", 64)
    rows = [("en", "one two three four five " * 60), ("en", "a.b c. " * 80), ("en", "y" * 300 + " " + "z" * 200 + " end " + "one two " * 40)]
    assert result(phrases.collocations(table_of(spark, rows), 20, 3)) == brute_collocations(rows, 20)


def test_counts_follow_documents_however_often_they_come(spark):
    rows = [("en", "alpha beta gamma")] * 31 + [("en", "beta gamma")] * 5
    same_ids = spark.createDataFrame([(1, t, lang) for lang, t in rows], "doc_id long, text string, lang string")
    assert result(phrases.collocations(same_ids)) == brute_collocations(rows, 30)


def test_top_and_ties(spark):
    rows = [("en", f"{x} {x}{x}. " * 30) for x in "abcdefgh"]
    assert result(phrases.collocations(table_of(spark, rows), top=3)) == brute_collocations(rows, 30, top=3)


def test_awkward_documents(spark, awkward, no_documents):
    rows = [("en" if n % 3 == 0 else None if n % 3 == 1 else "de", t) for n, (_, t) in enumerate(AWKWARD)]
    assert result(phrases.collocations(awkward, 30)) == brute_collocations(rows, 30)
    assert phrases.collocations(no_documents).count() == 0


def test_scores_past_64_bits(spark, monkeypatch):
    big = 5 * 10**12
    frequent = spark.createDataFrame(
        [("en", "a", 1, big), ("en", "b", 1, big + 7), ("en", "a b", 2, big - 3)], "lang string, phrase string, m int, f long")
    sizes = spark.createDataFrame([("en", 3 * big)], "lang string, n long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *_: (frequent, sizes))
    (row,) = phrases.collocations(None).collect()
    assert row.score == 2_000_000 * (big - 3) // (2 * big + 7)


def test_many_phrases_are_cut_out_in_little_memory():
    data = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz012345" * 64, np.uint8)
    starts = np.arange(200_000) % 2_000
    ends = starts + np.arange(200_000) % 48
    tracemalloc.start()
    cut = phrases._slices(starts, ends, data)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    text = data.tobytes().decode()
    assert cut.to_pylist()[::997] == [text[a:b] for a, b in zip(starts[::997].tolist(), ends[::997].tolist())]
    assert len(cut) == 200_000 and most < 20 << 20  # 4.7 MB of text; eight bytes of place for each came to 110 MB
    assert phrases._slices(starts[:0], ends[:0], data).to_pylist() == []


def test_counts_of_slots_are_handed_over_in_parts():
    scan = phrases.Scan(0, 1, {1: np.full(1 << 18, phrases._NEVER, np.uint8)})
    met = np.concatenate([np.arange(200_000), np.arange(0, 200_000, 2)]).astype(np.int32)
    scan.pending[1].append(met)
    parts = list(scan.flush())
    assert len(parts) == 4 and max(part.num_rows for part in parts) == phrases._ROWS
    counts = dict(zip(*[[x for part in parts for x in part.column(c).to_pylist()] for c in (3, 4)]))
    assert len(counts) == 200_000 and all(n == 2 - slot % 2 for slot, n in counts.items())
    assert scan.pending[1] == [] and list(scan.flush()) == []


def test_counts_of_slots_are_summed_many_in_a_row():
    slots = 4 * phrases._SLOT_ROW
    scan = phrases.Scan(0, 1, {1: np.full(slots, phrases._NEVER, np.uint8)})
    met = np.concatenate([np.arange(0, slots, 2), np.arange(0, slots, 4), [6, 6, 6, slots - 2]]).astype(np.int32)
    rows = []
    for _ in range(2):
        scan.pending[1].append(met)
        rows += [phrases._packed(part) for part in scan.flush()]
    assert sum(part.num_rows for part in rows) <= 16  # 65,536 counts of slots, twice
    rows = sorted((r for part in rows for r in part.to_pylist()), key=lambda r: (r["m"], r["slot"]))
    batch = phrases.pa.RecordBatch.from_pylist(rows, phrases.pa.schema(
        [("m", phrases.pa.int32()), ("slot", phrases.pa.int32()), ("held", phrases.pa.binary())]))
    sums = np.zeros(slots, np.int64)
    full = []
    for row in phrases._summed(iter([batch.slice(0, 3), batch.slice(3)]), 8):
        (row,) = row.to_pylist()
        part = sums[row["slot"] * phrases._SLOT_ROW :][: phrases._SLOT_ROW]
        phrases._add(part, phrases.pa.scalar(row["held"], phrases.pa.binary()))
        full += np.frombuffer(row["reached"] or b"", np.int32).tolist()
    counts = 2 * np.bincount(met, minlength=slots)
    assert full == [6] and np.array_equal(sums, np.where(counts < 8, counts, 0))


def test_slots_grow_with_the_text(spark):
    class Texts:
        def __init__(self, size):
            self.agg, self.first = lambda *_: self, lambda: [size]

    for size in (2 << 30, 10 << 30, 50 << 30):  # with a fixed number, rare phrases fill every slot together
        slots = phrases._slots(Texts(size), 30)
        assert slots & (slots - 1) == 0 and 64 <= size / slots <= phrases.SLOT_BYTES
    assert phrases._slots(Texts(1 << 60), 30) == phrases.MAX_SLOTS
    assert phrases._slots(Texts(1 << 29), 30) == phrases.SLOTS and phrases._slots(Texts(100), 30) == 1 << 12


@pytest.mark.parametrize("slots,share", [(1 << 16, 0.1), (1 << 16, 0.001), (1 << 12, 0), (64, 0.9)])
def test_slots_that_have_reached_the_threshold_are_found_by_their_bits(slots, share):
    rng = np.random.default_rng(2)
    array = np.where(rng.random(slots) < share, rng.integers(0, 15, slots), phrases._NEVER).astype(np.uint8)
    held = phrases._sparse(array)
    sent = pickle.loads(pickle.dumps(held))
    asked = rng.integers(0, slots, 5_000).astype(np.int32)
    assert np.array_equal(held.of(asked), array[asked]) and np.array_equal(sent.of(asked), array[asked])
    free = np.flatnonzero(array == phrases._NEVER)[:7].astype(np.int32)
    array[free] = 20
    assert np.array_equal(phrases._sparse(np.where(np.isin(np.arange(slots), free), phrases._NEVER, array)).with_more(free[::-1], 20).of(asked),
                          array[asked])


def test_phrases_counted_by_themselves_are_handed_over_many_in_a_row(monkeypatch):
    monkeypatch.setattr(phrases, "_BLOCK", 4_000)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ein", "zwei", "drei", "vier", "Fünf"]) + str(rng.randrange(40)) for _ in range(100)) for _ in range(200)]
    langs = [["en", "de"][i % 2] for i in range(200)]
    scan = phrases.Scan(1, 1, {m: np.zeros(1 << 12, np.uint8) if m < 3 else np.full(1 << 12, phrases._NEVER, np.uint8) for m in range(1, 5)})
    parts = [*scan.batch(phrases.pa.array(texts[:120]), langs[:120]), *scan.rest(), *scan.batch(phrases.pa.array(texts[120:]), langs[120:]), *scan.rest()]
    told = [r for part in parts for r in part.to_pylist() if r["m"] == 0]
    assert len(told) <= 2 * 2 * phrases._BUCKETS  # 400 words and 20,000 pairs
    told.sort(key=lambda r: (r["lang"], r["slot"]))
    batch = phrases.pa.RecordBatch.from_pylist([{k: r[k] for k in ("lang", "slot", "held")} for r in told])
    found = [r for part in phrases._totals(iter([batch.slice(0, 5), batch.slice(5)]), 3) for r in part.to_pylist()]
    counts, _ = brute_counts(list(zip(langs, texts)))
    whole = {(r["lang"], tuple(r["phrase"].split(" "))): r["n"] for r in found}
    assert len(whole) == len(found) and all(r["m"] == len(r["phrase"].split(" ")) for r in found)
    assert whole == {k: n for k, n in counts.items() if len(k[1]) <= 2 and n >= 3}
