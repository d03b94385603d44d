import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from codescope.llm import decontamination, exact_dedup, fuse_filter, simhash
from codescope.llm.components import components
from tests.llm.conftest import AWKWARD


def test_fuse_filter_holds_its_keys():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 7, 100, 20_000):
        keys = rng.integers(-(2**63), 2**63 - 1, n)
        data = fuse_filter.build(np.concatenate([keys, keys]))
        assert fuse_filter.contains(data, keys).all()
        assert fuse_filter.contains(data, rng.integers(-(2**63), 2**63 - 1, 20_000)).mean() < 0.01


def _brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, norm):
        groups.setdefault(t, []).append(i)
    found = []
    for (i, _), t in zip(rows, norm):
        ids = [x for x in groups[t] if x is not None]
        found.append((i, min(ids) if ids else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(found, key=str)


@pytest.mark.parametrize("bits", [256, 4])
@pytest.mark.parametrize("batches", [1, 2, 3])
def test_exact_duplicates(documents_of, bits, batches):
    random.seed(batches)
    rows = AWKWARD + [(100 + i, random.choice(["a b", "a  b", "c", "d\te", "d e", f"u{i}"])) for i in range(200)]
    got = exact_dedup.exact_duplicates(documents_of(rows), batches, bits).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == _brute_exact(rows)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_duplicates_of_nothing(no_documents):
    assert exact_dedup.exact_duplicates(no_documents).count() == 0
    assert exact_dedup.first_of_each(no_documents).count() == 0


def _brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(documents_of, no_documents):
    random.seed(4)
    words = [f"w{i}" for i in range(300)]
    base = [random.choice(words) for _ in range(400)]
    rows = [(i, t) for i, t in AWKWARD if i != 8]
    for i in range(60):
        copy = list(base)
        for _ in range(random.randint(0, 4)):
            copy[random.randrange(len(copy))] = random.choice(words)
        rows.append((1000 - i, " ".join(copy) if i % 3 else "  ".join(copy).upper()))
    rows += [(2000 + i, " ".join(random.choices(words, k=30))) for i in range(60)]
    prints = [_brute_print(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    smallest = {}
    for (i, _), x in zip(rows, label):
        smallest.setdefault(x, []).append(i)
    wanted = sorted(
        ((i, f"{p:016x}", min((x for x in smallest[c] if x is not None), default=None)) for (i, _), p, c in zip(rows, prints, label)),
        key=str)
    for segments in (1, 2, 3, 4):
        got = simhash.near_duplicates(documents_of(rows), segments=segments) if segments > 1 else None
        if got is not None:
            assert sorted(map(tuple, got.collect()), key=str) == wanted
    assert simhash.near_duplicates(no_documents).count() == 0
    assert simhash.first_of_each(no_documents).count() == 0


def test_one_row_of_each_component_stays(documents_of, awkward):
    random.seed(6)
    words = [f"w{i}" for i in range(300)]
    bases = [" ".join(random.choices(words, k=40)) for _ in range(12)]
    copies = [" ".join(f"{b}  {w}".upper().split(" ")) for b, w in zip(bases, ["", " "] * 6)]
    near = list(zip(bases, copies))
    rows = [(1, near[0][0]), (None, near[0][1]), (None, bases[1]), (None, bases[2])]  # a nameless copy, nameless others
    rows += [(2, near[3][0]), (7, near[3][1]), (7, bases[4])]  # an id with two texts, one near a smaller id
    rows += [(9, near[5][0]), (9, near[5][1]), (None, near[6][0]), (None, near[6][1])]  # near copies under one id
    rows += [(11, bases[7])] * 3 + [(None, bases[8])] * 3 + [(12, None), (12, ""), (None, " "), (13, bases[9])]
    for table, given in ((documents_of(rows), rows), (awkward, AWKWARD)):
        prints = [_brute_print(t) for _, t in given]
        label = list(range(len(given)))
        for a in range(len(given)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    label = [label[b] if x == label[a] else x for x in label]
        best = {}
        for (i, t), x in zip(given, label):
            rank = (i is None, i or 0, t is not None, hashlib.sha256((t or "").encode()).hexdigest())
            best[x] = min(best.get(x, (rank, i, t)), (rank, i, t), key=lambda r: r[0])
        got = simhash.first_of_each(table)
        assert got.columns == table.columns
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(((i, t) for _, i, t in best.values()), key=str)


def test_a_long_text_in_pieces_has_the_same_fingerprint(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_PIECE", 97)
    assert simhash.fingerprint(text) == whole == _brute_print(text)


def test_components_of_a_chain_a_star_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 200), (None, 3), (5, 6)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 140)}, 200: 200}


def _brute_contained(rows, items):
    found = []
    for i, t in rows:
        own = decontamination.shingles((t or "").lower().encode(), 5)
        for k, item in items:
            wanted = decontamination.shingles((item or "").lower().encode(), 5)
            if wanted and len(wanted & own) >= 0.8 * len(wanted) - 1e-9:
                found.append((i, k, len(wanted & own), len(wanted)))
    return sorted(found, key=str)


@pytest.mark.parametrize("index_bytes", [8 << 20, 200])
def test_contaminated(spark, documents_of, no_documents, index_bytes):
    random.seed(6)
    words = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(random.choices(words, k=n))) for k, n in enumerate([1, 4, 5, 6, 9, 12, 20, 33, 70])]
    items += [(20, None), (21, "!!!"), (22, items[5][1]), (None, items[6][1])]
    rows = list(AWKWARD)
    for i in range(150):
        item = random.choice(items[:9])[1].split()
        for _ in range(random.choice([0, 0, 1, 3])):
            item[random.randrange(len(item))] = "changed"
        before, after = (random.choices(words, k=random.choice([0, 3, 40])) for _ in range(2))
        rows.append((100 + i, random.choice([" ", ", "]).join([*before, *item, *after]).title()))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents_of(rows)
    got = decontamination.contaminated(docs, bench, index_bytes=index_bytes).collect()
    wanted = _brute_contained(rows, items)
    assert sorted([tuple(r)[:4] for r in got], key=str) == wanted
    bad = {x[0] for x in wanted}
    clean = decontamination.clean_documents(docs, bench, index_bytes=index_bytes)
    assert clean.columns == docs.columns
    assert sorted([r.doc_id for r in clean.collect()], key=str) == sorted([i for i, _ in rows if i not in bad], key=str)
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0
    assert decontamination.contaminated(no_documents, bench).count() == 0
    assert decontamination.clean_documents(docs, bench.limit(0)).count() == len(rows)
