import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codescope.llm import chat_windows, mixing, quality, toxicity, url_filter
from codescope.llm.queries import RULES
from codescope.llm.token_counts import Tokenizer
from tests.llm.conftest import AWKWARD


# ---- mixing ----------------------------------------------------------------------------------------------------


def _water(sizes, weights, epochs):
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(epochs * sizes[s] for s in full)
        free = sum(weights[s] for s in sizes if s not in full)
        goal = {s: epochs * sizes[s] if s in full else rest * weights[s] / free for s in sizes}
        more = {s for s in sizes if s not in full and goal[s] > epochs * sizes[s]}
        if not more:
            return goal
        full |= more


@pytest.mark.parametrize("small", [True, False])
def test_mixing(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(mixing, "fits_broadcast", lambda frame: False)
    random.seed(8)
    counts = {"big": 900, "tiny": 3, "mid": 200, "Ä": 40, "a\U0001f600": 10, None: 60}
    rows = [(s, "w " * random.randint(0, 30)) for s, n in counts.items() for _ in range(n)]
    docs = spark.createDataFrame([(i, t, s, "x", 9) for i, (s, t) in enumerate(rows)],
                                 "doc_id long, text string, source string, size string, rank int")
    got = mixing.mixed(docs, weights=(5.0, 2.0, 1.0)).collect()
    assert len(got) == len(rows)
    sizes = {s: sum(len(t.split()) for x, t in rows if x == s) for s in counts}
    order = sorted(counts, key=lambda s: (s is None, s or ""))
    goal = _water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    for s in counts:
        own = [r for r in got if r.source == s]
        assert own[0].target == pytest.approx(goal[s])
        assert abs(sum(r.size * r.repeats for r in own) - goal[s]) <= 15
        assert max(r.repeats for r in own) <= 3
        assert max(r.repeats for r in own) - min(r.repeats for r in own) <= 1
    again = mixing.mixed(docs.repartition(5), weights=(5.0, 2.0, 1.0)).collect()
    assert sorted((r.doc_id, r.repeats) for r in again) == sorted((r.doc_id, r.repeats) for r in got)


def test_mixing_awkward_documents(awkward, no_documents):
    assert mixing.mixed(awkward).count() == len(AWKWARD)
    assert mixing.mixed(no_documents).count() == 0
    assert mixing.mixed(awkward.where("text is null")).agg(F.sum("size"), F.sum("target")).first() == (0, 0.0)


# ---- chat ------------------------------------------------------------------------------------------------------


def test_template_is_reversible():
    template = chat_windows.Template()
    random.seed(3)
    parts = ["<", "|", "im_start", "<|im_start|>", "\\", "s>", "</s>", "[INST]", "[", "/", "\n", "<\\|im_end|>", "im_end|>"]
    for _ in range(3000):
        text = "".join(random.choices(parts, k=random.randint(0, 9)))
        written = template.turn(text, text)
        assert not any(c in template.escape(text) for c in template.controls)
        assert [(r, template.unescape(written[a:b])) for r, a, b in template.parse(written)] == [(text, text)]
    with pytest.raises(ValueError):
        chat_windows.Template(controls=("<|im_start|>", "<|im_end|>", "<<SYS>>"))


@pytest.mark.parametrize("budget, history", [(60, 15), (200, 50), (5000, 0)])
def test_windows(spark, budget, history):
    random.seed(budget)
    turns = []
    for conv in [None, *range(12)]:
        for turn in range(random.choice([1, 2, 9, 40])):
            role = "system" if turn == 0 and (conv or 0) % 2 else random.choice(["user", "assistant", "assistant", None])
            text = random.choice([None, "", "ok", "</s>[INST] é [/INST]", "some words " * random.randint(1, 60)])
            turns.append((conv, turn if conv != 3 else 7, role, text, "x"))
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, block string")
    windows = chat_windows.chat_windows(frame, Tokenizer(public_tokenizers.path("byte_bpe_50k.json")), budget=budget, history=history)
    rows = windows.collect()
    template = chat_windows.Template()
    parsed = [[(r, template.unescape(w.formatted[a:b]), a, b) for r, a, b in template.parse(w.formatted)] for w in rows]
    for w, own in zip(rows, parsed):
        assert len(own) == w.n_new + w.n_context
        assert [(a, b) for i, (r, _, a, b) in enumerate(own) if i >= w.n_context and r == "assistant"] == [tuple(s) for s in w.loss]
        assert w.n_tokens <= budget or w.n_new == 1 or w.over_budget is False
        assert w.over_budget == (w.n_tokens > budget)
    for conv in {t[0] for t in turns}:
        wanted = sorted(((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        system = wanted[0][1] == "system"
        mine = sorted(((w, p) for w, p in zip(rows, parsed) if w.conv_id == conv), key=lambda x: x[0].first)
        new = [x[:2] for w, p in mine for x in p[w.n_context:]]
        assert new == [x[1:] for x in wanted]
        for w, p in mine:
            context = [x[:2] for x in p[: w.n_context]]
            if w.first and system:
                assert context.pop(0) == wanted[0][1:]
            assert context == [x[1:] for x in wanted[w.first - len(context) : w.first]]
    back = {r.conv_id: r for r in chat_windows.read_back(windows).collect()}
    for conv, r in back.items():
        own = sorted(((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        loss = "".join(b for _, a, b in own if a == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_windows.read_back(chat_windows.chat_windows(frame.limit(0), Tokenizer(public_tokenizers.path("byte_bpe_50k.json")))).count() == 0


# ---- url -------------------------------------------------------------------------------------------------------


def _split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]


def test_urls_against_plain_rules(spark):
    urls = [None, "", "x", "http://", "a://B.NET/es/x?y#z", "q://EX.com/en/://k", "http://WWW.Example.com/en/1", "http://example.com?/en/",
            "http://xexample.com/en/1", "http://sub.example.com/en/", "http://com/", "http://com", "h\n://É.net/fr/\n?", "a://b://c.com/",
            "http://x.net/es", "https://casino-cheap-pills.example.org/en/9", "http://" + "a" * 3000 + ".net/es/" + "b" * 5000]
    model = url_filter.train(url_filter.labelled_urls(spark))
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls + urls)], "page_id long, url string, path string")
    got = url_filter.judged(pages, model, RULES).collect()
    assert len(got) == len(pages.collect())
    for r in got:
        host, path = _split(r.url)
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == (max(fits)[2] if fits else "block" if r.p_block >= url_filter.BLOCK_FROM else "allow")
    assert {r.verdict for r in got if r.url and "casino" in r.url} == {"block"}
    assert url_filter.judged(pages.limit(0), model, RULES).count() == 0
    assert not any("Python" in x or "Arrow" in x for x in [url_filter.judged(pages, model, RULES)._jdf.queryExecution().toString()])


CLEAN_URLS = ["http://a.example.org/x", "http://b.example.com/", "https://zz.example.net/en/1", "https://q.example.org/" + "y" * 500,
              "https://www.quilt-makers.example.com/en/3", "http://m.tidal-charts.example.net/de/8", "http://orchard.example.org/es/400",
              "https://blog.botany-notes.example.org/fr/2", "https://www.ferry-timetable.example.net/en/77", "http://violin-lessons.example.com/de/5",
              "https://county-archive.example.org/en/1900", "http://m.alpine-huts.example.com/fr/12", "https://ceramics.example.net/es/9"]
SPAM_URLS = ["https://buy-cheap-pills-now.example.com/en/1", "http://online-casino-bonus.example.org/fr/2", "https://poker-casino.example.net/en/5",
             "http://www.cheap-replica-watch.example.com/de/7", "https://payday-cash-loan.example.org/en/4", "http://xxx-cams.example.net/es/6",
             "https://crack-keygen-torrent.example.com/en/8", "http://spam-links.example.org/de/3", "https://click-ads-banner.example.net/fr/1"]


def test_urls_that_were_not_labelled(spark):
    """Held-out precision is 1 and recall at least 0.8 on invented urls; hosts that say nothing are not blocked."""
    model = url_filter.train(url_filter.labelled_urls(spark))
    pages = spark.createDataFrame([(u, u in SPAM_URLS) for u in CLEAN_URLS + SPAM_URLS], "url string, spam boolean")
    got = [(r.spam, r.verdict == "block") for r in url_filter.judged(pages, model).collect()]
    assert got.count((False, True)) == 0
    assert got.count((True, True)) >= 0.8 * len(SPAM_URLS)


def test_a_very_long_url_costs_in_proportion(spark):
    import time

    model = url_filter.train(url_filter.labelled_urls(spark))
    pages = spark.createDataFrame([("http://x.example.org/" + "ab/" * 350_000,)], "url string")
    began = time.time()
    assert [r.verdict for r in url_filter.judged(pages, model).collect()] == ["allow"]
    assert time.time() - began < 30


# ---- toxicity --------------------------------------------------------------------------------------------------


def _toxic_corpus(spark, documents_of, labels_of):
    random.seed(9)
    plain = ["".join(random.choices("abdeghilmnorstu", k=random.randint(3, 9))) for _ in range(400)]
    insults = ["blorgface", "zwackhead", "stinkfisk"]
    rows, labels = [], []
    for i in range(600):
        words, toxic = random.choices(plain, k=60), int(i % 3 == 0)
        if toxic:
            words[random.randrange(60)] = random.choice(insults)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return documents_of(rows), labels_of([*labels, (None, 1, 1), (5, 1, None)]), plain


def test_toxicity_is_learned_and_tolerates_insertions(spark, documents_of, labels_of, awkward, no_documents):
    docs, labels, plain = _toxic_corpus(spark, documents_of, labels_of)
    model = toxicity.train(docs, labels)
    held = toxicity.score(docs, model).where(toxicity.fold() == toxicity.HELD_OUT).collect()
    assert np.mean([(r.score >= toxicity.THRESHOLD) == (r.doc_id % 3 == 0) for r in held]) > 0.95
    clean = " ".join(plain[:50])
    forms = ["blorgface", "b.l.o.r.g.f.a.c.e", "blorgxface", "b l o r g f a c e", "BLORG-FACE", "zwackkhead,"]
    scores = model.probabilities(pa.array([clean, *[f"{clean} {f} {clean}" for f in forms], None, ""]))
    assert scores[0] < 0.3 and scores[-2:].max() < 0.3
    assert (scores[1:-2] > scores[0]).all() and scores[1:6].min() >= 0.3
    assert toxicity.score(awkward, model).count() == len(AWKWARD)
    assert toxicity.score(no_documents, model).count() == 0
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert toxicity.train(no_documents, labels) is None
    assert {r.score for r in toxicity.score(awkward, None).collect()} == {0.0}


def test_folded_weights_are_the_kernel_expansion():
    words = [np.array([ord(c) - 96 for c in w], np.uint8) for w in ("idiot", "banana", "abcabcabcabc", "ab")]
    weights = sum(a * toxicity.triples_of(w) for a, w in zip((1.0, -0.5, 2.0), words))
    flat = toxicity._flat([w.tobytes() for w in words])
    assert toxicity.triple_sums(*flat, weights.astype(np.float32)) == pytest.approx([toxicity.triples_of(w) @ weights for w in words], rel=1e-4)


def test_long_texts_are_scored_in_pieces(monkeypatch):
    model = toxicity.Model(np.random.default_rng(1).normal(size=toxicity.SYMBOLS**3).astype(np.float32), 0.1)
    texts = pa.array([" ".join(f"word{i * 7919 % 1000}" for i in range(3000)), None, "x", "é" * 500])
    whole = model.largest(texts)
    monkeypatch.setattr(toxicity, "_BLOCK", 300)
    assert model.largest(texts) == pytest.approx(whole)


def _brute_kernel(a, b):
    """Common triples of two words of symbols, each weighted by decay to the spans in both."""
    def triples(w):
        found = {}
        for i in range(len(w)):
            for k in range(i + 2, min(i + toxicity.SPAN, len(w))):
                for j in range(i + 1, k):
                    found[w[i], w[j], w[k]] = found.get((w[i], w[j], w[k]), 0) + toxicity.DECAY ** (k - i + 1)
        return found

    left, right = triples(a), triples(b)
    return sum(v * right.get(t, 0) for t, v in left.items())


def _brute_norm(size):
    """The norm of a word of that length whose triples all differ."""
    return max(sum(toxicity.DECAY ** (2 * (k - i + 1)) for i in range(size) for k in range(i + 2, min(i + toxicity.SPAN, size))
                   for _ in range(i + 1, k)), toxicity.DECAY**6) ** 0.5


def test_the_kernel_counts_common_subsequences():
    rng = random.Random(2)
    words = [bytes(rng.choices(range(1, 9), k=n)) for n in (3, 4, 5, 8, 12, 20)]
    for a in words:
        for b in words:
            mine = toxicity.triples_of(np.frombuffer(a, np.uint8)) @ toxicity.triples_of(np.frombuffer(b, np.uint8))
            assert mine == pytest.approx(_brute_kernel(a, b) / _brute_norm(len(a)) / _brute_norm(len(b)), rel=1e-6)
        against = toxicity.triple_sums(*toxicity._flat(words), toxicity.triples_of(np.frombuffer(a, np.uint8)).astype(np.float32))
        assert against == pytest.approx(
            [_brute_kernel(a, b) / _brute_norm(len(a)) / _brute_norm(len(b)) for b in words], rel=1e-3)


def test_marks_follow_one_rule_at_all_sizes(spark):
    """More strong words never make a weaker one unmarked, and words that are as frequent in clean texts are not marked."""
    import math

    rng = random.Random(9)
    plain = [(b"w%d" % i, *sorted((rng.randint(0, 2), rng.randint(5, 40)))) for i in range(400)]
    weak = [(b"weak", 9, 0)]
    for strong in (0, 1, 19, 20, 200):
        counts = spark.createDataFrame(plain + weak + [(b"strong%d" % i, 60, 0) for i in range(strong)], "word binary, t long, c long")
        marked = {bytes(r.word): r.evidence for r in toxicity.marked_words(counts, 0.1).collect()}
        assert b"weak" in marked and sum(w.startswith(b"strong") for w in marked) == strong
        assert not any(w.startswith(b"w") and w != b"weak" for w in marked)
    assert marked[b"weak"] == pytest.approx(9 * -math.log(0.1))
    assert toxicity.marked_words(counts.limit(0), 0.1).count() == 0


def test_spelled_insults_are_whole_in_one_piece(monkeypatch):
    word = np.array([toxicity._CODES[c] for c in b"idiot"], np.uint8)
    vector = toxicity.triples_of(word)
    model = toxicity.Model(vector.astype(np.float32), 0.0)
    monkeypatch.setattr(toxicity, "_BLOCK", 2000)
    for shift in range(0, 24):
        text = "a" * (1960 + shift) + " plain i d i o t plain " + "word " * 900
        assert model.largest(pa.array([text]))[0] == pytest.approx(vector @ vector, rel=1e-3)


def test_long_words_are_learned_in_parts():
    word = bytes(range(1, 61)) * 4
    parts = toxicity._parts(word)
    assert all(len(p) <= toxicity._PART for p in parts) and all(any(word[i : i + 8] in p for p in parts) for i in range(len(word) - 8))


# ---- quality ---------------------------------------------------------------------------------------------------


def test_quality_is_learned(spark, documents_of, labels_of, awkward, no_documents):
    random.seed(11)
    words = [f"w{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(600):
        good = i % 4 != 0
        rows.append((i, " ".join(random.choices(words, k=80)) if good else " ".join([random.choice(words)] * 40) + " #$% " * 20))
        if i % 2:
            labels.append((i, int(good), 0))
    labels += [(i, int(i % 4 != 0), 0) for i in range(0, 400, 4)]
    docs = documents_of(rows)
    model = quality.train(docs, labels_of([*labels, (None, 1, 0)]))
    got = quality.scored(docs, model).collect()
    assert all((r.p_quality >= quality.KEEP) == (r.doc_id % 4 != 0) for r in got)
    out = quality.scored(awkward.withColumn("p_text", F.lit("clash")), model)
    assert out.count() == len(AWKWARD) and dict(out.dtypes)["p_text"] == "double"
    assert quality.scored(no_documents, model).count() == 0
    assert quality.train(no_documents, labels_of(labels)) is None
    assert quality.train(docs, labels_of([])) is None
    assert {r.p_quality for r in quality.scored(awkward, None).collect()} == {1.0}


def test_text_features_do_not_depend_on_neighbours():
    texts = ["one two two", None, "", "A!! | b" * 50, "x" * 100, "é è"]
    together = quality.text_features(pa.array(texts))
    alone = np.vstack([quality.text_features(pa.array([t], pa.string())) for t in texts])
    assert together == pytest.approx(alone)


def test_co_training_gives_pseudo_labels_to_the_other_view():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 3000).astype(float)
    views = [rng.normal(size=(3000, 3)) + 2.5 * y[:, None], rng.normal(size=(3000, 2)) + 1.5 * y[:, None]]
    few = [v[:60] for v in views]
    pool = [v[60:2000] for v in views]
    rest = [v[2000:] for v in views]
    model = quality.co_train(few, y[:60], pool)
    assert np.mean((model.log_odds(rest)[:, 2] > 0) == (y[2000:] == 1)) > 0.95
