import hashlib
import re

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from codescope.llm import secret_scan, token_counts
from tests.llm.conftest import AWKWARD

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("path", [JSON, MODEL, public_tokenizers.path("word_bpe_49k.json")])
def test_counts_are_the_librarys(path):
    texts = ["", "a b", "  two  spaces ", "it's <|endoftext|> here", "日本 語\x1c\x1d x", "tab\t\n\n end ", "a　b\x85c", "n" * 300]
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        wanted = [len(model.encode(t)) for t in texts]
    else:
        model = tokenizers.Tokenizer.from_file(path)
        wanted = [len(model.encode(t, add_special_tokens=False).ids) for t in texts]
    tokenizer = token_counts.Tokenizer(path)
    assert tokenizer.counts(texts) == wanted
    assert tokenizer.counts(texts) == wanted  # from what it remembers


def test_cache_is_filled_once_and_kept_apart_by_version(spark, awkward, no_documents, tmp_path):
    cache = token_counts.CountCache(spark, f"{tmp_path}/cache")
    tokenizer = token_counts.Tokenizer(JSON)
    rows = token_counts.token_counts(awkward, tokenizer, cache).collect()
    assert len(rows) == len(AWKWARD)
    assert {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (1, 2)} == {(0, 0)}
    stored = spark.read.parquet(f"{tmp_path}/cache").count()
    assert stored == len({t or "" for _, t in AWKWARD})
    assert sorted(map(tuple, token_counts.token_counts(awkward, tokenizer, cache).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert spark.read.parquet(f"{tmp_path}/cache").count() == stored
    token_counts.token_counts(awkward, token_counts.Tokenizer(MODEL), cache)
    assert spark.read.parquet(f"{tmp_path}/cache").count() == 2 * stored
    assert token_counts.token_counts(no_documents, tokenizer, cache).count() == 0


def _plain_spans(text):
    """The three patterned kinds as they are defined, on characters."""
    found = []
    assign = re.compile(
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
        r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_spans_and_random_strings(spark, documents_of, awkward, no_documents):
    key = hashlib.sha256(b"1").hexdigest()
    base62 = "q7Xv2LmZ9aRt4KpW8sYc3NbE6uHd"
    texts = [
        f"é PassWord = 'abc123' token:short api_key=\"{key}\" apikey : {key[:5]}", f"AKIA{'A1B2C3D4' * 2} AKIAshort {key} {key[:23]}",
        "secret==abcdef password: : x ſecret=abcdefgh toKen=abcdefgh", f"plain words and {base62} between", "AKIAAKIA" * 4,
        "donaudampfschifffahrtsgesellschaftskapitaen and internationalisation", "x" * 400, "ab" * 60, None, "",
    ] * 3
    rows = secret_scan.find_secrets(documents_of(list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    kinds = {k: i for i, k in enumerate(secret_scan.KINDS)}
    for row in rows:
        text = texts[row.doc_id] or ""
        spans = [(s.start, kinds[s.kind], s.end) for s in row.spans]
        assert spans == sorted(spans)
        assert [s for s in spans if s[1] < 3] == _plain_spans(text)
        added = [text[a:b] for a, k, b in spans if k == 3]
        assert added == ([base62] if base62 in text else [])
    assert secret_scan.find_secrets(awkward).count() == len(AWKWARD)
    assert secret_scan.find_secrets(no_documents).count() == 0


def test_random_strings_beside_equals_signs_and_in_paths(documents_of):
    base62, base64 = "q7Xv2LmZ9aRt4KpW8sYc3NbE6uHdTf5GjQ0iVo1B", "wJ9r+XUtnF7M2/K7MD8pG1bPxRf5CYzQhTkLe3Vy"
    texts = [
        f"AWS_SECRET_ACCESS_KEY={base64} x", f"private_key={base62}", f"foo[1]={base62}==", f"https://a.b/c?sig={base62}&x=1",
        f"dir_name/{base62}", f"some-dir/{base62}_old/name", f"={base62}=", f"name=={base62}===", f"a_b/{'0f' * 12}c1/{base62}",
        f"a-b/c_d={base62}", f"usr/share/documents/internationalization/configuration/{base62}",
    ]
    wanted = [base64, base62, base62 + "==", base62, base62, base62 + "_old", base62 + "=", base62, base62, base62, base62]
    plain = ["src/main_module/internationalization/configuration-manager", "donaudampfschifffahrtsgesellschaft=no"] * 20
    rows = secret_scan.find_secrets(documents_of(list(enumerate(texts + plain)))).collect()
    added = {r.doc_id: [(texts + plain)[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "random"] for r in rows}
    assert [added[i] for i in range(len(texts))] == [[w] for w in wanted]
    assert not any(added[len(texts) + i] for i in range(len(plain)))


def test_short_keys_of_narrow_alphabets_are_judged_among_their_like(documents_of):
    keys = ["7A1C9E04B3F8D2650EC7A94B", "2QXNKJ2VMZ5RTAWO4PDU", "k3x9qzov7mt2wr8rj5bp", "KX9QZ0V7MTG2WRJ65YBP1"]
    rows = secret_scan.find_secrets(documents_of([(i, f"words before {k} and after") for i, k in enumerate(keys)])).collect()
    assert sorted((r.doc_id, [(s.kind, s.end - s.start) for s in r.spans]) for r in rows) == [
        (i, [("random", len(k))]) for i, k in enumerate(keys)]


def test_battery_is_calibrated():
    import random

    random.seed(5)
    for encoding, size in (("hex_lower", 40), ("base62", 32), ("base64", 88)):
        alphabet = secret_scan.ENCODINGS[encoding]
        ps = [secret_scan.battery(bytes(random.choices(alphabet, k=size)), encoding) for _ in range(2000)]
        assert 0.02 < sum(p <= 0.05 for p in ps) / len(ps) < 0.08
