"""Secrets in texts: fixed patterns, and strings that a battery of randomness tests cannot tell from random."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescope.plans.lineage import stored

from .words import blocks, text_buffers, word_bounds

KINDS = ("assign", "access", "hex", "random")
MIN_CHARS = 20
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Share of random strings among those that are dismissed as ordinary text, at most.
FALSE_DISMISSALS = 0.01

# The patterns of the three base kinds.
_ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_KEYWORDS = (b"passw", b"secret", b"token", b"key")

_DIGITS, _LOWER, _UPPER = b"0123456789", bytes(range(0x61, 0x7B)), bytes(range(0x41, 0x5B))
#: Encodings from the narrowest alphabet to the widest; a string has the first one that holds all its characters.
ENCODINGS = {
    "hex_lower": _DIGITS + b"abcdef",
    "hex_upper": _DIGITS + b"ABCDEF",
    "base32": _UPPER + b"234567",
    "base36_lower": _DIGITS + _LOWER,
    "base36_upper": _DIGITS + _UPPER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + b"+/",
    "base64url": _UPPER + _LOWER + _DIGITS + b"-_",
}


def _outside(alphabet: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(alphabet)] = False
    return table


_NOT_HEX = _outside(ENCODINGS["hex_lower"])
_NOT_TOKEN = _outside(_DIGITS + _LOWER + _UPPER + b"+/-_")
#: One or two characters that fill up the end of a token; any other '=' stands between a name and a value.
_PADDING = re.compile(rb"={1,2}(?![A-Za-z0-9+/_=-])")
#: Parts of a run in the order in which they are preferred: up to '/' and '+', up to '-' and '_', up to all four.
_PARTS = [re.compile(rb"[A-Za-z0-9%s]{%d,}" % (more, MIN_CHARS)) for more in (b"_-", b"+/", b"")]
_PLACE = {name: {byte: i for i, byte in enumerate(alphabet)} for name, alphabet in ENCODINGS.items()}


def _kinds(alphabet: bytes) -> np.ndarray:
    kinds = [0 if b in _DIGITS else 1 if b in _LOWER else 2 if b in _UPPER else 3 for b in alphabet]
    return np.unique(kinds, return_inverse=True)[1]


_KIND_OF = {name: _kinds(alphabet) for name, alphabet in ENCODINGS.items()}


def encoding_of(token: bytes) -> str | None:
    used = set(token.rstrip(b"="))
    return next((name for name, place in _PLACE.items() if used <= place.keys()), None)


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_squared_tail(value: float, freedom: int) -> float:
    """Wilson and Hilferty's approximation."""
    spread = 2 / (9 * freedom)
    return 0.5 * math.erfc(((value / freedom) ** (1 / 3) - (1 - spread)) / math.sqrt(2 * spread))


def battery(token: bytes, encoding: str) -> float:
    """The probability that a random string of this alphabet and length looks as ordered as ``token`` or more.

    Combined by Sidak's rule: chi-squared of all symbols of the alphabet, and of its kinds of characters; runs above and
    below its middle; correlation of each symbol with the next.
    """
    place = _PLACE[encoding]
    symbols = np.array([place[byte] for byte in token.rstrip(b"=")], float)
    n, size = len(symbols), len(place)
    counts = np.bincount(symbols.astype(int), minlength=size)
    found = [_chi_squared_tail(float((counts**2).sum()) * size / n - n, size - 1)]
    kinds = _KIND_OF[encoding]
    expected = n * np.bincount(kinds) / size
    if len(expected) > 1:
        seen = np.bincount(kinds, weights=counts)
        found.append(_chi_squared_tail(float(((seen - expected) ** 2 / expected).sum()), len(expected) - 1))
    above = symbols >= size / 2
    high, low = int(above.sum()), int(n - above.sum())
    if high and low and n > 2:
        mean = 2 * high * low / n + 1
        variance = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + int((above[1:] != above[:-1]).sum())
        found.append(_normal_tail((runs - mean) / math.sqrt(variance)) if variance > 0 else 0.0)
    else:
        found.append(0.0)
    centred = symbols - symbols.mean()
    power = float((centred**2).sum())
    found.append(_normal_tail((float((centred[1:] * centred[:-1]).sum()) / power * n + 1) / math.sqrt(n)) if power else 0.0)
    return 1 - (1 - min(max(min(found), 0.0), 1.0)) ** len(found)


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes of the patterned kinds but ``hex``."""
    found = []
    lowered = text.lower()
    if any(word in lowered for word in _KEYWORDS):
        found += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if b"AKIA" in text:
        found += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return found


def length_class(size: int) -> int:
    """Half octaves: strings of one class differ in length by less than half."""
    return int(2 * math.log2(size))


def _parts(text: bytes, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The run itself, then its parts; each may overlap earlier ones."""
    yield start, end
    for pattern in _PARTS:
        for m in pattern.finditer(text, start, end):
            yield m.span()


def _candidates(text: bytes, runs: list[tuple[int, int]], taken: list[tuple[int, int, int]]) -> list[tuple]:
    """Strings to be tested outside ``taken``: each run that fits an alphabet, and the parts of each run."""
    found = []
    taken = sorted((s, e) for _, s, e in taken)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    for run in runs:
        for start, end in dict.fromkeys(_parts(text, *run)):
            size, padding = end - start, _PADDING.match(text, end)
            end = padding.end() if padding else end
            before = bisect_left(starts, end)
            if before and reach[before - 1] > start:
                continue
            token = text[start:end]
            encoding = encoding_of(token)
            if encoding and size >= (MIN_HEX if encoding.startswith("hex") else MIN_CHARS):
                found.append((start, end, encoding, length_class(size), battery(token, encoding)))
    return found


def _scan(ids: pa.Array, texts: pa.Array) -> tuple[list, list]:
    offsets, data = text_buffers(texts)
    spans, strings = [[] for _ in range(len(ids))], [[] for _ in range(len(ids))]
    for first, last in blocks(offsets):
        part, inner = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        runs = []
        for outside, least in ((_NOT_HEX, MIN_HEX), (_NOT_TOKEN, MIN_CHARS)):
            starts, ends = word_bounds(part, inner, outside)
            long = ends - starts >= least
            rows = np.searchsorted(inner, starts[long], side="right") - 1
            by_row = defaultdict(list)
            for row, start, end in zip(rows.tolist(), starts[long].tolist(), ends[long].tolist()):
                by_row[row].append((start - int(inner[row]), end - int(inner[row])))
            runs.append(by_row)
        raw = part.tobytes()
        for row in range(last - first):
            text = raw[inner[row] : inner[row + 1]]
            found = base_spans(text) + [(2, s, e) for s, e in runs[0].get(row, ())]
            more = _candidates(text, runs[1][row], found) if row in runs[1] else []
            if found or more:  # bytes to code points
                points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                spans[first + row] = [{"kind": k, "start": int(points[s]), "end": int(points[e])} for k, s, e in found]
                strings[first + row] = [
                    {"start": int(points[s]), "end": int(points[e]), "encoding": c, "length": n, "p": p} for s, e, c, n, p in more
                ]
    return spans, strings


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_STRINGS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("length", pa.int32()),
                               ("p", pa.float64())]))
_NAMED = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scanned(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, strings)``: patterned spans, and candidate strings with the result of the battery."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, strings = _scan(batch.column(0), batch.column(1))
            columns = [batch.column(0), pa.array(spans, _SPANS), pa.array(strings, _STRINGS)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "base", "strings"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, base array<struct<kind:int,start:int,end:int>>,"
        " strings array<struct<start:int,end:int,encoding:string,length:int,p:double>>",
    )


#: Steps of ten to the minus a tenth in which probabilities are counted.
_STEPS = 160


def dismissal_bounds(strings: DataFrame, share: float = FALSE_DISMISSALS) -> dict[tuple[str, int], float]:
    """(encoding, length class) -> the probability at or below which a string counts as ordinary text.

    Benjamini and Hochberg's procedure inside each class, over the strings of all documents: of the strings that are
    dismissed at most ``share`` are expected to be random. Longer strings are judged among their like, where the
    tests are stronger. Only a histogram of fixed size comes to the driver.
    """
    step = F.least(F.floor(-10 * F.log10(F.greatest("s.p", F.lit(1e-300)))), F.lit(_STEPS)).cast("int")
    counted = strings.select(F.explode("strings").alias("s")).groupBy("s.encoding", "s.length", step.alias("step")).count()
    histogram: dict[tuple[str, int], dict[int, int]] = defaultdict(dict)
    for row in counted.collect():
        histogram[row.encoding, row.length][row.step] = row["count"]
    bounds = {}
    for key, counts in histogram.items():
        total, upto, bound = sum(counts.values()), 0, 0.0
        for step_no in range(_STEPS, -1, -1):
            upto += counts.get(step_no, 0)
            p = 10 ** (-step_no / 10)
            if upto and p <= share * upto / total:
                bound = p
        bounds[key] = bound
    return bounds


def _disjoint(strings: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of ``strings`` that overlap no earlier one that is kept."""
    kept: list[tuple[int, int]] = []
    for start, end in strings:
        at = bisect_right(kept, (start, end))
        if (not at or kept[at - 1][1] <= start) and (at == len(kept) or kept[at][0] >= end):
            insort(kept, (start, end))
    return kept


def find_secrets(docs: DataFrame, share: float = FALSE_DISMISSALS) -> DataFrame:
    """``(doc_id, spans)``, one row for each row of ``docs``; ``spans`` holds kind, start and end in code points.

    Patterned spans are always kept. A run of ``MIN_CHARS`` or more token characters outside them is added as
    ``random`` unless the battery dismisses it, hexadecimal ones from ``MIN_HEX``, as the patterned kind; runs end at
    '=', which belongs to them only as padding. Where a run fits no alphabet, is dismissed or meets a patterned span, its parts between
    '/' and '+', between '-' and '_', and between all four count instead, the earlier named first. Spans are sorted by
    start, then by kind as listed in ``KINDS``. Texts are read once, where they lie; the only shuffle is that of a
    small histogram. Null and empty texts have no spans. Repeated rows and null ids are returned as they come; an empty
    table gives an empty result; further columns are ignored.
    """
    found = stored(scanned(docs))
    bounds = dismissal_bounds(found, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for base, strings in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kept = _disjoint([(s["start"], s["end"]) for s in strings if s["p"] > bounds[s["encoding"], s["length"]]])
                ordered = sorted([(b["start"], b["kind"], b["end"]) for b in base] + [(start, 3, end) for start, end in kept])
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in ordered])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _NAMED)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")
