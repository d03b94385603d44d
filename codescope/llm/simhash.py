"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescope.plans.lineage import stored

from .components import components
from .tables import aside

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
SEGMENTS = 2
HASH_SEED = 42
BITS = 64

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))
_PIECE = 1 << 20


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of ``text`` in lists of about a megabyte."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + _PIECE) if at + _PIECE < len(text) else None
        end = gap.start() if gap else len(text)
        yield _WORD.findall(text, at, end)
        at = end


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """The 64-bit SimHash of one text over runs of ``shingle_words`` words, repeats included."""
    data = (text or "").encode("utf-8", "replace").translate(_LOWER)
    ones, total, carried = np.zeros(BITS, np.int64), 0, []
    for words in _pieces(data):
        words = carried + words
        carried = words[-(shingle_words - 1) :] if shingle_words > 1 else []
        if len(words) < shingle_words:
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle_words + 1].tolist()
        hashes = [xxhash.xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends[shingle_words - 1 :].tolist())]
        ones += _bit_counts(hashes)
        total += len(hashes)
    if not total and carried:
        ones, total = _bit_counts([xxhash.xxh64_intdigest(b" ".join(carried), seed)]), 1
    return int(np.packbits((2 * ones > total).astype(np.uint8), bitorder="little").view("<u8")[0])


def _bit_counts(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little")
    return bits.reshape(-1, BITS).sum(axis=0, dtype=np.int64)


def fingerprints(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, seed: int = HASH_SEED, with_digest: bool = False
) -> DataFrame:
    """``(doc_id, fingerprint)``: the fingerprint as a signed long; on request also ``digest``, the text's SHA-256.

    One narrow Arrow stage; other columns are not read.
    """
    names = ["doc_id", "fingerprint", *["digest"] * with_digest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(text.as_py(), shingle_words, seed) for text in batch.column(1)]
            column = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), column, *batch.columns[2:]], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", "text", *[digest_of_text().alias("digest")] * with_digest)
    return read.mapInArrow(run, f"doc_id {kind}, fingerprint long" + ", digest string" * with_digest)


def digest_of_text() -> Column:
    return F.sha2("text", 256)


def segment_balls(max_distance: int, segments: int) -> list[tuple[int, int, list[int]]]:
    """(shift, width, masks) of the segments to be probed.

    Of two fingerprints at ``r = segments * q + a`` bits or less, one of the first ``a + 1`` segments differs in at
    most ``q`` bits, or one of the others in at most ``q - 1``; the masks enumerate these Hamming balls.
    """
    q, a = divmod(max_distance, segments)
    bounds = [BITS * i // segments for i in range(segments + 1)]
    found = []
    for i, (low, high) in enumerate(itertools.pairwise(bounds)):
        radius = q if i <= a else q - 1
        masks = [
            sum(1 << bit for bit in flipped)
            for size in range(radius + 1)
            for flipped in itertools.combinations(range(high - low), size)
        ]
        if masks:
            found.append((low, high - low, masks))
    return found


def _segment(value: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1)) if width < BITS else value


def fingerprint_links(distinct: DataFrame, max_distance: int = MAX_DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Pairs ``(a, b)`` of distinct ``fingerprint`` values at ``max_distance`` bits or less, ``a < b``.

    The table has one row per fingerprint and segment. Every fingerprint looks up each value of the small Hamming
    ball around its own segment there, and what it meets is compared in all bits inside the join, so only true links
    leave it. All pairs of copies are avoided because the values are distinct. Work grows with the number of
    fingerprints times the size of the balls.
    """
    value = F.col("fingerprint")
    balls = segment_balls(max_distance, segments)
    index = distinct.select(
        F.posexplode(F.array(*[_segment(value, shift, width) for shift, width, _ in balls])).alias("segment", "bucket"),
        value.alias("b"),
    )
    probes = None
    for at, (shift, width, masks) in enumerate(balls):
        mask = F.explode(F.array(*map(F.lit, masks)))
        part = distinct.select(value.alias("a"), mask.alias("mask")).select(
            F.lit(at).alias("segment"),
            _segment(F.col("a"), shift, width).bitwiseXOR(F.col("mask").cast("long")).alias("bucket"),
            "a",
        )
        probes = part if probes is None else probes.union(part)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    met = probes.alias("p").join(
        index.alias("i"),
        (F.col("p.segment") == F.col("i.segment")) & (F.col("p.bucket") == F.col("i.bucket"))
        & (F.col("a") < F.col("b")) & near,
    )
    return met.select("a", "b").distinct()


def smallest_of_components(prints: DataFrame, value: Column, max_distance: int, segments: int) -> DataFrame:
    """``(fingerprint, smallest)``: the smallest ``value`` of the rows of ``prints`` in the component of each fingerprint."""
    distinct = stored(prints.groupBy("fingerprint").agg(F.min(value).alias("first")))
    roots = components(fingerprint_links(distinct, max_distance, segments), "a", "b")
    rooted = distinct.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("smallest"))
    return stored(rooted.join(smallest, "root").select("fingerprint", "smallest"))


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
    segments: int = SEGMENTS,
    seed: int = HASH_SEED,
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    ``fingerprint`` is 16 hex digits; documents whose fingerprints are linked, also over others, share the smallest
    ``doc_id`` among them as ``component_id``. Texts without words (null, empty, only spaces) have fingerprint zero
    and are linked like any other. Copies meet as one fingerprint, so a group of any size costs one row. A repeated
    row is returned as often as it comes; a null ``doc_id`` is the smallest only where its component has no other.
    An empty table gives an empty result; further columns are ignored.
    """
    prints = stored(fingerprints(docs, shingle_words, seed))
    named = smallest_of_components(prints, F.col("doc_id"), max_distance, segments)
    return prints.join(named, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("smallest").alias("component_id")
    )


def first_of_each(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
    segments: int = SEGMENTS,
    seed: int = HASH_SEED,
) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: that with the smallest ``doc_id``, null last.

    Of rows that share the id the one whose text has the smallest SHA-256 stays, a null text first; of rows that
    repeat both, which are looked for first, one is taken.
    """
    docs, given_back = aside(docs, ["_id", "_sha"])
    prints = stored(fingerprints(docs, shingle_words, seed, with_digest=True))
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
    named = smallest_of_components(prints, row, max_distance, segments)
    is_first = F.col("doc_id").eqNullSafe(F.col("smallest.doc_id")) & F.col("digest").eqNullSafe(F.col("smallest.digest"))
    dropped = stored(
        prints.join(named, "fingerprint").where(~is_first)
        .select(F.col("doc_id").alias("_id"), F.col("digest").alias("_sha")).distinct()
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & digest_of_text().eqNullSafe(F.col("_sha"))
    rows = docs.join(dropped, same, "left_anti")
    if prints.groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        return given_back(rows)
    return given_back(rows.withColumn("_sha", digest_of_text()).dropDuplicates(["doc_id", "_sha"]).drop("_sha"))
