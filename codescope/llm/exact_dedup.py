"""Exact deduplication: static filters screen what comes in, exact buckets and bytes decide."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescope.plans.joins import fits_broadcast
from codescope.plans.lineage import stored

from . import fuse_filter
from .tables import aside

#: Keys that one filter should hold; a snapshot has as many shards as this needs.
KEYS_PER_FILTER = 50_000
BATCHES = 2
DIGEST_BITS = 256


def normalised(text: Column | str) -> Column:
    """Every run of white space as one space; null as empty. Runs that are one space already are not touched."""
    text = F.col(text) if isinstance(text, str) else text
    spaces = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
    return F.regexp_replace(F.coalesce(text, F.lit("")), spaces, " ")


def text_digest(text: Column, bits: int = DIGEST_BITS) -> Column:
    """Lowercase hex of the leading ``bits`` of SHA-256 of ``text`` in UTF-8."""
    digest = F.sha2(text, 256)
    return digest if bits == DIGEST_BITS else F.substring(digest, 1, bits // 4)


@dataclass
class Snapshot:
    """An immutable set of digests: ``buckets(digest, key, keep_id, n)`` and one filter for each shard of the keys."""

    buckets: DataFrame
    filters: DataFrame
    shards: int


def _key() -> Column:
    """What the filters hold of a digest. Digests may share a key; nothing but the screening goes by it."""
    return F.xxhash64("digest")


def _shard(shards: int) -> Column:
    return F.pmod(F.hash("key"), F.lit(shards))


def build_snapshot(buckets: DataFrame) -> Snapshot:
    """Freeze stored ``buckets``; their digests are distinct, so shards are even and of bounded size."""
    shards = max(1, -(-buckets.count() // KEYS_PER_FILTER))

    def build(key: tuple, keys: pa.Table) -> pa.Table:
        data = fuse_filter.build(keys.column("key").to_numpy())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([data], pa.binary())})

    keyed = buckets.select(_shard(shards).alias("shard"), "key")
    filters = keyed.groupBy("shard").applyInArrow(build, "shard int, filter binary")
    return Snapshot(buckets, stored(filters), shards)


def screen(incoming: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The ``digest`` values of ``incoming(digest, key)`` that the snapshot's filters may hold.

    Filters and keys meet by shard, the filter sorted first, and stream through: a task holds one filter at a time and
    nothing is broadcast.
    """
    filters = snapshot.filters.select("shard", F.lit(0).alias("kind"), "filter", F.lit(None).cast("string").alias("digest"),
                                      F.lit(None).cast("long").alias("key"))
    asked = incoming.select(_shard(snapshot.shards).alias("shard"), F.lit(1).alias("kind"),
                            F.lit(None).cast("binary").alias("filter"), "digest", "key")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, data = None, b""
        for batch in batches:
            shards, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys = batch.column(4).fill_null(0).to_numpy(zero_copy_only=False)
            passed = np.zeros(len(kinds), bool)
            edges = [0, *np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1, len(kinds)]
            for low, high in zip(edges[:-1], edges[1:]):
                if low == high:
                    continue
                if kinds[low] == 0:
                    shard, data = shards[low], batch.column(2)[low].as_py()
                elif shards[low] == shard:  # else the snapshot has no key in this shard
                    passed[low:high] = fuse_filter.contains(data, keys[low:high])
            yield pa.RecordBatch.from_arrays([batch.column(3).filter(pa.array(passed))], ["digest"])

    met = filters.union(asked).repartition("shard").sortWithinPartitions("shard", "kind")
    return met.mapInArrow(test, "digest string")


def _batches(digests: DataFrame, count: int) -> list[DataFrame]:
    """Successive ranges of ``doc_id``, or of its hash if it is no number, with about as many rows each; null comes last."""
    number_like = isinstance(digests.schema["doc_id"].dataType, T.NumericType)
    place = F.col("doc_id") if number_like else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    cuts = digests.agg(F.percentile_approx(place, [i / count for i in range(1, count)])).first()[0] if count > 1 else []
    cuts = sorted(set(cuts or []))
    number = reduce(lambda a, b: a + b, [F.coalesce(place > c, F.lit(True)).cast("int") for c in cuts], F.lit(0))
    return [digests.where(number == i) for i in range(len(cuts) + 1)]


def _among(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """Rows whose ``digest`` is in ``digests``; these are broadcast when measured as few, else both sides are shuffled."""
    return rows.join(F.broadcast(digests) if fits_broadcast(digests) else digests, "digest", "left_semi")


def exact_duplicates(docs: DataFrame, batches: int = BATCHES, digest_bits: int = DIGEST_BITS) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row for each row of ``docs``.

    Texts are equal when identical after ``normalised``; of equal texts the row with the smallest ``doc_id`` stays.
    Documents come in as ``batches`` successive batches. Each is grouped by digest, its groups are screened by the
    filters of every earlier snapshot, positives are looked up in that snapshot's exact buckets, and what is new
    becomes the next snapshot. All classes of more than one row are then checked by their bytes, and digests that
    stand for several texts are split by text. Groups are combined before every shuffle, and only texts of
    classes with several rows are shuffled.

    Null text counts as empty, and empty texts are equal like others. Of rows that repeat both text and ``doc_id``
    one stays. A null ``doc_id`` stays only if its class has no other. An empty table gives an empty result; further
    columns are ignored. ``digest_bits`` below 256 is for tests of colliding digests.
    """
    texts = docs.select("doc_id", normalised("text").alias("_text")).select(
        "doc_id", "_text", text_digest(F.col("_text"), digest_bits).alias("digest"), F.sha2("_text", 256).alias("text_sha256")
    )
    digests = stored(texts.select("doc_id", "digest", "text_sha256", _key().alias("key")))
    snapshots: list[Snapshot] = []
    matches: list[DataFrame] = []
    for batch in _batches(digests, batches):
        groups = batch.groupBy("digest", "key").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
        if snapshots:
            groups = stored(groups)
            found = [
                screen(groups, s).join(s.buckets.select("digest"), "digest", "left_semi") for s in snapshots
            ]
            known = stored(reduce(DataFrame.union, found))
            matches.append(groups.join(known, "digest", "left_semi"))
            groups = groups.join(known, "digest", "left_anti")
        snapshots.append(build_snapshot(stored(groups)))
    columns = ["digest", "key", "keep_id", "n"]
    classes = reduce(DataFrame.union, [s.buckets.select(columns) for s in snapshots])
    if matches:
        again = reduce(DataFrame.union, [m.select(columns) for m in matches]).groupBy("digest").agg(
            F.min("keep_id").alias("again_id"), F.sum("n").alias("again_n")
        )
        classes = classes.join(again, "digest", "left").select(
            "digest", "key", F.least("keep_id", "again_id").alias("keep_id"),
            (F.col("n") + F.coalesce("again_n", F.lit(0))).alias("n"),
        )
    classes = stored(classes)

    # bytes: the rows of every class with several rows, grouped by their whole text
    several = classes.where("n > 1").select("digest")
    checked = _among(texts, several).groupBy("digest", "_text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    checked = stored(checked.select("digest", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "n"))
    whole = classes.where("n = 1").select("digest", "keep_id", "n")
    repeats = Window.partitionBy("text_sha256", "doc_id").orderBy("digest")
    rows = digests.select("doc_id", "digest", "text_sha256", F.row_number().over(repeats).alias("_nth"))
    split = checked.groupBy("digest").count().where("count > 1")
    if digest_bits == DIGEST_BITS and split.isEmpty():
        named = rows.join(whole.union(checked.select("digest", "keep_id", "n")), "digest")
    else:  # digests that stand for several texts: the texts tell the classes apart
        named = rows.join(whole, "digest").unionByName(rows.join(checked, ["digest", "text_sha256"]))
    return named.select(
        "doc_id", "keep_id", F.col("n").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1)).alias("kept"), "text_sha256",
    )


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``exact_duplicates`` keeps.

    Kept ids meet the rows by id and digest; of rows that repeat both, which are looked for first, one is taken.
    """
    docs, given_back = aside(docs, ["_id", "_sha"])
    kept = stored(exact_duplicates(docs, **options).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.sha2(normalised("text"), 256) == F.col("_sha"))
    rows = docs.join(kept, same, "left_semi")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return given_back(rows)
    keyed = rows.withColumn("_sha", F.sha2(normalised("text"), 256))
    return given_back(keyed.dropDuplicates(["doc_id", "_sha"]).drop("_sha"))
