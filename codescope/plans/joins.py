"""Joins between a large table and a list whose size is not known in advance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A list is broadcast only when a count has shown it to be below both limits.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
# Path lists up to this length are also given to the scan as a literal filter.
INLINE_PATHS = 200
# Name lists up to this length are looked for in each text by a literal filter before files are parsed.
INLINE_NAMES = 1_000
SALTS = 32
# Requests to one file that may stand in its row while it is parsed, and by how much a part of more may pass that.
PATH_REQUESTS = 1_000
_PART_REQUESTS = 4
# Requests are brought to the texts before these are parsed where they name at least this many files.
MANY_PATHS = 10_000
# Files that a task sorts and parses with the requests to them.
TASK_PATHS = 20_000


def is_small(rows: int, size: int) -> bool:
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def row_bytes(frame: DataFrame) -> Column:
    def width(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.StringType | T.BinaryType):
            return F.coalesce(F.octet_length(field.name), F.lit(0)).cast("long")
        if isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
            return F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0)).cast("long")
        return F.lit(8).cast("long")

    return sum((width(f) for f in frame.schema.fields), F.lit(16).cast("long"))


def fits_broadcast(frame: DataFrame) -> bool:
    """Measure ``frame`` with one aggregate that is combined before its shuffle."""
    return is_small(*frame.agg(F.count("*"), F.coalesce(F.sum(row_bytes(frame)), F.lit(0))).first())


def list_join(
    rows: DataFrame, listed: DataFrame, keys: list[str], small: bool | None = None, read_twice: bool = True
) -> DataFrame:
    """Inner equi-join of a large ``rows`` with a ``listed`` table of any size.

    A list measured as small is broadcast, so ``rows`` is not shuffled. Otherwise both sides are shuffled on the key
    plus a salt taken from the other columns of ``rows``: one key holding a third of the rows is spread over
    ``SALTS`` partitions. The salt is a hash, so a recomputed task gives the same rows. A row of the list is repeated
    only for the salts that ``rows`` of its key really use, which reads ``rows`` twice; where these are dear
    (``read_twice=False``) it is repeated for every salt.
    """
    small = fits_broadcast(listed) if small is None else small
    if small:
        return rows.join(F.broadcast(listed), keys)
    others = [c for c in rows.columns if c not in keys] or keys
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int"))
    if read_twice:
        copies = listed.join(salted.select(*keys, "_salt").distinct(), keys)
    else:
        copies = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def file_join(rows: DataFrame, listed: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """``list_join`` for ``keys`` with the path of a file in which ``rows`` stand: one file bounds the rows of a key, so
    nothing is salted or repeated."""
    return rows.join(F.broadcast(listed) if small else listed, keys)


def restrict_to_paths(files: DataFrame, wanted: DataFrame, small: bool) -> DataFrame:
    """Files whose ``path`` occurs in ``wanted``: a pushed-down literal filter for few paths, else a semi-join."""
    paths = wanted.select("path").where(F.col("path").isNotNull()).distinct()
    few = [r.path for r in paths.limit(INLINE_PATHS + 1).collect()]
    if len(few) <= INLINE_PATHS:
        return files.where(F.col("path").isin(few))
    return files.join(F.broadcast(paths) if small else paths, "path", "left_semi")


def with_requests(files: DataFrame, requests: DataFrame, how: str = "inner") -> DataFrame | None:
    """The files that ``requests`` name, with requests to one in its array ``_asked``; ``how="left"`` keeps those to files
    that are not there, whose ``_there`` is null.

    One join, whose tasks are as many as the named files need: left to the shuffled bytes, which are compressed, or to a
    fixed number, a task's share of the files would grow with them. A file that more than ``PATH_REQUESTS`` name stands
    in a row for each part of about that many, and its rows in up to ``SALTS`` tasks. None where requests must be salted
    instead: to few files, or very many that even their ``req_id`` does not tell apart.
    """
    each = requests.where(F.col("path").isNotNull())
    key, parts_of = F.xxhash64("path"), max(PATH_REQUESTS, 1)
    counts = each.groupBy(key.alias("_key")).count()
    is_hot = F.col("count") > PATH_REQUESTS
    paths, n_hot = counts.agg(F.count("*"), F.count_if(is_hot)).first()
    if paths < MANY_PATHS:
        return None
    others = [c for c in requests.columns if c != "path"]
    tasks = max(requests.sparkSession.sparkContext.defaultParallelism, -(-paths // TASK_PATHS))
    there, spots = files.withColumn("_there", F.lit(True)), ["path"]
    if not n_hot:
        grouped = each.repartition(tasks, "path").groupBy("path")
    else:
        hot = counts.where(is_hot).select("_key", F.ceil(F.col("count") / parts_of).alias("_parts"))
        hot = F.broadcast(hot) if is_small(n_hot, n_hot * 32) else hot
        told = F.col("_request.req_id") if "_request" in others else F.col("req_id")
        part = F.pmod(F.xxhash64(told), F.coalesce("_parts", F.lit(1)))
        dealt = each.withColumn("_key", key)
        fullest = dealt.join(hot, "_key").groupBy("_key", part.alias("_part")).count().agg(F.max("count")).first()[0]
        if fullest > _PART_REQUESTS * parts_of:
            return None
        spots, salts = ["path", "_spot"], F.least(F.coalesce("_parts", F.lit(1)), F.lit(SALTS))
        dealt = dealt.join(hot, "_key", "left").withColumn("_part", part).withColumn("_spot", F.pmod("_part", F.lit(SALTS)).cast("int"))
        grouped = dealt.repartition(tasks, *spots).groupBy(*spots, "_part")
        there = there.withColumn("_key", key).join(hot, "_key", "left").withColumn(
            "_spot", F.explode(F.sequence(F.lit(0), salts.cast("int") - 1))
        ).drop("_key", "_parts")
    asked = grouped.agg(F.collect_list(F.struct(*others)).alias("_asked"))
    met = asked.join(there.repartition(tasks, *spots), spots, how).drop("_spot", "_part")
    return met if how == "left" else met.drop("_there")


def each_request(met: DataFrame) -> DataFrame:
    """One row for each request in ``_asked``, with its columns in place of the array."""
    return met.withColumn("_each", F.explode("_asked")).drop("_asked").select("*", "_each.*").drop("_each")


def attach_requests(parsed: DataFrame, requests: DataFrame, small: bool) -> DataFrame:
    """One row per (request, file) for requests that name a path, with the columns of ``parsed``.

    ``parsed`` has one row per file. Requests measured as small are broadcast. Otherwise a path that very many
    requests name must not meet its file in one task: requests are salted by ``req_id``, and a file is repeated only
    for the salts that requests to it really use, at most ``SALTS`` of them.
    """
    if small:
        return parsed.join(F.broadcast(requests), "path")
    salted = requests.withColumn("_salt", F.pmod(F.xxhash64("req_id"), F.lit(SALTS)).cast("int"))
    used = salted.groupBy("path").agg(F.collect_set("_salt").alias("_salts"))
    copies = parsed.join(used, "path").withColumn("_salt", F.explode("_salts")).drop("_salts")
    return copies.join(salted, ["path", "_salt"]).drop("_salt")
