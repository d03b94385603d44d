"""The corpus table: one row per file, classified by kind and decoded to text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.routing import file_kind, file_name, language_id, suffix
from ..functions.text import normalize_newlines

# Directories left out of a word search, and of a semantic index. Dot directories are left out of both.
SEARCH_SKIP_DIRS = ("node_modules", "__pycache__", "tests", "notebooks")
INDEX_SKIP_DIRS = ("node_modules", "__pycache__", ".git", ".venv", "venv", "dist", "build")

# What a task should read and parse at once, and the partitions of one group of paths.
TASK_BYTES = 32 << 20
_SLOTS = 16

_REPLACEMENT = chr(0xFFFD)
# Stands in for replacement characters the file really contains while broken bytes are being removed.
_KEEP = chr(0xFDD0) + chr(0xFDD1) + chr(0xFDD0)


def classify_files(files: DataFrame, kind: Column | None = None) -> DataFrame:
    """Add ``name``, ``ext``, ``kind`` (null when unsupported) and ``language`` from ``path``; a pure projection."""
    path = F.col("path")
    kind = file_kind(path) if kind is None else kind
    return files.withColumns({"name": file_name(path), "ext": suffix(path), "kind": kind, "language": language_id(path)})


def decode_text(files: DataFrame, mode: str = "strict") -> DataFrame:
    """Replace binary ``content`` by ``text`` and ``status``.

    ``strict`` gives null text and status ``decode_error`` for bytes that are not UTF-8; ``ignore`` drops those bytes.
    Line ends come out as ``\\n``. The binary column is dropped here so that no later stage carries it.
    """
    raw = F.col("content").cast("string")
    valid = F.is_valid_utf8(raw)
    if mode == "strict":
        text = F.when(valid, raw)
        status = F.when(F.col("content").isNull(), "unreadable").when(valid, "ok").otherwise("decode_error")
    elif mode == "ignore":
        repaired = F.make_valid_utf8(F.replace(raw, F.lit(_REPLACEMENT), F.lit(_KEEP)))
        dropped = F.replace(F.replace(repaired, F.lit(_REPLACEMENT), F.lit("")), F.lit(_KEEP), F.lit(_REPLACEMENT))
        text = F.when(valid, raw).otherwise(dropped)
        status = F.when(F.col("content").isNull(), "unreadable").otherwise("ok")
    else:
        raise ValueError(f"mode must be 'strict' or 'ignore', not {mode!r}")
    return files.withColumns({"text": normalize_newlines(text), "status": status}).drop("content")


def outside_dirs(path: Column, root: str, skip_dirs: Iterable[str], skip_hidden: bool = True) -> Column:
    """True unless a directory between ``root`` and the file is skipped. File names are never tested."""
    below = F.substring(path, len(root.rstrip("/")) + 2, 1 << 30) if root else path
    parts = F.split(below, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    skipped = list(skip_dirs)
    return ~F.exists(
        dirs, lambda d: (d.isin(skipped) | d.startswith(".")) if skip_hidden else d.isin(skipped)
    )


def prune_files(
    files: DataFrame, root: str = "", skip_dirs: Iterable[str] = SEARCH_SKIP_DIRS, skip_hidden: bool = True
) -> DataFrame:
    """Keep files below ``root`` that are in no skipped directory; filters on ``path`` reach the parquet scan."""
    kept = files if not root else files.where(F.col("path").startswith(root.rstrip("/") + "/"))
    return kept.where(outside_dirs(F.col("path"), root, skip_dirs, skip_hidden))


def read_corpus(spark: SparkSession, location: str, root: str = "", **prune) -> DataFrame:
    """A corpus table from parquet, pruned and classified.

    A stored ``kind`` is kept, so that a filter on it skips the other partitions; else it is found from ``path``.
    """
    files = prune_files(spark.read.parquet(location), root, **prune)
    if "kind" not in files.columns:
        return classify_files(files)
    kind = F.col("kind")
    return classify_files(files, F.when(kind != "other", kind))


def write_corpus(
    files: DataFrame, location: str, partitions: int | None = None, max_records_per_file: int = 0
) -> None:
    """Store a corpus so that later work reads little of it.

    Partitioned by ``kind`` (views of one kind skip the others) and range-clustered by path, so that the min/max of
    ``path`` in each row group lets a lookup of a few files skip nearly all text. ``partitions`` is the number of sort
    tasks: the size of the corpus divided by what one task should sort (else ``spark.sql.shuffle.partitions``).
    """
    order = [F.col("kind"), F.col("path")]
    kinds = files.withColumn("kind", F.coalesce("kind", F.lit("other")))
    ranged = kinds.repartitionByRange(partitions, *order) if partitions else kinds.repartitionByRange(*order)
    (
        ranged.sortWithinPartitions("kind", "path")
        .write.mode("errorifexists")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy("kind")
        .parquet(location)
    )


def pack(sized: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``sized(path, size, …)`` dealt into partitions of about ``task_bytes`` each, by the sizes of the files.

    Paths are dealt into groups by hash; in each group a running sum over sizes, largest first, cuts the partitions, so a
    file that is larger than one stands alone and small ones fill up the rest. Only these rows are shuffled, not contents.
    The row and byte count that fixes the numbers is one aggregate.
    """
    total = sized.agg(F.coalesce(F.sum(F.greatest("size", F.lit(1))), F.lit(0))).first()[0]
    groups = max(1, -(-total // (task_bytes * _SLOTS // 2)))
    group = F.pmod(F.xxhash64("path"), F.lit(groups))
    size = F.greatest("size", F.lit(1))
    before = F.sum(size).over(
        Window.partitionBy("_group").orderBy(F.desc("size"), "path").rowsBetween(Window.unboundedPreceding, -1)
    )
    slot = F.floor(F.coalesce(before, F.lit(0)) / task_bytes) % _SLOTS
    placed = sized.withColumn("_group", group).withColumn("_slot", slot)
    return placed.repartitionById(int(groups * _SLOTS), (F.col("_group") * _SLOTS + F.col("_slot")).cast("int")).drop("_group", "_slot")


def spread(files: DataFrame) -> DataFrame:
    """Give a plain scan at least one partition per core.

    A table of few, large row groups cannot be split by the reader and would leave cores idle. On a large table the
    scan already has more splits than cores and the frame is returned as it is, with no shuffle.
    """
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files if files.rdd.getNumPartitions() >= cores else files.repartition(cores)
