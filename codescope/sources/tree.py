"""Read a directory tree that every executor can see (a shared mount) as a corpus table."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from ..functions.routing import file_kind
from .corpus import SEARCH_SKIP_DIRS, TASK_BYTES, classify_files, decode_text, pack

_READ_BATCH_BYTES = 16 << 20
_CONTENT_SCHEMA = "path string, content binary"


class _Subtrees(InputPartition):
    """(directory, whether all below it belongs to it) for each part of one task."""

    def __init__(self, parts: list[tuple[str, bool]]) -> None:
        super().__init__(tuple(parts))
        self.parts = parts


class _TreeReader(DataSourceReader):
    """Splits the tree into subtrees on the driver, at most ``splits`` tasks' worth; each is walked by a task.

    A filter on the beginning of ``path`` is taken over: directories outside it are not listed.
    """

    def __init__(self, root: str, skip: set[str], skip_hidden: bool, splits: int) -> None:
        self.root, self.skip, self.skip_hidden, self.splits = root, skip, skip_hidden, splits
        self.prefixes: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for each in filters:
            if isinstance(each, StringStartsWith) and each.attribute == ("path",):
                self.prefixes.append(each.value)
            elif isinstance(each, EqualTo) and each.attribute == ("path",) and isinstance(each.value, str):
                self.prefixes.append(each.value)
            yield each  # files are still told apart by the filter itself

    def _keep(self, parent: str, name: str) -> bool:
        if name in self.skip or (self.skip_hidden and name.startswith(".")):
            return False
        below = os.path.join(parent, name) + "/"
        return all(below.startswith(prefix) or prefix.startswith(below) for prefix in self.prefixes)

    def _subdirs(self, directory: str) -> list[str]:
        with os.scandir(directory) as entries:
            return sorted(e.path for e in entries if e.is_dir(follow_symlinks=False) and self._keep(directory, e.name))

    def partitions(self) -> list[InputPartition]:
        # Only directory names of the upper levels are listed here, never files.
        opened: list[tuple[str, bool]] = []
        frontier = [self.root]
        while frontier and len(frontier) < self.splits:
            below = [d for directory in frontier for d in self._subdirs(directory)]
            opened += [(d, False) for d in frontier]
            frontier = below
        parts = [(d, True) for d in frontier] + opened
        return [_Subtrees(parts[i :: self.splits]) for i in range(min(self.splits, len(parts)))]

    def read(self, partition: _Subtrees) -> Iterator[tuple[str, int]]:
        def failed(problem: OSError) -> None:
            raise problem  # a directory that cannot be listed must not vanish with all below it

        for top, recurse in partition.parts:
            for directory, dirs, names in os.walk(top, onerror=failed):
                dirs[:] = [d for d in dirs if self._keep(directory, d)] if recurse else []
                for name in names:
                    path = os.path.join(directory, name)
                    try:
                        size = os.stat(path).st_size
                    except OSError:
                        size = 0
                    yield (path, size)


class SourceTree(DataSource):
    """``spark.read.format("source_tree").load(root)``: paths and sizes of all files that are in no skipped directory.

    Unlike the built-in file sources it returns names that start with ``_`` or ``.`` (``__init__.py``, ``.env``).
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, size long"

    def reader(self, schema) -> DataSourceReader:
        skip = set(filter(None, self.options.get("skipDirs", "").split("/")))
        return _TreeReader(
            self.options["path"],
            skip,
            self.options.get("skipHiddenDirs", "true").lower() == "true",
            int(self.options.get("splits", "64")),
        )


def _read_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read the named files, a bounded number of bytes per Arrow batch; the content of a file that cannot be read is null."""
    paths: list[str] = []
    contents: list[bytes | None] = []
    held = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"]
        )

    for listed in batches:
        for path in listed.column(0).to_pylist():
            try:
                with open(path, "rb") as handle:
                    data = handle.read()
            except OSError:
                data = None
            paths.append(path)
            contents.append(data)
            held += len(data or b"")
            if held >= _READ_BATCH_BYTES:
                yield batch()
                paths, contents, held = [], [], 0
    if paths:
        yield batch()


def list_source_tree(
    spark: SparkSession,
    root: str,
    skip_dirs: Iterable[str] = SEARCH_SKIP_DIRS,
    skip_hidden_dirs: bool = True,
    num_partitions: int | None = None,
    below: str | None = None,
) -> DataFrame:
    """(path, size) of all files below ``root``; a missing root raises ``FileNotFoundError``.

    ``below`` is the beginning of the paths that are wanted: what lies outside is not listed.
    """
    if not os.path.isdir(root):
        raise FileNotFoundError(f"Directory not found: {root}")
    spark.dataSource.register(SourceTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    wanted = num_partitions or spark.sparkContext.defaultParallelism * 4
    paths = (
        spark.read.format("source_tree")
        .option("skipDirs", "/".join(skip_dirs))
        .option("skipHiddenDirs", str(skip_hidden_dirs).lower())
        .option("splits", str(wanted))
        .load(root)
    )
    return paths if below is None else paths.where(F.col("path").startswith(below))


def scan_source_tree(
    spark: SparkSession,
    root: str,
    skip_dirs: Iterable[str] = SEARCH_SKIP_DIRS,
    skip_hidden_dirs: bool = True,
    mode: str = "strict",
    num_partitions: int | None = None,
    below: str | None = None,
    kinds: Iterable[str] | None = None,
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """All files below ``root`` as a corpus table; a missing root raises ``FileNotFoundError``.

    ``mode`` is that of ``decode_text``: with ``strict`` undecodable files have null text and say so in ``status``; give
    ``ignore`` to search such files as well. A file that cannot be read is a row with status ``unreadable``; a directory
    that cannot be listed raises. ``below`` names the beginning of the wanted paths and ``kinds`` the kinds: other
    directories are not listed, other files not read.

    Listing and reading are separate: listing yields paths and sizes, these are packed into tasks of about
    ``task_bytes`` (a shuffle of paths, not of contents), and then the bytes are read where they will be parsed. A flat,
    lopsided or uneven tree therefore still reads in parallel.
    """
    paths = list_source_tree(spark, root, skip_dirs, skip_hidden_dirs, num_partitions, below)
    if kinds is not None:
        paths = paths.where(file_kind(F.col("path")).isin(*kinds))
    contents = pack(paths, task_bytes).select("path").mapInArrow(_read_contents, _CONTENT_SCHEMA)
    return classify_files(decode_text(contents, mode))
