"""Reading the given tables and running Arrow functions over chosen columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def aside(frame: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``frame`` without columns called like ``names``: these have free names until the function gives theirs back.

    An operator that needs names of its own calls this first, so that no column of its caller is lost or ambiguous.
    """
    taken = {c.lower() for c in frame.columns} | {n.lower() for n in names}
    wanted, renamed = {n.lower() for n in names}, {}
    for column in frame.columns:
        if column.lower() in wanted:
            free = f"{column}_kept"
            while free.lower() in taken:
                free += "_"
            taken.add(free.lower())
            renamed[column] = free
    return frame.withColumnsRenamed(renamed), lambda out: out.withColumnsRenamed({v: k for k, v in renamed.items()})
