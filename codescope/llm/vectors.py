"""Vector columns: which rows can take part, and their matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column | str) -> Column:
    """A vector that is not null and whose components are all there and finite; an empty one is not usable."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def dimension(rows: DataFrame, vector: str = "vector") -> int:
    """Components of the longest vector; shorter ones count as continued by zeros."""
    return int(rows.agg(F.coalesce(F.max(F.size(vector)), F.lit(0))).first()[0])


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """The vectors of a list column as rows of ``size`` doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    if (lengths == size).all():
        return values.reshape(len(column), size)
    found = np.zeros((len(column), size))
    found[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return found


def distinct_rows(rows: DataFrame, most: int, *more: str) -> DataFrame:
    """At most the ``most`` smallest ``vec_id`` of rows that share ``vector`` and the columns ``more``; ``first`` marks one
    row of each id among them.

    Rows of equal vectors score alike against anything, so no list of fewer than ``most`` results can name more of
    them; a group of copies of any size shrinks before it is shuffled.
    """
    from pyspark.sql.window import Window

    order = Window.partitionBy("vector", *more).orderBy("vec_id")
    numbered = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).drop("nth")
    before = F.lag("vec_id").over(order)
    return numbered.withColumn("first", before.isNull() | (before != F.col("vec_id")))


def shared(rows: DataFrame, asks: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``share``: ``rows`` of a ``key`` are repeated once for every ``most`` ``asks`` of that key, and
    these are dealt over the copies by ``uid``. Rows that nothing asks for go."""
    from codescope.plans.joins import fits_broadcast
    from codescope.plans.lineage import stored

    shares = stored(asks.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("shares")))
    shares = F.broadcast(shares) if fits_broadcast(shares) else shares
    repeated = rows.join(shares, key).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    dealt = asks.join(shares, key).withColumn("share", F.pmod(F.xxhash64("uid"), F.col("shares")).cast("int")).drop("shares")
    return repeated, dealt
