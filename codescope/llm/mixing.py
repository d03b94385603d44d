"""Mixing sources to target weights by capped water-filling, with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codescope.plans.joins import fits_broadcast
from codescope.plans.lineage import stored

from .tables import aside

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = 7
#: Each source is parted by the leading hash digits of its documents into this many slices.
SLICE_DIGITS = 3
#: Parts of the sorted list of sources; only their row counts meet in one task.
RANK_PARTS = 64


def words(text: Column | str) -> Column:
    """The number of runs of characters other than white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_ranks(sources: DataFrame) -> DataFrame:
    """``sources`` (one row each) with ``rank``, from zero, by code point with null last.

    Sorted by ranges; ranks are counted inside each range, and only the ranges' row counts are summed in one task.
    """
    order = [F.col("source").isNull(), F.col("source")]
    parts = sources.repartitionByRange(RANK_PARTS, *order).withColumn("_part", F.spark_partition_id())
    parts = stored(parts)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(starts, "_part").withColumn("rank", F.col("_start") + inside - 1).drop("_part", "_start")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, target)`` for ``sizes(source, source_size)``, one row each.

    Sources share the sum of all sizes by weight, ``weights`` being repeated over the sources by code point, null
    last. A source that would get more than ``max_epochs`` times its size is clamped there, and what it leaves goes
    to the others by weight, again and again until no source is above. One round is one aggregate of one row per
    source; each clamps at least one more source, and all rounds together seldom number more than a few.
    """
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stored(
        source_ranks(sizes).select(
            "source", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).cast("double").alias("cap")
        )
    )
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, clamped = 0.0, -1
    while True:
        full = F.col("cap") < F.col("weight") * level
        n, held, free = ranked.agg(
            F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == clamped or not free:
            break
        clamped, level = n, (total - held) / free
    target = F.least(F.col("cap"), F.col("weight") * level)
    return ranked.select("source", "source_size", target.alias("target"))


def _with_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Inner join of ``rows`` (as ``a``) with one row per source (as ``b``).

    That is broadcast when measured as small; else both are shuffled by source and the first digit of the document's
    hash, so a source that holds a third of all rows is spread.
    """
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    if fits_broadcast(per_source):
        return rows.alias("a").join(F.broadcast(per_source).alias("b"), same)
    digits = F.array(*[F.lit(f"{i:x}") for i in range(16)])
    copies = per_source.withColumn("_digit", F.explode(digits))
    return rows.alias("a").join(copies.alias("b"), same & (F.substring("a._order", 1, 1) == F.col("b._digit")))


def mixed(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    size: Column | None = None,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``repeats``, how often the mix takes the document.

    ``size`` is the number of words of ``text`` if no other non-negative long is given.

    A source whose target is ``w + f`` times its size takes every document ``w`` times, and once more those that
    come first in a seeded order until the share ``f`` of its size is reached, so it misses its target by half a
    document at most (more only where a row is repeated). The order is by MD5 of seed and ``doc_id``, so runs agree. Sizes are summed by source and slice of
    that order before they are shuffled; only documents of the one slice in which a source's share ends are sorted,
    so a source with any part of all rows is spread over tasks.

    Null sources are one source, null texts have size zero and are taken like others, null ids are ordered as empty
    and rows with the same ``doc_id`` follow in order of size. An empty table gives an empty result. Columns named
    like the new ones are replaced.
    """
    new = ["size", "source_size", "target", "repeats"]
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    docs, given_back = aside(docs, ["_order", "_slice", "_whole", "_end", "_last"])
    columns = [c for c in docs.columns if c not in new]
    sized = docs.withColumn("size", words("text") if size is None else size).withColumn("_order", order)
    sized = sized.withColumn("_slice", F.substring("_order", 1, SLICE_DIGITS))
    brief = stored(sized.select("source", "_slice", "_order", "size"))
    slices = stored(brief.groupBy("source", "_slice").agg(F.sum("size").alias("sum")))
    goals = targets(slices.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = stored(goals.select(
        "source", "source_size", "target", F.floor(ratio).alias("_whole"),
        (F.col("target") - F.floor(ratio) * F.col("source_size")).alias("_rest"),
    ))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    running = Window.partitionBy("source").orderBy("_slice")
    upto = slices.withColumn("_upto", F.sum("sum").over(running))
    ends = upto.alias("a").join(goals.alias("b"), same).where("_rest > 0 and _upto > _rest and _upto - sum <= _rest").select(
        "a.source", F.col("_slice").alias("_end"), (F.col("_rest") - F.col("_upto") + F.col("sum")).alias("_left")
    )
    inner = Window.partitionBy("source").orderBy("_order", "size")  # repeated rows are taken together
    ends = stored(ends)
    last = _with_source(brief, ends).where("_slice = _end").select("a.source", "_order", "size", "_end", "_left")
    taken = last.withColumn("_to", F.sum("size").over(inner)).where("_to - size / 2 <= _left").groupBy("source", "_end").agg(
        F.max(F.struct("_order", "size")).alias("_last")
    )
    cuts = goals.alias("a").join(
        ends.alias("b").join(taken.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")), "left").select(
            "b.source", "b._end", "_last"), same, "left"
    ).select("a.source", "source_size", "target", "_whole", "_end", "_last")
    before = F.col("_slice") < F.col("_end")
    at = (F.col("_slice") == F.col("_end")) & (F.struct("_order", "size") <= F.col("_last"))
    joined = _with_source(sized, stored(cuts))
    kept = [F.col(f"a.`{c}`") for c in [*columns, "size"]]
    return given_back(joined.select(
        *kept, "b.source_size", "b.target", (F.col("_whole") + F.coalesce(before | at, F.lit(False)).cast("int")).alias("repeats")
    ))
