"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescope.plans.lineage import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, root)`` for every node of ``links``: ``root`` is the smallest node it is connected with.

    Alternates the two star operations of Kiveris et al. (2014): each node hands its larger, then its smaller
    neighbours to the smallest one it knows. Every round is an aggregate that is combined before its shuffle and an
    equi-join that splits hot nodes at run time, and its edges are written to the shared folder, so the lineage stays
    short. Ends when a round changes nothing. Links may repeat and may lead from a node to itself; rows with a null
    end are ignored. An empty table has no nodes.
    """
    edges = stored(
        links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull())
        .distinct()
    )
    nodes = edges
    state = None
    while (now := _state(edges)) != state:
        state = now
        for large in (True, False):
            pairs = edges.select("u", "v")
            if large:
                pairs = pairs.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            met = pairs.join(least, "u")
            if large:  # larger neighbours of u, and u itself, point to the smallest
                edges = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                edges = edges.union(least.select("u", F.col("m").alias("v")))
            else:
                edges = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
                edges = edges.union(least.select("u", F.col("m").alias("v")))
            edges = edges.where("u != v").distinct()
            if not large:
                edges = stored(edges)
    ends = nodes.select(F.col("u").alias("node")).union(nodes.select(F.col("v").alias("node"))).distinct()
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return ends.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
