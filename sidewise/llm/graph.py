"""Connected components of a table of links, without leaving the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def _toward_least(edges: DataFrame) -> DataFrame:
    """Distinct (u, v) with u > v and a sum that tells whether they changed."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: the smallest node that can be reached. Nodes without a link don't
    appear; an empty table gives an empty one.

    Large and small stars in turn: every node passes its least neighbour on to the others, so
    chains shorten by a factor each time. A hub's neighbours meet only as partial minima, and
    Spark can split its part of a join.
    """
    edges = stored(_toward_least(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen, before = mark(edges), edges
    if not seen[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = _toward_least(large)
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(_toward_least(small.union(least)), "edges")
        release(before)
        edges = before = new
        now = mark(edges)
        if now == seen:
            break
        seen = now
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
