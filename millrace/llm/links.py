"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a group-by (with map-side partial minima) and a sort-merge join with its result. Spark doesn't split the
hot keys of a join with an aggregate, so the links of one node meet in one task, as a stream of pairs of numbers.
The number of steps grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import stash


def _settled(edges: DataFrame) -> bool:
    """Whether every larger end has one smaller end, which is nobody's larger end."""
    ends = edges.select(F.col("b").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("hub")).union(edges.select("a", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("hub").alias("hub")).where("leaf + hub > 1 and leaf > 0").agg(F.count("*")).first()[0] == 0


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").where("m <> b").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"))
    least = down.groupBy("b").agg(F.min("a").alias("m"))
    moved = down.join(least, "b").where("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y"))
    return moved.union(least.select(F.col("m").alias("x"), F.col("b").alias("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (two long columns ``a`` and ``b``); the component is the smallest id reachable.

    Links with a null end and links of an id to itself say nothing and are ignored.
    """
    edges = stash(links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct(), "links")
    while not _settled(edges):
        edges = stash(_small_star(_large_star(edges)), "links")
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())
