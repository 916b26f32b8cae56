"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexigrove.llm.shared import narrow, written


def _stars(edges: DataFrame) -> bool:
    """Whether each edge (u, v) leads straight to the smallest id: no u has a second edge, at either end."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down")))
    several = ends.groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("n")).filter("down > 0 and n > 1")
    return not several.agg(F.count("*").alias("n")).first()["n"]


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Smallest reachable id of each node that reaches a smaller one: (node, component).

    ``known``: the result for earlier links, which then need not be given again.

    Large-star and small-star in turns: every node links its larger neighbours,
    then its smaller ones, to the smallest id it knows. Each round is a few
    aggregations and joins by node; the number of rounds grows with the
    logarithm of the size, not with the length of chains. The rounds end as
    soon as all edges are stars around the smallest ids.
    """
    edges = links.toDF("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if known is not None:
        edges = edges.unionByName(known.toDF("u", "v"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        # The node itself is linked in the row of its smallest neighbour.
        small = large.join(smallest, "u").select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        edges = written(narrow(small.distinct()), "links")
        if _stars(edges):
            return edges.toDF("node", "component")
