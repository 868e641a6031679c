"""Connected components of a graph of links, by the smallest id reachable.

Alternating large-star and small-star steps (Kiveris and others, 2014), each written to the shared
folder, until the links form stars. A step's groups are only aggregated, never collected, and links
pointing to one node are as many as its members, so the work of a step grows with the links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import store


def _unfinished(edges: DataFrame) -> bool:
    """Whether a node points to several others, or to one that points on."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return not ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 OR out * into > 0").isEmpty()


def components(links: DataFrame, scratch: store.Scratch, name: str = "cc") -> DataFrame:
    """links: columns a, b (null-free). Returns node, root for every node that has a link to another; root is the least.

    The result reads a table of the scratch folder. Steps double the reach, so a graph that does not end in 200 is an error.
    """
    edges = scratch.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), f"{name}0")
    for k in range(200):
        if not _unfinished(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = scratch.table(large, f"{name}{k}a")
        scratch.remove(f"{name}{k}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = scratch.table(small.filter("u > v").distinct(), f"{name}{k + 1}")
        scratch.remove(f"{name}{k}a")
    raise RuntimeError("the components did not settle")
