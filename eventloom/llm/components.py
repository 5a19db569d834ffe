"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def _edge(hi: str, lo: str):
    return F.struct(F.col(hi).alias("hi"), F.col(lo).alias("lo"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    ends = links.select(F.explode(F.array(_edge("hi", "lo"), _edge("lo", "hi"))).alias("e")).select("e.*").toDF("lo", "other")
    least = ends.groupBy("lo").agg(F.min("other").alias("least"))
    return links.join(least, "lo").select("hi", F.least("lo", "least").alias("lo"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its lower neighbours are tied to the least of these."""
    least = links.groupBy("hi").agg(F.min("lo").alias("least"))
    tied = links.join(least, "hi").select(F.explode(F.array(_edge("hi", "least"), _edge("lo", "least"))).alias("e"))
    return tied.select("e.*").filter("hi <> lo").distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one lower neighbour, which has none itself, or only higher ones."""
    ends = links.select(F.explode(F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                          F.struct(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    sums = ends.select("e.*").groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.filter("up > 1 or up = 1 and down = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node with a link in (a, b) to another; a component is named by its least node.

    Neighbours are reduced to their least before any join, and every round is checkpointed.
    """
    links = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct()
    while True:
        links = cut(_small_star(_large_star(links)))
        if _are_stars(links):
            break
    stars = links.select("hi", F.col("lo").alias("component")).toDF("node", "component")
    return stars.union(stars.select("component", "component").distinct())
