"""Connected components of a list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.session import stage


def _lowest(edges: DataFrame) -> DataFrame:
    """Written, so that the join behind it can split a hot node."""
    return stage(edges.groupBy("u").agg(F.min("v").alias("low")), "lowest")


def _settled(edges: DataFrame) -> bool:
    """Every node has one smaller neighbour, and that one has none."""
    several = edges.groupBy("u").count().filter("count > 1")
    between = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return not several.head(1) and not between.head(1)


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, root): the smallest node each linked node can reach;
    nodes that are the smallest themselves have no row.

    Alternates two steps, each of them an aggregate and a join: every node hands its larger
    neighbours, then its smaller ones, to the smallest of them, until only stars are left. The
    number of rounds grows with the logarithm of the longest path. Each round is written to
    the shared folder; the driver only learns whether it was the last.
    """
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    edges = stage(
        links.filter("a <> b").select(larger.alias("u"), smaller.alias("v")).distinct(), "links"
    )
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        outward = stage(
            both.filter("v > u")
            .join(_lowest(both), "u")
            .select(F.col("v").alias("u"), F.least("low", "u").alias("v"))
            .distinct(),
            "outward",
        )
        inward = outward.join(_lowest(outward), "u")
        handed = inward.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        own = inward.select("u", F.col("low").alias("v"))
        edges = stage(handed.unionByName(own).distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
