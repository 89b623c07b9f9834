"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.llm.common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: connect each node's neighbours to its smallest one.

    large: the larger neighbours of every node; small: the smaller ones and the node itself.
    The minimum is an aggregate joined back, so that a node with very many links can be split.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    out = both.join(low, "u")
    if large:
        out = out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether edges (a, b), a > b, are stars around their smallest nodes."""
    several = edges.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select("a").limit(1)
    inner = edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi").limit(1)
    return not several.union(inner).take(1)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is the smallest node that can be reached."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _settled(now):
        now = stored(_stars(_stars(now, True), False))
    nodes = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
