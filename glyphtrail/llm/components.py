"""Connected components of a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges`` (a, b); a != b, in any order, repeats allowed.

    Every round is two joins on a node with its least neighbour, which is aggregated before the shuffle; edges are
    written after each, so that a lost executor costs a part of a round. The edges never grow, and shrink to stars
    in a number of rounds that is logarithmic in the component's size. One aggregation tells whether they are stars, so
    that edges which already are take no round, and no round is spent on finding that nothing changes.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.min("b").alias("m"))

    def settled(pairs: DataFrame) -> bool:
        """Whether every node has one smaller neighbour and no larger one, or larger ones only."""
        ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(pairs.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return nodes.agg(F.count(F.when((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)), 1))).first()[0] == 0

    def down(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()

    stars = materialize(down(edges), "edges")
    while not settled(stars):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = smallest(both).withColumn("m", F.least("a", "m"))
        large = materialize(down(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.filter("m < a").select("a", F.col("m").alias("b")))), "edges")
        discard(stars)
        least = smallest(large)
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = materialize(down(small.unionByName(least.select("a", F.col("m").alias("b")))), "edges")
        discard(large)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def extended(found: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (node, component) of the graph of ``found`` with ``edges`` (a, b) added: only what those join is worked on."""
    a, b = (found.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in ("a", "b"))
    between = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = materialize(components(between), "joined")
    root = joined.select(F.col("node").alias("component"), F.col("component").alias("root"))
    new = joined.join(found.select(F.col("component").alias("node")).distinct(), "node", "left_anti")
    return found.join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component")).unionByName(new.select("node", "component"))
