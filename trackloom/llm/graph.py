"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node and class (the class's least node) for every node of undirected ``edges`` (src, dst).

    Alternates large-star and small-star steps until only stars around least nodes are left;
    every step is written to the shared folder.  A node's neighbours are never gathered: the
    least neighbour is an aggregate, and it is joined back to the edges.  Nulls and loops are
    ignored; repeated edges count once; an empty table gives no row.
    """
    edges = edges.where("src is not null and dst is not null and src <> dst")
    edges = settle(edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("u").alias("v"), F.col("v").alias("u")).unionByName(e) if large else e
        # now u are neighbours of v: all of them, or (edges are u < v) the smaller ones
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        linked = both.join(least, "v")
        if large:
            # larger neighbours are hung on the least of the closed neighbourhood
            out = linked.where(F.col("u") > F.col("v")).select(F.col("m").alias("a"), F.col("u").alias("b"))
        else:
            out = linked.select(F.col("m").alias("a"), F.col("u").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("v").alias("b")))
        return out.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()

    def only_stars(e: DataFrame) -> bool:
        """No node hangs on two others, and none that hangs on another has nodes of its own."""
        ends = e.select(F.col("u").alias("node"), F.lit(0).alias("hangs")).unionByName(e.select(F.col("v").alias("node"), F.lit(1).alias("hangs")))
        each = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.count("*").alias("n"))
        return not each.where("hangs > 1 or hangs = 1 and n > 1").agg(F.count("*")).first()[0]

    rounds = 0
    while not only_stars(edges):
        if rounds == max_rounds:
            raise RuntimeError(f"no fixed point in {max_rounds} rounds")
        edges = settle(star(settle(star(edges, True), "large"), False), "small")
        rounds += 1
    leaves = edges.select(F.col("v").alias("node"), F.col("u").alias("class"))
    return leaves.unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("class")).distinct())
