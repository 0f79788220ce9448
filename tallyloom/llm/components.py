"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above a node is tied to the least neighbour of that node."""
    both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select("hi", "lo"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lo"), F.least("u", "m").alias("m"))
    return edges.join(least, "lo").select("hi", F.col("m").alias("lo")).where("hi > lo").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are tied to the least of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    tied = edges.join(least, "hi").select(F.explode(F.array(F.struct("hi", "m"), F.struct(F.col("lo").alias("hi"), "m"))).alias("e"))
    return tied.select("e.hi", F.col("e.m").alias("lo")).where("hi > lo").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge that is not the least of its component.

    Edges are pairs of longs in any direction; loops and repeats are allowed, no edges give no
    rows. Stars need a number of rounds that grows with the logarithm of the longest path. Each
    round is cut to the checkpoint folder, and only a count and a checksum reach the driver. Of a
    node with very many neighbours only minima, taken before the shuffle, are needed; the join
    that spreads them has one row for each node on the small side."""
    pairs = edges.select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo"))
    now = cut(pairs.where("hi > lo").distinct())
    state = _state(now)
    while True:
        now = cut(_small_star(_large_star(now)))
        before, state = state, _state(now)
        if before == state:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
