"""Connected components by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014).  Each
round is two group-and-join steps over the edge table, written to shared storage;
the number of rounds grows with the logarithm of the component size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import counted, forget, stored

MAX_ROUNDS = 60


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's least neighbour."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are hung on the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (one orderable type) -> node, component (its least member).

    Only nodes of an edge appear; self-loops make a node its own component; null ends
    are left out; an empty table gives an empty result.
    """
    given = stored(edges.select("a", "b").where("a is not null and b is not null").distinct(), "cc")
    loops, links = given.where("a = b").select("a"), given.where("a <> b")
    mark = None
    before = None
    for _ in range(MAX_ROUNDS):
        links, now = counted(_small_star(_large_star(links)), "cc", n=F.count(F.lit(1)), mark=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        forget(before)
        before = links
        if mark == now:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b")).union(loops.select("a", "a"))
    return nodes.groupBy("node").agg(F.min("component").alias("component"))
