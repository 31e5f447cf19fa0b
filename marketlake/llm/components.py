"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketlake.llm.common import stored

__all__ = ["components"]

#: Rounds after which a run that does not settle is an error; a chain of n nodes settles in about 2 log2 n.
MOST_ROUNDS = 100


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("least"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u > v")
    return moved.union(least.select("u", F.col("least").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that is not the smallest of its component; ``links``: columns a and b.

    Alternates the two star steps until the edges no longer change; what is left ties each node to the smallest that it can
    reach. Each round's edges are a written table. Links from a node to itself and repeated links do no harm.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    seen = None
    for _ in range(MOST_ROUNDS):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
        edges = stored(_small_star(_large_star(edges)))
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
