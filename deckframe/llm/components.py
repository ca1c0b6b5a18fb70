"""Connected components of an edge table by alternating large and small stars.

Each round joins the edges with the smallest neighbour of each node, a partial
aggregate, and writes the new edges to the shared folder. Nothing is collected but
a count and a checksum. The edges never grow beyond those given, and a round brings
every node at least halfway to the smallest node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckframe.plans import stored

MAX_ROUNDS = 60


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(near: DataFrame, large: bool) -> DataFrame:
    """Link what stands next to each u of ``near`` (u, v) with the smallest of them and u."""
    # written, so that the join is broadcast if small, and else deals both sides anew and may split the node of many links
    least = stored(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "smallest-neighbours")
    met = near.join(least, "u")
    if large:
        return met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v"))


def components(edges: DataFrame) -> DataFrame:
    """Of links (u, v) between longs: node, root; every node that has a link, with the smallest of its component."""
    down = stored(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        state = down.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not state["n"] or (state["n"], state["s"]) == seen:
            break
        seen = (state["n"], state["s"])
        large = _star(_both(down), True)
        down = stored(_star(large, False).distinct(), "links")
    else:
        raise RuntimeError(f"components: not done in {MAX_ROUNDS} rounds")
    return down.select(F.col("u").alias("node"), F.col("v").alias("root")).union(down.select("v", "v").distinct())
