"""Connected components of an edge table by alternating large-star and small-star steps, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut

#: Nodes with more than a share of 1 / HUBS of all edge ends are joined by broadcast: there are fewer than HUBS of them.
HUBS = 400


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node that has an edge to another, with the smallest node of its component.

    Each step links nodes to the smallest neighbour they know of. Groups are only reduced to a minimum, and the minimum
    goes back to a hub's many edges by a broadcast of fewer than HUBS rows, so no task gets a hub's edges. Steps end when
    the edges no longer change. Null ends, loops and repeated edges count for nothing; no edges give no rows.
    """
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct())
    now = _state(e)
    while True:
        last = now
        # large star: every larger neighbour of u is linked to the smallest node among u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        hub = F.col("n") > max(1, 2 * now.n // HUBS)
        up = both.where("v > u")
        hubs = F.broadcast(low.where(hub).drop("n"))
        joined = up.join(hubs, "u").unionByName(up.join(hubs, "u", "left_anti").join(low.where(~hub).drop("n"), "u"))
        large = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: of a node's smaller neighbours, the smallest takes the others and the node itself
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = cut(small)
        now = _state(e)
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(e: DataFrame):
    """The number of edges and a sum of their hashes."""
    return e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
