"""Connected components over an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: A node is a hub if more than HUB of the edges, and more than the HUB_SHARE-th part of them, meet in it.
HUB, HUB_SHARE = 500, 10_000


def _with_least(edges: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """(u, v, m): ``least`` (u, m, n) joined to the edges of each u, which has n of them.

    The edges of hubs stay where they are and meet a broadcast table of hubs: there are at most 2 * HUB_SHARE, as
    every one takes a HUB_SHARE-th part of the ends of edges. So no task of the shuffle gets more than ``hub`` rows of one node.
    """
    hubs = least.filter(F.col("n") > hub)
    hot = edges.join(F.broadcast(hubs.select("u", "m")), "u")
    cold = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.filter(F.col("n") <= hub).select("u", "m"), "u")
    return hot.select("u", "v", "m").union(cold.select("u", "v", "m"))


def _large_star(edges: DataFrame, hub: int) -> DataFrame:
    """Link each node's larger neighbours to the least of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    out = _with_least(both, least, hub).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def _small_star(edges: DataFrame, hub: int) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them; every edge has u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    out = _with_least(edges, least, hub).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
    return out.filter("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node that has a smaller neighbour has only that one, and it has no smaller one itself: then edges are
    node and component, as either step would leave them."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str, most_rounds: int = 60) -> DataFrame:
    """(u, v) of bigint edges -> (node, comp): each node that has an edge, and the least node it reaches.

    Self edges and repeated edges are ignored; an empty table gives an empty table. Each step is written to
    the shared folder, so a lost executor costs one step at most. Stops once all edges lead to a least node.
    """
    now = scratch.write(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    for i in range(1, most_rounds):
        if _settled(now):
            break
        hub = max(HUB, now.count() // HUB_SHARE)
        wide = scratch.write(_large_star(now, hub), f"{name}-{i}-large")
        now = scratch.write(_small_star(wide, max(HUB, wide.count() // HUB_SHARE)), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}", f"{name}-{i}-large")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots)
