"""Exact enhancement of maps that are larger than a task: bands of height, one after the other from the top.

A feature's enhancement is an integral over heights from 0 to its value, so it can be cut at any heights. Within a band only the features whose value lies in
it are looked at one by one; a cluster of higher features enters as one node with its extent, and only if an edge of the band touches it.
So a task holds the features of one band of one map, not the map, and each edge is used once, in the band of its lower end. What clusters become
in each band is a table (node, root, share of the integral); from the lowest band up, the shares below a node's root are added to its own.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept

#: Accuracy of the quantiles that bands are cut at.
ACCURACY = 10_000


def band_tree(top: np.ndarray, extent: np.ndarray, a: np.ndarray, b: np.ndarray, height: np.ndarray, low: float, e: float, h: float):
    """(root, share, extent of the root's cluster) of each node of one band.

    top, extent: nodes as they enter, at their value or at the upper end of the band. Edges a - b join at ``height``; the band ends at ``low``.
    Edges are taken from the highest down, and clusters that meet become a new node of a tree, unless one was made at the same height.
    """
    m, power = len(top), h + 1
    up, count, at = list(range(m)), [1] * m, list(range(m))  # sets of nodes, and the tree node that each set is now
    start, size, parent = top.tolist(), extent.tolist(), [-1] * m

    def find(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    order = np.argsort(-height, kind="stable")
    for i, j, w in zip(a[order].tolist(), b[order].tolist(), height[order].tolist()):
        i, j = find(i), find(j)
        if i == j:
            continue
        if count[i] < count[j]:
            i, j = j, i
        p, q = sorted((at[i], at[j]))
        if q >= m and start[q] == w:
            parent[p], size[q] = q, size[q] + size[p]
        else:
            parent[p] = parent[q] = len(start)
            start.append(w)
            size.append(size[p] + size[q])
            parent.append(-1)
            q = len(start) - 1
        up[j], count[i], at[i] = i, count[i] + count[j], q
    share = [0.0] * len(start)
    for t in range(len(start) - 1, -1, -1):  # a parent stands behind its children
        p = parent[t]
        end, below = (low, 0.0) if p < 0 else (start[p], share[p])
        share[t] = size[t] ** e * (start[t] ** power - end**power) / power + below
    roots = [find(i) for i in range(m)]
    return np.array(roots, np.int64), np.array(share[:m]), np.array([size[at[r]] for r in roots])


def enhance_large(maps: DataFrame, by: list[str], edges: DataFrame, value: str = "x", bands: int = 8, e: float = 2 / 3, h: float = 2.0, unit: str | None = None) -> DataFrame:
    """(by, feature, tfce) of each map of (by, feature, value): as :func:`clusters.enhance`, exactly, in tasks of about 1/``bands`` of a map's features.

    edges: (src, dst), one row for each two neighbours, of any number. unit: a column with what a feature adds to its cluster's extent; 1 without.
    Positive and negative values are enhanced apart and keep their signs; null, NaN and 0 give 0. Features of equal
    value are in one band, so a map with one value is one band. Keys must not be null. Each step is a reliable checkpoint.
    """
    keys, power = [*by, "_side"], h + 1
    x = F.col(value).cast("double")
    cells = maps.select(*by, F.col("feature").cast("bigint").alias("f"), x.alias("x"), (F.col(unit).cast("double") if unit else F.lit(1.0)).alias("extent"))
    cells = cells.filter("x IS NOT NULL AND NOT isnan(x) AND x <> 0").select(*by, F.signum("x").cast("int").alias("_side"), "f", F.abs("x").alias("w"), "extent")
    parts = [i / bands for i in range(1, bands)]
    # a map's bands end at its quantiles; the last one has no upper end
    cuts = cells.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx("w", parts, ACCURACY)) if parts else F.array().cast("array<double>")).alias("cuts"))
    cuts = kept(cuts)
    band = F.size(F.filter("cuts", lambda c: c < F.col("w")))
    cells = kept(cells.join(cuts, keys).select(*keys, "f", "w", "extent", band.alias("band")))

    def end(place):
        return F.get(F.col("cuts"), place)

    one = cells.select(*keys, F.col("f").alias("u"), F.col("w").alias("wu"), F.col("band").alias("bu"))
    two = cells.select(*keys, F.col("f").alias("v"), F.col("w").alias("wv"), F.col("band").alias("bv"))
    ends = edges.select(F.col("src").cast("bigint").alias("u"), F.col("dst").cast("bigint").alias("v"))
    ends = ends.join(one, "u").join(two, [*keys, "v"]).select(*keys, "u", "v", F.least("wu", "wv").alias("w"), F.least("bu", "bv").alias("band"))
    ends = kept(ends)
    kinds = dict(cells.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", node bigint, root bigint, share double, extent double, own boolean"

    def solve(nodes: pd.DataFrame, joins: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("node")
        ids = nodes["node"].to_numpy()
        a, b = (np.searchsorted(ids, joins[c].to_numpy()) for c in ("a", "b"))
        root, share, extent = band_tree(nodes["top"].to_numpy(float), nodes["extent"].to_numpy(float), a, b, joins["w"].to_numpy(float), float(nodes["low"].iloc[0]) if len(nodes) else 0.0, e, h)
        out = nodes[[*keys, "node"]].copy()
        return out.assign(root=ids[root], share=share, extent=extent, own=nodes["own"].to_numpy())

    labels = alive = None  # of features above the band: the cluster that each is in; clusters and their extents
    steps: list[DataFrame] = []
    for k in range(bands - 1, -1, -1):
        low = F.coalesce(end(F.lit(k - 1)), F.lit(0.0)) if k else F.lit(0.0)
        limits = cuts.select(*keys, low.alias("low"), end(F.lit(k)).alias("high"))
        nodes = cells.filter(F.col("band") == k).select(*keys, F.col("f").alias("node"), F.col("w").alias("top"), "extent", F.lit(True).alias("own"))
        joins, rest = ends.filter(F.col("band") == k).select(*keys, F.col("u").alias("a"), F.col("v").alias("b"), "w"), None
        if labels is not None:
            for c in ("a", "b"):
                names = labels.withColumnsRenamed({"f": c, "comp": "_to"})
                joins = joins.join(names, [*keys, c], "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
            joins = kept(joins)
            met = joins.select(*keys, F.col("a").alias("node")).union(joins.select(*keys, "b")).distinct()
            above = alive.join(limits.select(*keys, F.col("high").alias("top")), keys)
            nodes = nodes.unionByName(above.join(met, [*keys, "node"], "left_semi").select(*nodes.columns[:-1], F.lit(False).alias("own")))
            # clusters that no edge of the band touches pass through it as they are
            through = F.pow("extent", F.lit(e)) * (F.pow("top", F.lit(power)) - F.pow("low", F.lit(power))) / power
            rest = above.join(met, [*keys, "node"], "left_anti").join(limits.select(*keys, "low"), keys)
            rest = rest.select(*keys, "node", F.col("node").alias("root"), through.alias("share"), "extent", F.lit(False).alias("own"))
        nodes = nodes.join(limits.select(*keys, "low"), keys)
        other = [f"_of_{c}" for c in keys]
        joins = joins.select(*[F.col(c).alias(o) for c, o in zip(keys, other)], "a", "b", "w")
        done = nodes.groupBy(*keys).cogroup(joins.groupBy(*other)).applyInPandas(solve, schema)
        done = kept(done if rest is None else done.unionByName(rest))
        steps.append(done)
        alive = done.filter("node = root").select(*keys, "node", "extent")
        fresh = done.filter("own").select(*keys, F.col("node").alias("f"), F.col("root").alias("comp"))
        if labels is not None:
            moved = labels.withColumnRenamed("comp", "node").join(done.select(*keys, "node", "root"), [*keys, "node"])
            fresh = fresh.unionByName(moved.select(*keys, "f", F.col("root").alias("comp")))
        labels = kept(fresh) if k else None
    below, found = None, []
    for done in reversed(steps):
        if below is not None:
            done = done.join(below, [*keys, "root"]).withColumn("share", F.col("share") + F.col("more"))
            done = kept(done)
        found.append(done.filter("own").select(*keys, F.col("node").alias("feature"), "share"))
        below = done.select(*keys, F.col("node").alias("root"), F.col("share").alias("more"))
    found = functools.reduce(DataFrame.union, found).select(*by, "feature", (F.col("share") * F.col("_side")).alias("tfce"))
    return maps.select(*by, "feature").join(found, [*by, "feature"], "left").withColumn("tfce", F.coalesce("tfce", F.lit(0.0)))
