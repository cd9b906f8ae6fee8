"""Clusters and threshold-free cluster enhancement over feature graphs; a map is one group, never split by feature."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid_edges(spark: SparkSession, shape: tuple[int, ...]) -> DataFrame:
    """(src, dst), src < dst: neighbours on a lattice, differing by one step in exactly one dimension."""
    n = int(np.prod(shape))
    nodes = spark.range(n).select(F.col("id").cast("int").alias("src"))
    out, stride = None, 1
    for size in reversed(shape):
        one = nodes.filter((F.floor(F.col("src") / stride) % size) < size - 1).select("src", (F.col("src") + stride).cast("int").alias("dst"))
        out, stride = one if out is None else out.union(one), stride * size
    return out


def product_edges(dims: list[DataFrame], sizes: list[int]) -> DataFrame:
    """(src, dst) of a lattice whose dimensions each have their own edges (src, dst) instead of steps of one."""
    out, spark = None, dims[0].sparkSession
    for i, (edges, size) in enumerate(zip(dims, sizes)):
        inner = int(np.prod(sizes[i + 1 :])) if i + 1 < len(sizes) else 1
        outer = int(np.prod(sizes[:i])) if i else 1
        rest = spark.range(outer).toDF("o").crossJoin(spark.range(inner).toDF("i"))
        base = F.col("o") * size * inner + F.col("i")
        one = rest.crossJoin(F.broadcast(edges)).select((base + F.col("src") * inner).cast("int").alias("src"), (base + F.col("dst") * inner).cast("int").alias("dst"))
        out = one if out is None else out.union(one)
    return out


def path_edges(spark: SparkSession, n: int, both_ways: bool = False) -> DataFrame:
    """(src, dst): neighbours on a line."""
    e = spark.range(n - 1).select(F.col("id").cast("int").alias("src"), (F.col("id") + 1).cast("int").alias("dst"))
    return e.union(e.select("dst", "src")) if both_ways else e


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (feature)."""
    one = edges.join(nodes.select(F.col("feature").alias("src")), "src", "left_semi")
    return one.join(nodes.select(F.col("feature").alias("dst")), "dst", "left_semi").select("src", "dst")


def triangulation_edges(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Edges (i < j) of the Delaunay triangulation of points, by inserting them one at a time (for sensor layouts)."""
    pts = np.column_stack([x, y]).astype(float)
    n = len(pts)
    span = max(np.ptp(pts[:, 0]), np.ptp(pts[:, 1]), 1e-9) * 1e4
    mid = pts.mean(0)
    pts = np.vstack([pts, mid + [-span, -span], mid + [span, -span], mid + [0, span]])

    def circle(t):
        a, b, c = pts[list(t)]
        d = 2 * ((b - a)[0] * (c - a)[1] - (b - a)[1] * (c - a)[0])
        if d == 0:
            return a, np.inf
        u = np.array([(c - a)[1] * ((b - a) @ (b - a)) - (b - a)[1] * ((c - a) @ (c - a)), (b - a)[0] * ((c - a) @ (c - a)) - (c - a)[0] * ((b - a) @ (b - a))]) / d
        return a + u, float(u @ u)

    triangles = {(n, n + 1, n + 2): circle((n, n + 1, n + 2))}
    for i in range(n):
        bad = [t for t, (c, r) in triangles.items() if (pts[i] - c) @ (pts[i] - c) < r * (1 - 1e-12)]
        edges: dict = {}
        for t in bad:
            del triangles[t]
            for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                edges[tuple(sorted(e))] = edges.get(tuple(sorted(e)), 0) + 1
        for e, k in edges.items():
            if k == 1:
                triangles[(*e, i)] = circle((*e, i))
    return sorted({tuple(sorted(e)) for t in triangles for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])) if max(e) < n})


class Graph:
    """Neighbour lists of a feature graph, small enough to go to every task (one entry for each edge end)."""

    def __init__(self, edges: list[tuple[int, int]], n: int):
        self.n = n
        self.near: list[list[int]] = [[] for _ in range(n)]
        for a, b in edges:
            self.near[a].append(b)
            self.near[b].append(a)

    @classmethod
    def grid(cls, shape: tuple[int, ...]) -> Graph:
        index = np.arange(int(np.prod(shape))).reshape(shape)
        edges = []
        for axis in range(len(shape)):
            a, b = np.take(index, range(shape[axis] - 1), axis), np.take(index, range(1, shape[axis]), axis)
            edges += list(zip(a.ravel().tolist(), b.ravel().tolist()))
        return cls(edges, index.size)

    @classmethod
    def of(cls, edges: DataFrame, n: int, most: int = 10_000_000) -> Graph:
        rows = edges.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"a feature graph of more than {most} edges")
        return cls([(r["src"], r["dst"]) for r in rows], n)

    def label(self, member: np.ndarray) -> np.ndarray:
        """The least node of each member's connected component; -1 outside."""
        out = np.full(self.n, -1)
        for i in np.nonzero(member)[0].tolist():
            if out[i] < 0:
                out[i], todo = i, [i]
                while todo:
                    for j in self.near[todo.pop()]:
                        if member[j] and out[j] < 0:
                            out[j] = i
                            todo.append(j)
        return out


def passing(x: np.ndarray, threshold: float, tail: int) -> np.ndarray:
    if tail not in (-1, 0, 1):
        raise ValueError("tail is -1, 0 or 1")
    return x <= threshold if tail == -1 else x >= threshold if tail == 1 else np.abs(x) >= threshold


def exact_positive(x: np.ndarray, graph: Graph, e: float, h: float, unit: float | np.ndarray = 1.0) -> np.ndarray:
    """Exact enhancement of the positive part: the integral of extent^e * height^h under each feature.

    unit: what a feature adds to its cluster's extent, such as the volume of a voxel or the area around a vertex; one number or one a feature.

    Features enter from the highest down; a cluster's integral grows only while its extent stays the same, and
    features keep their difference from their cluster's sum, so joining two clusters costs one step.
    """
    n, power = graph.n, h + 1
    up = np.arange(n)
    extra, total, level, size = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    unit = np.broadcast_to(np.asarray(unit, float), n)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    def settle(r, height):
        total[r] += size[r] ** e * (level[r] ** power - height**power) / power
        level[r] = height

    order = [i for i in np.argsort(-x, kind="stable").tolist() if x[i] > 0]
    entered = np.zeros(n, bool)
    for i in order:
        entered[i], size[i], level[i] = True, unit[i], x[i]
        for j in graph.near[i]:
            if entered[j]:
                a, b = root(i), root(j)
                if a != b:
                    settle(a, x[i])
                    settle(b, x[i])
                    if size[a] > size[b]:
                        a, b = b, a
                    up[a], extra[a] = b, total[a] - total[b]
                    size[b] += size[a]
    out = np.zeros(n)
    for i in order:
        if up[i] == i:
            settle(i, 0.0)
    for i in order:
        s, j = 0.0, i
        while up[j] != j:
            s, j = s + extra[j], up[j]
        out[i] = s + total[j]
    return out


def exact_enhancement(x: np.ndarray, graph: Graph, e: float = 2 / 3, h: float = 2.0, unit: float | np.ndarray = 1.0) -> np.ndarray:
    """Positive and negative values are enhanced apart, and keep their signs; NaN counts as 0."""
    x = np.nan_to_num(np.asarray(x, float))
    return exact_positive(x, graph, e, h, unit) - exact_positive(-x, graph, e, h, unit)


def stepped_enhancement(x: np.ndarray, graph: Graph, dt: float = 0.1, e: float = 2 / 3, h: float = 2.0, tail: int = 0, unit: float | np.ndarray = 1.0) -> np.ndarray:
    """Sum over thresholds dt apart of sign * extent^e * |threshold|^h * dt; tail 0 takes |x| and joins both signs."""
    x = np.asarray(x, float)
    out, side = np.zeros(graph.n), np.abs(x) if tail == 0 else x
    some = side[side > 0] if tail >= 0 else side[side < 0]
    if not len(some):
        return out
    grid = np.arange(some.max(), side.min() - dt, -dt) if tail == -1 else np.arange(some.min(), side.max() + dt, dt)
    sign = -1.0 if tail == -1 else 1.0
    unit = np.broadcast_to(np.asarray(unit, float), graph.n)
    for t in grid:
        labels = graph.label(passing(x, t, tail))
        at = labels >= 0
        extent = np.bincount(labels[at], unit[at], graph.n)
        out[at] += sign * extent[labels[at]] ** e * abs(t) ** h * dt
    return out


def _map_of(pdf: pd.DataFrame, n: int, value: str) -> np.ndarray:
    x = np.zeros(n)
    x[pdf["feature"].to_numpy()] = pdf[value].fillna(0.0).to_numpy()
    return x


def find_clusters(maps: DataFrame, by: list[str], graph: Graph, threshold: float, tail: int, value: str = "x") -> DataFrame:
    """(by, feature, cluster, size, total): connected features past the threshold; cluster is its least feature, total its sum of x."""
    kinds = dict(maps.dtypes)
    schema = ", ".join(f"{b} {kinds[b]}" for b in by) + ", feature int, cluster int, size int, total double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _map_of(pdf, graph.n, value)
        here = np.zeros(graph.n, bool)
        here[pdf["feature"].to_numpy()] = True
        labels = graph.label(passing(x, threshold, tail) & here)
        at = np.nonzero(labels >= 0)[0]
        size, total = np.bincount(labels[at], minlength=graph.n), np.bincount(labels[at], x[at], graph.n)
        out = pd.DataFrame({"feature": at, "cluster": labels[at], "size": size[labels[at]], "total": total[labels[at]]})
        for b in reversed(by):
            out.insert(0, b, pdf[b].iloc[0])
        return out

    return maps.groupBy(*by).applyInPandas(run, schema)


def enhance(maps: DataFrame, by: list[str], graph: Graph, value: str = "x", exact: bool = True, **options) -> DataFrame:
    """(by, feature, tfce) of each map; exact, or stepped with dt and tail; ``unit`` is what a feature adds to the extent."""
    kinds = dict(maps.dtypes)
    schema = ", ".join(f"{b} {kinds[b]}" for b in by) + ", feature int, tfce double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _map_of(pdf, graph.n, value)
        y = exact_enhancement(x, graph, **options) if exact else stepped_enhancement(x, graph, **options)
        f = pdf["feature"].to_numpy()
        out = pd.DataFrame({"feature": f, "tfce": y[f]})
        for b in reversed(by):
            out.insert(0, b, pdf[b].iloc[0])
        return out

    return maps.groupBy(*by).applyInPandas(run, schema)


def sized_pvalues(clusters: DataFrame, table: DataFrame) -> DataFrame:
    """Adds p by cluster size from table (size, p); sizes past its end take its last entry."""
    last = table.agg(F.max("size").alias("last"))
    capped = clusters.crossJoin(F.broadcast(last)).withColumn("_s", F.least("size", "last"))
    return capped.join(table.withColumnRenamed("size", "_s"), "_s", "left").drop("_s", "last")


def alpha_map(maps: DataFrame, by: list[str], graph: Graph, threshold: float, table: DataFrame, value: str = "x") -> DataFrame:
    """(by, feature, side, cluster, size, p): clusters above and below the threshold apart, their p by size from table (size, p)."""
    up = find_clusters(maps, by, graph, threshold, 1, value).withColumn("side", F.lit(1))
    down = find_clusters(maps, by, graph, -threshold, -1, value).withColumn("side", F.lit(-1))
    return sized_pvalues(up.unionByName(down), table).select(*by, "feature", "side", "cluster", "size", "p")


def smooth(frame: DataFrame, shape: tuple[int, ...], sigma: tuple[float, ...], y: str = "y") -> DataFrame:
    """Each row's map convolved with a Gaussian along every axis whose sigma is above 0; edges are mirrored, the kernel ends at 4 sigma."""
    if len(shape) != len(sigma):
        raise ValueError("one sigma for each axis")

    def run(batches):
        for pdf in batches:
            a = np.array(pdf[y].tolist(), float).reshape(-1, *shape)
            for axis, s in enumerate(sigma, 1):
                if s > 0:
                    k = int(4 * s + 0.5)
                    w = np.exp(-0.5 * (np.arange(-k, k + 1) / s) ** 2)
                    pad = np.pad(a, [(k, k) if i == axis else (0, 0) for i in range(a.ndim)], mode="symmetric")
                    a = sum(c * np.take(pad, range(i, i + a.shape[axis]), axis) for i, c in enumerate(w / w.sum()))
            yield pdf.assign(**{y: a.reshape(len(pdf), -1).tolist()})

    return frame.mapInPandas(run, frame.schema)
