"""Ball k-means: exact clustering in which members are compared with the centroids near their ball alone."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, kept_whole

DIMS, CLUSTERS, ROUNDS = 64, 40, 5
#: Components are floor(GRID * x).
GRID = 256
#: Largest component whose squared distances are exact in 64 bits, and in doubles.
MOST, DOUBLES = 2**26, 2**22


def grid_vectors(rows: DataFrame, dims: int = DIMS) -> DataFrame:
    """(vec_id, v): vectors of exactly ``dims`` components, none null or non-finite, as integers floor(GRID * x)."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(math.inf)))
    kept = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), x).filter((F.size(x) == dims) & finite)
    return kept.select("vec_id", F.transform("embedding", lambda e: F.floor(e.cast("double") * GRID)).alias("v"))


@dataclass
class Balls:
    """Centroids, and for each cluster the centroids that may be nearer to a member: by distance, itself left out."""

    centres: np.ndarray
    near: list[np.ndarray] | None = None
    apart: list[np.ndarray] | None = None


def neighbours(centres: np.ndarray, radius: np.ndarray) -> Balls:
    """``radius``: a bound of each cluster's members' distance to their centroid, -1 without members.

    No member of ball i is nearer to j, or as near, where the centroids are more than twice the radius apart.
    """
    near, apart = [], []
    for i, r in enumerate(radius.tolist()):
        d = _squares(centres, centres[i])
        j = np.nonzero((d <= 4 * r * r) & (np.arange(len(centres)) != i))[0] if r >= 0 else np.empty(0, int)
        j = j[np.lexsort((j, d[j]))]
        near.append(j)
        apart.append(d[j])
    return Balls(centres, near, apart)


def _squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one point or to a point each, exactly."""
    d = v - c
    return (d * d).sum(-1)


def _table(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, exactly."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= DOUBLES:  # sums stay below 2 ** 53
        a, b = v.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([_squares(v, x) for x in c], 1)


def nearest(v: np.ndarray, own: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, of ties the smaller number, and its squared distance.

    own: each row's cluster so far. A member is stable, without any comparison, if its distance is below half of that to the nearest
    neighbour centroid; the others stand in annuli between such halves and are compared with the centroids up to theirs.
    """
    if balls.near is None:
        d = _table(v, balls.centres)
        out = d.argmin(1)
        return out, d[np.arange(len(v)), out]
    out, best = own.copy(), _squares(v, balls.centres[own])
    order = np.argsort(own, kind="stable")
    ends = np.searchsorted(own[order], np.arange(len(balls.centres) + 1))
    for i in np.nonzero(np.diff(ends))[0]:
        rows = order[ends[i] : ends[i + 1]]
        ring = np.searchsorted(balls.apart[i], 4 * best[rows], "right")  # centroids at most twice as far away as the member
        rows, ring = rows[ring > 0], ring[ring > 0]
        if not len(rows):
            continue
        by = np.argsort(ring, kind="stable")  # annuli from the outside in: each meets the centroids up to its own
        rows, ring = rows[by], ring[by]
        starts = np.searchsorted(ring, np.unique(ring))
        for at, end in zip(starts, [*starts[1:], len(rows)]):
            r, j = rows[at:end], np.sort(np.append(balls.near[i][: ring[at]], i))
            d = _table(v[r], balls.centres[j])
            k = d.argmin(1)
            out[r], best[r] = j[k], d[np.arange(len(r)), k]
    return out, best


def _rows(b: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    v = b.column(name).flatten().to_numpy().reshape(-1, dims)
    if len(v) and max(-int(v.min()), int(v.max())) > MOST:
        raise ValueError(f"components beyond {MOST} have no exact distance in 64 bits")
    return v


def _assign(balls: Balls, dims: int):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                own = part.column("cluster").to_numpy().astype(np.int64)
                cluster, d = nearest(_rows(part, "v", dims), own, balls)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(cluster.astype(np.int32)), pa.array(d)], ["vec_id", "v", "cluster", "distance"])

    return run


def _sum(clusters: int, dims: int):
    """A task's sums of its rows: one row a cluster that it has, whatever the number of rows."""

    def run(batches):
        n, far, total = np.zeros(clusters, np.int64), np.full(clusters, -1, np.int64), np.zeros((clusters, dims), np.int64)
        for b in batches:
            if b.num_rows:
                c, v = b.column("cluster").to_numpy(), _rows(b, "v", dims)
                order = np.argsort(c, kind="stable")
                which, starts = np.unique(c[order], return_index=True)
                total[which] += np.add.reduceat(v[order], starts, 0)
                n += np.bincount(c, minlength=clusters)
                np.maximum.at(far, c, b.column("distance").to_numpy())
        some = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(some))), pa.array(total[some].ravel()), pa.array(np.repeat(n[some], dims)), pa.array(np.repeat(far[some], dims))], ["cluster", "dim", "s", "n", "far"])

    return run


def _root(x: int) -> int:
    """The least whole number whose square is at least x."""
    return math.isqrt(x - 1) + 1 if x > 0 else 0


def moved(rows: DataFrame, centres: np.ndarray) -> Balls:
    """Centroids as floors of their members' means (empty ones stay), and the balls around them.

    A ball's radius is bounded by its farthest member's distance to the old centroid and the way the centroid went, so no scan is needed for it.
    At most clusters x dims rows come to the driver.
    """
    k, dims = centres.shape
    sums = rows.select("cluster", "distance", "v").mapInArrow(_sum(k, dims), "cluster int, dim int, s bigint, n bigint, far bigint")
    new, radius = centres.copy(), np.full(k, -1, object)
    for r in sums.groupBy("cluster", "dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"), F.max("far").alias("far")).collect():
        new[r["cluster"], r["dim"]] = int(r["s"]) // r["n"]
        radius[r["cluster"]] = _root(r["far"])
    for i in range(k):
        if radius[i] >= 0:
            radius[i] += _root(int(_squares(new[i], centres[i])))
    return neighbours(new, radius)


def ball_kmeans(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for the kept rows of (vec_id bigint, embedding array of numbers).

    Kept: exactly ``dims`` components, none null or non-finite; null arrays go. Components beyond MOST after scaling raise an error, as
    their squared distances don't fit a long. First centroids: the vectors of the least sha256 of ``2:<vec_id>`` (a null id as the
    empty text; of rows that repeat an id those of smaller components first); fewer vectors than clusters give fewer clusters.
    Repeated vectors are rows like others. Extra columns are not read; an empty table gives an empty table.

    Each round reads the vectors twice and writes them with their clusters to the shared folder; driver and tasks hold the centroids alone.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "balls")
    first = grid_vectors(rows, dims).withColumn("cluster", F.lit(0))
    key = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = first.select(key.alias("key"), "v").orderBy("key", "v").limit(clusters).collect()
    schema = "vec_id bigint, v array<bigint>, cluster int, distance bigint"
    if not start:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    balls = Balls(np.array([r["v"] for r in start], np.int64))
    now = first.select("vec_id", "v", "cluster")
    for i in range(rounds + 1):
        now = scratch.write(now.select("vec_id", "v", "cluster").mapInArrow(_assign(balls, dims), schema), str(i))
        if i:
            scratch.drop(str(i - 1))
        if i < rounds:
            balls = moved(now, balls.centres)
    sums = {r["cluster"]: r["s"] for r in now.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a cluster
    whole = sum(sums.values())
    facts = pd.DataFrame({"cluster": list(sums), "cluster_inertia": list(sums.values()), "centroid_sha256": [hashlib.sha256(",".join(map(str, balls.centres[c].tolist())).encode()).hexdigest() for c in sums]})
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, centroid_sha256 string")
    out = now.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster")
    out = kept_whole(out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(whole).cast("bigint").alias("inertia"), "centroid_sha256"))
    scratch.drop()
    return out
