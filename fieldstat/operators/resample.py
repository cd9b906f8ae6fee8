"""Resampling: permutations, balanced bootstraps and jackknives, all ordered by hash and so repeatable anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import numbered


def _shuffle(seed: int, *cols: str):
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def permutations(rows: DataFrame, runs: int | list[int], seed: int = 1) -> DataFrame:
    """(run, grp, row_id, src_row_id): within each group, rows take the place of others; run 0 is as observed.

    runs: that many besides run 0, or the numbers of those wanted; what a run looks like depends on its number and the seed alone.
    """
    spark = rows.sparkSession
    numbers = spark.range(runs + 1) if isinstance(runs, int) else spark.createDataFrame([(r,) for r in runs], "id bigint")
    each = rows.select("grp", "row_id").crossJoin(F.broadcast(numbers.select(F.col("id").cast("int").alias("run"))))
    w = Window.partitionBy("run", "grp")
    place = each.withColumn("p", F.row_number().over(w.orderBy("row_id")))
    mixed = each.withColumn("k", F.when(F.col("run") == 0, F.lpad(F.col("row_id").cast("string"), 20, "0")).otherwise(_shuffle(seed, "run", "row_id")))
    mixed = mixed.select("run", "grp", F.col("row_id").alias("src_row_id"), F.row_number().over(w.orderBy("k", "row_id")).alias("p"))
    return place.join(mixed, ["run", "grp", "p"]).select("run", "grp", "row_id", "src_row_id")


def balanced_boots(groups: DataFrame, boots: int, seed: int = 1) -> DataFrame:
    """(run, slot, grp), runs from 1: every group appears exactly ``boots`` times overall, each run has as many slots as groups."""
    spark = groups.sparkSession
    copies = groups.select("grp").distinct().crossJoin(F.broadcast(spark.range(boots).select(F.col("id").alias("c"))))
    n = groups.select("grp").distinct().count()
    return numbered(copies, "pos", _shuffle(seed, "c", "grp"), "c", "grp").select((F.floor(F.col("pos") / n) + 1).cast("int").alias("run"), (F.col("pos") % n).cast("int").alias("slot"), "grp")


def balanced_slots(groups: int, first: int, last: int, seed: int = 1, block: int | None = None) -> dict[int, np.ndarray]:
    """Numbers of the groups that fill the slots of bootstraps ``first`` (1 or more) to ``last``, balanced: every group as often as there are runs.

    With ``block``, runs 1 to ``block``, and so on, are dealt together instead: a run depends on its number and the seed alone, and
    every full block is balanced.
    """
    out = {}
    for run in range(first, last + 1):
        start, n = (first, last - first + 1) if block is None else (run - (run - 1) % block, block)
        if run in (first, start):
            rng = np.random.Generator(np.random.PCG64(seed if start == 1 else [seed, start]))
            flat = rng.permutation(np.repeat(np.arange(groups), n)).reshape(n, groups)
        out[run] = flat[run - start]
    return out


def jackknife(groups: DataFrame, folds: int, seed: int = 1) -> DataFrame:
    """(run, grp), runs from 1: each run leaves out one of exactly ``folds`` parts of the groups, in hashed order."""
    if folds < 2:
        raise ValueError("a jackknife needs at least two parts")
    g = groups.select("grp").distinct()
    parts = numbered(g, "pos", _shuffle(seed, "grp"), "grp").select("grp", (F.col("pos") % folds + 1).cast("int").alias("part"))
    runs = g.sparkSession.range(1, folds + 1).select(F.col("id").cast("int").alias("run"))
    return parts.crossJoin(F.broadcast(runs)).filter("part <> run").select("run", "grp")


def subsets(items: DataFrame, key: str, sizes: list[int], runs: int, seed: int = 1) -> DataFrame:
    """(size, run, key): for each size and run that many items without replacement."""
    spark: SparkSession = items.sparkSession
    plan = spark.createDataFrame([(s, r) for s in sizes for r in range(1, runs + 1)], "size int, run int")
    each = items.select(key).distinct().crossJoin(F.broadcast(plan))
    at = F.row_number().over(Window.partitionBy("size", "run").orderBy(_shuffle(seed, "size", "run", key), key))
    return each.withColumn("at", at).filter("at <= size").select("size", "run", key)
