"""Table idioms around the statistics: binning, joins by position, shards and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram_mode(df: DataFrame, by: list[str], value: str, bins: int = 500) -> DataFrame:
    """(by, mode): left edge of the first of ``bins`` equal bins that holds the most values."""
    ends = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = df.join(ends, by) if by else df.crossJoin(F.broadcast(ends))
    k = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    n = at.groupBy(*by, "lo", "hi", k.alias("k")).agg(F.count("*").alias("n"))
    best = n.groupBy(*by, "lo", "hi").agg(F.max(F.struct("n", (-F.col("k")).alias("back"))).alias("b"))
    return best.select(*by, (F.col("lo") - F.col("b.back") * (F.col("hi") - F.col("lo")) / bins).alias("mode"))


def interval_bins(events: DataFrame, keep: list[str], onset: Column, duration: Column, step: float) -> DataFrame:
    """One row for each time bin an event covers: from its onset's bin up to, not including, its end's; times cut toward 0."""
    first, end = (onset / step).cast("int"), ((onset + duration) / step).cast("int")
    return events.select(*keep, F.explode(F.when(end > first, F.sequence(first, end - 1)).otherwise(F.array().cast("array<int>"))).alias("bin"))


def zip_by_position(left: DataFrame, right: DataFrame, by: list[str], order_left: str, order_right: str) -> DataFrame:
    """Rows paired by their position within ``by``; positions only one side has are left out."""
    a = left.withColumn("_p", F.row_number().over(Window.partitionBy(*by).orderBy(order_left)))
    b = right.withColumn("_p", F.row_number().over(Window.partitionBy(*by).orderBy(order_right)))
    return a.join(b, [*by, "_p"]).drop("_p")


def missing(planned: DataFrame, complete: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(complete.select(*keys).distinct(), keys, "left_anti")


def recombine(shards: list[DataFrame]) -> DataFrame:
    """Runs of all shards, aligned by name; the observed run (0), which every shard carries, once."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s.filter("run <> 0"))
    return out


def scatter(values: DataFrame, features: DataFrame) -> DataFrame:
    """(feature, t, p) on the whole grid: t 0 and p 1 outside the mask."""
    return features.select("feature").join(values, "feature", "left").select("feature", F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce("p", F.lit(1.0)).alias("p"))


def thresholded(t: Column, p: Column, alpha: float = 0.05) -> Column:
    return F.when(p < alpha, t).otherwise(0.0)


def joined_text(df: DataFrame, by: list[str], order: list[str], parts: list[Column], sep: str = " ") -> DataFrame:
    """(by, line): one text for each key, its rows' parts joined in order."""
    one = F.struct(*order, F.concat_ws(":", *[p.cast("string") for p in parts]).alias("_t"))
    rows = F.array_sort(F.collect_list(one))
    return df.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["_t"]), sep).alias("line"))


def numbered(rows: DataFrame, name: str, text: Column, *ties: str) -> DataFrame:
    """Adds ``name``: the place, from 0, of each row in the order of ``text``, a hexadecimal hash, and ``ties``.

    Rows are dealt by the hash's first three digits; each of the 4096 ranges is numbered by itself behind the counts
    of those before it, so no task sorts all rows.
    """
    rows = rows.withColumn("_h", text).withColumn("_range", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    counts = sorted(tuple(r) for r in rows.groupBy("_range").count().collect())  # at most 4096
    first, before = [], 0
    for k, n in counts:
        first.append((k, before))
        before += n
    first = F.broadcast(rows.sparkSession.createDataFrame(first, "_range int, _first bigint"))
    at = F.row_number().over(Window.partitionBy("_range").orderBy("_h", *ties)) - 1
    return rows.join(first, "_range").withColumn(name, F.col("_first") + at).drop("_h", "_range", "_first")


def counted_below(values: DataFrame, asked: DataFrame, ranges: int = 200) -> DataFrame:
    """(x, below, at, n) for each distinct x of ``asked`` (x double): how many ``values`` (v double) are less, equal, and in all.

    Both are dealt to ranges between quantiles of the values and counted range by range behind the sums of those
    before, so no task sorts all values and no row is compared with all of them. Nulls are not counted; a null x gets no row.
    """
    spark = values.sparkSession
    grid = values.filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("c"))
    both = grid.select("v", "c", F.lit(0).alias("q")).union(asked.filter("x IS NOT NULL").select("x", F.lit(0), F.lit(1)))
    both = both.groupBy("v").agg(F.sum("c").alias("c"), F.max("q").alias("q"))
    bounds = sorted(set(both.approxQuantile("v", [i / ranges for i in range(1, ranges)], 0.002) or []))
    edges = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<double>")
    both = both.withColumn("_range", F.size(F.filter(edges, lambda b: b < F.col("v"))))
    first, before = [], 0
    for k, n in sorted(tuple(r) for r in both.groupBy("_range").agg(F.sum("c")).collect()):  # at most ``ranges``
        first.append((k, before))
        before += n
    first = F.broadcast(spark.createDataFrame(first, "_range int, _first bigint"))
    upto = F.sum("c").over(Window.partitionBy("_range").orderBy("v"))
    out = both.join(first, "_range").withColumn("upto", F.col("_first") + upto)
    return out.filter("q = 1").select(F.col("v").alias("x"), (F.col("upto") - F.col("c")).alias("below"), F.col("c").alias("at"), F.lit(before).cast("bigint").alias("n"))
