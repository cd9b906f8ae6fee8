"""Corrected p-values: false discovery rate, bootstrap statistics, maximum statistics, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables


def fdr(df: DataFrame, p: str, by: list[str], alpha: float = 0.05, method: str = "indep") -> DataFrame:
    """Adds q and reject within ``by``: Benjamini-Hochberg ("indep") or Benjamini-Yekutieli ("negcorr").

    reject: p not above the largest sorted p that lies strictly below its line. ``by`` may be empty (one
    family) only for tables that fit one task; large tables are families by key.
    """
    if method not in ("indep", "negcorr"):
        raise ValueError("method is indep or negcorr")
    w = Window.partitionBy(*by)
    n = F.count("*").over(w).cast("double")
    rk = F.row_number().over(w.orderBy(p))
    out = df.withColumn("_n", n).withColumn("_rk", rk)
    factor = F.lit(1.0) if method == "indep" else F.aggregate(F.sequence(F.lit(1), F.col("_n").cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    out = out.withColumn("_c", factor)
    raw = F.col(p) * F.col("_n") * F.col("_c") / F.col("_rk")
    below = F.col(p) < F.lit(alpha) * F.col("_rk") / (F.col("_n") * F.col("_c"))
    out = out.withColumn("q", F.least(F.min(raw).over(w.orderBy(F.desc("_rk")).rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)))
    last = F.max(F.when(below, F.col("_rk"))).over(w)
    return out.withColumn("reject", F.coalesce(F.col("_rk") <= last, F.lit(False))).drop("_n", "_rk", "_c")


def boot_stat(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds b to (run, keys, stat, sterr): |stat / sterr| in run 0, |(stat - stat of run 0) / sterr| elsewhere, 0 where sterr is 0."""
    first = df.filter("run = 0").select(*keys, F.col("stat").alias("stat0"))
    num = F.col("stat") - F.when(F.col("run") == 0, F.lit(0.0)).otherwise(F.col("stat0"))
    return df.join(first, keys, "left").withColumn("b", F.when(F.col("sterr") != 0, F.abs(num / F.col("sterr"))).otherwise(0.0)).drop("stat0")


def _null_arrays(null: DataFrame, by: list[str], value: str) -> DataFrame:
    """One sorted array of the null values for each key: as many values as runs, never more."""
    return null.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("null"))


def _at_least(null: Column, x: Column) -> Column:
    return F.size(F.filter(null, lambda v: v >= x))


def max_stat_pvalues(maps: DataFrame, by: list[str], stat: str = "t") -> DataFrame:
    """(by, run, feature, p): share of runs whose largest |stat| over features is at least this one's."""
    null = _null_arrays(maps.groupBy(*by, "run").agg(F.max(F.abs(stat)).alias("m")), by, "m")
    out = maps.join(null, by)
    return out.select(*by, "run", "feature", (_at_least(F.col("null"), F.abs(stat)) / F.size("null")).alias("p"))


def two_stage_pvalues(maps: DataFrame, term: str = "term", stat: str = "t") -> DataFrame:
    """(term, feature, p) of run 0: maximum-statistic p by term, then the smallest p over terms and features as null."""
    first = max_stat_pvalues(maps, [term], stat)
    return _min_p(first, [term])


def conjunction_pvalues(maps: DataFrame, terms: list[str], stat: str = "t") -> DataFrame:
    """As :func:`two_stage_pvalues` for all ``terms`` at once: the largest p over terms, named a&b."""
    first = max_stat_pvalues(maps.filter(F.col("term").isin(terms)), ["term"], stat)
    both = first.groupBy("run", "feature").agg(F.max("p").alias("p")).withColumn("term", F.lit("&".join(terms)))
    return _min_p(both, ["term"])


def _min_p(first: DataFrame, keep: list[str]) -> DataFrame:
    null = first.groupBy("run").agg(F.min("p").alias("m")).agg(F.sort_array(F.collect_list("m")).alias("null"))
    out = first.filter("run = 0").crossJoin(F.broadcast(null))
    return out.select(*keep, "feature", (F.size(F.filter("null", lambda v: v <= F.col("p"))) / F.size("null")).alias("p"))


def histogram_pvalue(stats: DataFrame, null: DataFrame, tail: int, value: str = "t", null_value: str = "h") -> DataFrame:
    """Adds p = (count + 1) / (n + 1): null values at or below (-1), at or above (1), or at either end (0) of each statistic.

    null: any number of values, all of them counted. A null statistic has none at or past it.
    """
    if tail not in (-1, 0, 1):
        raise ValueError("tail is -1, 0 or 1")
    x = F.col(value).cast("double")
    low, high = (-F.abs(x), F.abs(x)) if tail == 0 else (x, x)
    asked = stats.select(low.alias("x")).union(stats.select(high.alias("x"))).distinct()
    counts = tables.counted_below(null.select(F.col(null_value).cast("double").alias("v")), asked)
    n = null.filter(F.col(null_value).isNotNull()).agg(F.count("*").alias("_n"))
    out = stats.withColumns({"_low": low, "_high": high}).crossJoin(F.broadcast(n))
    hits = F.lit(0)
    if tail <= 0:
        le = counts.select(F.col("x").alias("_low"), (F.col("below") + F.col("at")).alias("_le"))
        out, hits = out.join(le, "_low", "left"), hits + F.coalesce("_le", F.lit(0))
    if tail >= 0:
        ge = counts.select(F.col("x").alias("_high"), (F.col("n") - F.col("below")).alias("_ge"))
        out, hits = out.join(ge, "_high", "left"), hits + F.coalesce("_ge", F.lit(0))
    return out.withColumn("p", (hits + 1) / (F.col("_n") + 1)).drop("_low", "_high", "_le", "_ge", "_n")


def stable_features(z: DataFrame, boots: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(term, feature, score, p, stable): mean z over groups against the spread of its bootstrap means.

    boots: (run, slot, grp). Each run's mean is a weighted sum, so resampled rows are never written out. p is
    two-tailed Student's t with groups - 1 degrees of freedom; without spread p is 1.
    """
    from ..functions.columns import t_two_tailed

    weights = boots.groupBy("run", "grp").agg(F.count("*").alias("w"))
    slots = boots.groupBy("run").agg(F.count("*").alias("slots"))
    means = z.join(weights, "grp").groupBy("term", "feature", "run").agg(F.sum(F.col("w") * F.col("z")).alias("s"))
    means = means.join(slots, "run").withColumn("m", F.col("s") / F.col("slots"))
    spread = means.groupBy("term", "feature").agg(F.stddev_pop("m").alias("se"))
    whole = z.groupBy("term", "feature").agg(F.avg("z").alias("mz"), F.count("*").alias("k"))
    out = whole.join(spread, ["term", "feature"])
    out = out.withColumn("score", F.when(F.col("se") > 0, F.col("mz") / F.col("se")))
    out = out.withColumn("p", F.coalesce(t_two_tailed(F.col("score"), (F.col("k") - 1).cast("int")), F.lit(1.0)))
    return out.select("term", "feature", "score", "p", (F.col("p") < alpha).alias("stable"))


def nested_standard_errors(maps: DataFrame, keys: list[str], groups: int) -> DataFrame:
    """(keys, outer_id, stat, sterr) from (outer_id, inner_id, keys, stat); inner 0 is the outer replicate itself.

    With more inner replicates than groups: their mean (the outer one included) and a bootstrap error;
    otherwise the outer statistic and the jackknife error (B / (B + 1)) * sqrt of the summed squares.
    """
    g = maps.groupBy(*keys, "outer_id").agg((F.count("*") - 1).alias("b"), F.avg("stat").alias("mean"), F.max(F.when(F.col("inner_id") == 0, F.col("stat"))).alias("outer"), F.collect_list(F.struct("inner_id", "stat")).alias("all"))

    def squares(centre, rows):
        return F.sqrt(F.aggregate(rows, F.lit(0.0), lambda a, x: a + (centre - x["stat"]) * (centre - x["stat"])))

    boot = F.col("b") > groups
    inner = F.filter("all", lambda x: x["inner_id"] > 0)
    err = F.when(boot, squares(F.col("mean"), F.col("all")) / F.col("b")).otherwise(F.col("b") / (F.col("b") + 1) * squares(F.col("outer"), inner))
    return g.select(*keys, "outer_id", F.when(boot, F.col("mean")).otherwise(F.col("outer")).alias("stat"), err.alias("sterr"))
