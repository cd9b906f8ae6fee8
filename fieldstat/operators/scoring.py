"""Detection scores of maps against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio


def counts(hit: Column, true: Column) -> list[Column]:
    return [F.count_if(c).cast("double").alias(n) for n, c in (("tp", hit & true), ("fp", hit & ~true), ("fn", ~hit & true), ("tn", ~hit & ~true))]


def with_rates(df: DataFrame) -> DataFrame:
    """Adds the rates to tp, fp, fn, tn; a rate over nothing is null, the correlation's empty denominator is 1."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    d = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)  # roots first: the product overflows
    return df.withColumns({
        "tpr": ratio(tp, tp + fn), "spc": ratio(tn, fp + tn), "ppv": ratio(tp, tp + fp), "npv": ratio(tn, tn + fn), "fpr": ratio(fp, fp + tn),
        "fdr": ratio(fp, fp + tp), "fnr": ratio(fn, fn + tp), "acc": ratio(tp + tn, tp + tn + fp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": (tp * tn - fp * fn) / F.when(d == 0, 1.0).otherwise(d),
    })


def confusion(df: DataFrame, by: list[str], hit: Column, true: Column) -> DataFrame:
    return with_rates(df.groupBy(*by).agg(*counts(hit, true)))


def error_rates(maps: DataFrame, pvals: DataFrame, truth: DataFrame, threshold: float, full: bool = False) -> DataFrame:
    """(tpr, fpr[, tnr, fnr]) pooled over terms but the intercept; terms whose p is above the gate find nothing.

    maps: (term, feature, b); pvals: (term, p); truth: (feature, signal). The gate is 0.05 if ``full``, else 1 - threshold.
    """
    gate = 0.05 if full else 1 - threshold
    rows = maps.filter(~F.col("term").isin("Intercept", "(Intercept)")).join(pvals, "term").join(truth, "feature")
    hit, true = (F.col("p") <= gate) & (F.abs("b") >= threshold), F.col("signal") != 0
    out = with_rates(rows.agg(*counts(hit, true)))
    return out.select("tpr", "fpr", F.col("spc").alias("tnr"), "fnr") if full else out.select("tpr", "fpr")


def agreement(df: DataFrame, by: list[str], image: Column, true: Column) -> DataFrame:
    """(by, tp, fp, tn, fn, s, dice, mcc): non-zero features; s counts those found with the other sign."""
    hit, real = image != 0, true != 0
    out = df.groupBy(*by).agg(*counts(hit, real), F.count_if(F.signum(image) * F.signum(true) < 0).cast("double").alias("s"))
    out = with_rates(out)
    return out.select(*by, "tp", "fp", "tn", "fn", "s", F.col("f1").alias("dice"), "mcc")


def pairwise(maps: DataFrame, run: str, feature: str, value: str) -> DataFrame:
    """(run_a, run_b, ...): agreement of every two runs, a < b; runs are few, features join by key."""
    a = maps.select(F.col(run).alias("run_a"), feature, F.col(value).alias("va"))
    b = maps.select(F.col(run).alias("run_b"), feature, F.col(value).alias("vb"))
    both = a.join(b, feature).filter("run_a < run_b")
    return agreement(both, ["run_a", "run_b"], F.col("va"), F.col("vb"))


def roc(df: DataFrame, by: list[str], score: Column, true: Column, num: int = 1000, start: float = 0.0, stop: float = 1.0) -> DataFrame:
    """(by, thr, confusion rates): ``num`` thresholds from start to stop and one above; a score at a threshold counts as above.

    Scores go to the last threshold they reach, counts are summed from the top: rows are read once, whatever
    the number of thresholds. Scores below ``start`` reach none.
    """
    step = (stop - start) / (num - 1)
    spark = df.sparkSession
    k = F.floor((score - start) / step)
    # floor may be off by one where the division rounds; thresholds decide
    k = F.when(start + (k + 1) * step <= score, k + 1).when(start + k * step > score, k - 1).otherwise(k)
    k = F.least(F.when(score >= stop + (start + step), F.lit(num)).otherwise(F.least(k, F.lit(num - 1))), F.lit(num)).cast("int")
    binned = df.groupBy(*by, k.alias("_bin")).agg(F.count_if(true).alias("p"), F.count_if(~true).alias("n"))
    grid = spark.range(num + 1).select(F.col("id").cast("int").alias("_bin"), F.when(F.col("id") < num, start + F.col("id") * step).otherwise(stop + (start + step)).alias("thr"))
    keys = df.select(*by).distinct() if by else spark.range(1).select()
    grid = keys.crossJoin(F.broadcast(grid))
    whole = binned.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    at = grid.join(binned, [*by, "_bin"], "left").fillna(0, ["p", "n"])
    w = Window.partitionBy(*by).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("tp", F.sum("p").over(w).cast("double")).withColumn("fp", F.sum("n").over(w).cast("double"))
    at = at.join(whole, by) if by else at.crossJoin(F.broadcast(whole))
    at = at.withColumn("fn", F.col("all_p") - F.col("tp")).withColumn("tn", F.col("all_n") - F.col("fp"))
    return with_rates(at.select(*by, "thr", "tp", "fp", "fn", "tn"))


def area(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, auc): trapezoids under tpr over fpr, points in order of both."""
    w = Window.partitionBy(*by).orderBy("fpr", "tpr")
    part = (F.col("fpr") - F.lag("fpr").over(w)) * (F.col("tpr") + F.lag("tpr").over(w)) / 2
    return points.withColumn("part", part).groupBy(*by).agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("auc"))


def peak(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, thr, mcc): the first threshold with the highest correlation."""
    best = points.groupBy(*by).agg(F.max(F.struct("mcc", (-F.col("thr")).alias("back"))).alias("best"))
    return best.select(*by, (-F.col("best.back")).alias("thr"), F.col("best.mcc").alias("mcc"))


def roc_at_values(df: DataFrame, by: list[str], score: Column, true: Column) -> DataFrame:
    """(by, thr, confusion rates) at every distinct score, a score at a threshold counting as above."""
    at = df.groupBy(*by, score.alias("thr")).agg(F.count_if(true).alias("_p"), F.count_if(~true).alias("_n"))
    down, whole = Window.partitionBy(*by).orderBy(F.desc("thr")), Window.partitionBy(*by)
    at = at.withColumns({"tp": F.sum("_p").over(down).cast("double"), "fp": F.sum("_n").over(down).cast("double")})
    at = at.withColumns({"fn": F.sum("_p").over(whole) - F.col("tp"), "tn": F.sum("_n").over(whole) - F.col("fp")})
    return with_rates(at.select(*by, "thr", "tp", "fp", "fn", "tn"))
