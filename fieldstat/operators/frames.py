"""Trial frames: rows nested in groups, each with an array of feature values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import average_rank, corr_guarded, fisher_z, nan_to_zero, one_sample_t


def model_frame(df: DataFrame, row_id: str, grp: str, y: str, predictors: dict[str, Column], row_mask: Column | None = None) -> DataFrame:
    """row_id, grp, y (array of double, NaN as 0) and one column for each predictor; masked rows go before anything else."""
    if row_mask is not None:
        df = df.filter(row_mask)
    values = F.transform(F.col(y), lambda v: nan_to_zero(v.cast("double")))
    return df.select(F.col(row_id).alias("row_id"), F.col(grp).alias("grp"), values.alias("y"), *[c.alias(k) for k, c in predictors.items()])


def cells(frame: DataFrame, *keep: str, features: DataFrame | None = None) -> DataFrame:
    """One row for each value: row_id, grp, the columns kept, feature, x. ``features`` (feature) restricts by semi join."""
    out = frame.select("row_id", "grp", *keep, F.posexplode("y").alias("feature", "x"))
    return out if features is None else out.join(features, "feature", "left_semi")


def group_correlations(long: DataFrame, terms: list[str], use_norm: bool = True) -> DataFrame:
    """(grp, feature, term, r) over cells, all terms in one aggregation; r null where a side does not vary.

    Without ``use_norm`` the products of raw values with the centred, scaled predictor.
    """
    one = [corr_guarded("x", t).alias(t) if use_norm else (F.covar_pop("x", t) * F.count("*") / F.sqrt(F.var_pop(t) * F.count("*"))).alias(t) for t in terms]
    wide = long.groupBy("grp", "feature").agg(*one)
    return wide.unpivot(["grp", "feature"], terms, "term", "r")


def fisher_t(correlations: DataFrame) -> DataFrame:
    """(term, feature, n, mean_z, t): one-sample t of Fisher z over groups; invariant features count as 0."""
    z = correlations.withColumn("z", F.coalesce(fisher_z(F.col("r")), F.lit(0.0)))
    return z.groupBy("term", "feature").agg(F.count("*").alias("n"), F.avg("z").alias("mean_z"), one_sample_t("z").alias("t"))


def scaled_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds rk (ties at their average) and scaled = (rk - 1) / (n - 1) within ``by``."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(*by))
    return df.withColumn("rk", average_rank(value, by)).withColumn("scaled", F.when(n > 1, (F.col("rk") - 1) / (n - 1)))


def centred_unit(long: DataFrame) -> DataFrame:
    """Adds m: x centred and scaled to unit length within (grp, feature); 0 where nothing varies.

    The column statistics are an aggregate joined back, so no window holds a column.
    """
    stats = long.groupBy("grp", "feature").agg(F.avg("x").alias("mu"), F.sqrt(F.var_pop("x") * F.count("*")).alias("len"))
    return long.join(stats, ["grp", "feature"]).withColumn("m", F.when(F.col("len") > 0, (F.col("x") - F.col("mu")) / F.col("len")).otherwise(0.0)).drop("mu", "len")


def condition_differences(long: DataFrame, condition: str, low, high) -> DataFrame:
    """(grp, feature, d): mean at ``low`` minus mean at ``high``, one pass."""
    a, b = (F.avg(F.when(F.col(condition) == v, F.col("x"))) for v in (low, high))
    return long.groupBy("grp", "feature").agg((a - b).alias("d"))


def pooled_t(df: DataFrame, by: list[str], side: Column, value: str) -> DataFrame:
    """(by, t, df): two-sample t with pooled variance; ``side`` is true for the first sample. Null without spread."""
    a, b = F.when(side, F.col(value)), F.when(~side, F.col(value))
    s = df.groupBy(*by).agg(F.count(a).alias("na"), F.count(b).alias("nb"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.coalesce(F.var_samp(a), F.lit(0.0)).alias("va"), F.coalesce(F.var_samp(b), F.lit(0.0)).alias("vb"))
    dof = F.col("na") + F.col("nb") - 2
    pooled = ((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / dof
    ok = (F.col("na") > 0) & (F.col("nb") > 0) & (dof > 0)
    s = s.withColumn("pooled", F.when(ok, pooled))
    t = F.when(F.col("pooled") > 0, (F.col("ma") - F.col("mb")) / F.sqrt(F.col("pooled") * (1 / F.col("na") + 1 / F.col("nb"))))
    return s.select(*by, t.alias("t"), dof.alias("df"))


def one_sided_z(t: Column, df: Column) -> Column:
    """Normal deviate of the one-sided p of a t statistic: half the two-tailed p (plus machine epsilon), turned for t > 0."""
    from ..functions.columns import normal_quantile, t_two_tailed

    p = t_two_tailed(t, df) / 2 + 2.220446049250313e-16
    return normal_quantile(F.when(t > 0, 1 - p).otherwise(p))


def simple_regression(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, slope, intercept, r2, n) of y on x; null slope where x does not vary."""
    vx, vy = F.var_pop(x), F.var_pop(y)
    slope = F.when(vx > 0, F.covar_pop(x, y) / vx)
    return df.groupBy(*by).agg(slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"), F.when((vx > 0) & (vy > 0), F.covar_pop(x, y) * F.covar_pop(x, y) / (vx * vy)).alias("r2"), F.count("*").alias("n"))


def multiple_regression(df: DataFrame, by: list[str], xs: list[str], y: str) -> DataFrame:
    """(by, term, coef): least squares with an intercept, from cross products summed in one distributed pass.

    Only a (p+1) x (p+1) matrix for each group reaches the solver; a singular one gives the least-norm solution.
    """
    import numpy as np
    import pandas as pd

    names = ["(Intercept)", *xs]
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs], F.col(y).cast("double")]
    k = len(cols)
    sums = [F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    products = df.dropna(subset=[*xs, y]).groupBy(*by).agg(*sums)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                m = np.zeros((k, k))
                for i in range(k):
                    for j in range(i, k):
                        m[i, j] = m[j, i] = row[f"s{i}_{j}"]
                coef = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
                out += [{**{b: row[b] for b in by}, "term": t, "coef": c} for t, c in zip(names, coef)]
            yield pd.DataFrame(out, columns=[*by, "term", "coef"])

    schema = ", ".join(f"`{b}` {dict(df.dtypes)[b]}" for b in by) + ", term string, coef double"
    return products.mapInPandas(solve, schema)
