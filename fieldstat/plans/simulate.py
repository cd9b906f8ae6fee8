"""Simulated trials with a known signal: the whole analysis against one model for each feature."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import t_two_tailed
from ..operators import frames, generate, mixed, scoring
from ..operators.frames import cells
from ..operators.inference import fdr
from .model import FieldModel


def simulate(spark: SparkSession, subjects: int = 8, observations: int = 20, slope: float = 1.0, shape: tuple[int, int] = (8, 8), perms: int = 19, seed: int = 1, methods: tuple[str, ...] = ("field", "glm", "lmm"), noise: DataFrame | None = None) -> DataFrame:
    """(method, auc, rates at p <= 0.05, seconds): how well each method's map of beh finds the planted block.

    field: the whole analysis by permutation; glm: least squares within subjects, then a t over subjects; lmm:
    one mixed model for each feature. The last two are corrected by false discovery rate. noise: given trials (row_id, grp, beh, y)
    that the block is planted in, instead of ``subjects`` times ``observations`` generated ones.
    """
    import numpy as np

    field = generate.block_pattern(shape, shape[0] // 3, shape[1] // 3, np.ones((max(1, shape[0] // 3), max(1, shape[1] // 3))))
    pattern = generate.pattern_frame(spark, field)
    data = generate.trials(spark, subjects, observations, pattern, slope, seed=seed).withColumnRenamed("subj", "grp") if noise is None else generate.planted(noise, pattern, slope)
    data = data.persist()
    truth, out = pattern.select("feature", (F.col("signal") != 0).alias("real")), None
    for method in methods:
        began = time.perf_counter()
        if method == "field":
            m = FieldModel(data, "val ~ beh + (1|subj)", shape=shape, feat_nboot=300, seed=seed).run_perms(perms, seed)
            result = m.t_features(["beh"]).join(m.p_features(["beh"]), ["term", "feature"]).select("feature", "t", "p")
        elif method == "glm":
            b = frames.simple_regression(cells(data, "beh"), ["grp", "feature"], "beh", "x")
            t = b.groupBy("feature").agg(F.count("*").alias("n"), frames.one_sample_t("slope").alias("t"))
            result = fdr(t.select(F.lit(0).alias("g"), "feature", "t", t_two_tailed(F.col("t"), (F.col("n") - 1).cast("int")).alias("p")), "p", ["g"]).select("feature", "t", F.col("q").alias("p"))
        elif method == "lmm":
            t = mixed.fit_models(cells(data, "beh"), "x ~ beh + (1|grp)", ["feature"]).filter("term = 'beh'")
            rows, groups = data.agg(F.count("*"), F.countDistinct("grp")).first()
            df = rows - groups - 1
            result = fdr(t.select(F.lit(0).alias("g"), "feature", "t", t_two_tailed(F.col("t"), F.lit(df)).alias("p")), "p", ["g"]).select("feature", "t", F.col("q").alias("p"))
        else:
            raise ValueError(f"method {method!r}")
        both = result.join(truth, "feature").withColumn("m", F.lit(method)).persist()
        both.count()
        seconds = time.perf_counter() - began
        auc = scoring.area(_from_origin(scoring.roc_at_values(both, ["m"], F.abs("t"), F.col("real"))), ["m"])
        rates = scoring.confusion(both, ["m"], F.col("p") <= 0.0501, F.col("real"))
        one = auc.join(rates, "m").select(F.col("m").alias("method"), "auc", "tpr", "fpr", "mcc", F.lit(seconds).alias("seconds"))
        out = one if out is None else out.union(one)
    return out


def _from_origin(points: DataFrame) -> DataFrame:
    """The curve begins at no threshold passed."""
    start = points.select("m").distinct().select("m", *[F.lit(0.0).alias(c) for c in ("fpr", "tpr")])
    return points.select("m", "fpr", "tpr").union(start)
