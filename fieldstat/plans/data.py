"""The driver's tables as trial frames, and the same in SQL.

embeddings: label is the subject, the vector an 8 x 8 grid of features, beh = -0.5 or 0.5 by the parity of
vec_id, cont a second, continuous predictor. events: user_id is the subject, event_type the condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns
from ..operators.frames import cells, model_frame
from ..sources.files import read_tables

SHAPE = (8, 8)
FEATURES = SHAPE[0] * SHAPE[1]


def predictors() -> dict[str, Column]:
    return {"beh": F.when(F.col("vec_id") % 2 == 0, -0.5).otherwise(0.5), "cont": ((F.col("vec_id") * 37) % 101).cast("double") / 101 - 0.5}


def frame(spark: SparkSession, sf: str) -> DataFrame:
    return model_frame(read_tables(spark, sf, "embeddings"), "vec_id", "label", "embedding", predictors())


def long(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    return cells(frame(spark, sf), *(keep or ("beh", "cont")))


EMB = """emb AS (
  SELECT vec_id AS row_id, label AS grp, CASE WHEN vec_id % 2 = 0 THEN -0.5e0 ELSE 0.5e0 END AS beh,
         CAST((vec_id * 37) % 101 AS DOUBLE) / 101e0 - 0.5e0 AS cont, embedding FROM embeddings
)"""
CELLS = EMB + """, cells AS (
  SELECT row_id, grp, beh, cont, CAST(i - 1 AS INTEGER) AS feature, CAST(embedding[i] AS DOUBLE) AS x FROM emb, unnest(range(1, 65)) AS t(i)
)"""


def corr_sql(x: str, y: str) -> str:
    return f"CASE WHEN count(*) > 1 AND var_pop({x}) > 0 AND var_pop({y}) > 0 THEN covar_pop({x}, {y}) / (sqrt(var_pop({x})) * sqrt(var_pop({y}))) END"


def z_sql(r: str) -> str:
    return f"coalesce(atanh(greatest(least({r}, 1 - 1e-15), -1 + 1e-15)), 0e0)"


def tidy_sql(x: str) -> str:
    return f"round({x}, 6) + 0e0"


#: z by group and feature for beh.
Z = CELLS + f""", z AS (SELECT grp, feature, {z_sql(corr_sql("x", "beh"))} AS z FROM cells GROUP BY grp, feature)"""
TMAP = Z + """, tmap AS (
  SELECT feature, count(*) AS n, avg(z) AS mean_z, CASE WHEN count(*) > 1 AND stddev_samp(z) > 0 THEN avg(z) / (stddev_samp(z) / sqrt(count(*))) END AS t FROM z GROUP BY feature
)"""


def p9_sql(t: str) -> str:
    """Two-tailed p for 9 degrees of freedom (ten subjects): the finite series written out."""
    th = f"atan(abs({t}) / 3e0)"
    return f"greatest(least(1 - 2 / pi() * ({th} + sin({th}) * (cos({th}) + 2e0 / 3 * pow(cos({th}), 3) + 8e0 / 15 * pow(cos({th}), 5) + 48e0 / 105 * pow(cos({th}), 7))), 1e0), 0e0)"


def _horner(coefficients, x: str) -> str:
    out = f"{coefficients[-1]!r}::DOUBLE"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def quantile_sql(p: str) -> str:
    """The normal quantile of the column p, strictly between 0 and 1."""
    q, r = f"({p} - 0.5e0)", f"sqrt(-ln(least({p}, 1 - {p})))"
    ratio = lambda a, b, x: f"{_horner(a, x)} / {_horner(b, x)}"
    mid = ratio(columns._A, columns._B, f"(0.180625e0 - {q} * {q})")
    near, far = ratio(columns._C, columns._D, f"({r} - 1.6e0)"), ratio(columns._E, columns._F, f"({r} - 5e0)")
    return f"CASE WHEN abs({q}) <= 0.425e0 THEN {q} * {mid} WHEN {r} <= 5 THEN sign({q}) * {near} ELSE sign({q}) * {far} END"


def one_sided_p_sql(t: str, df: str) -> str:
    """One-sided p of t for whole degrees of freedom of any number: terms of the finite series from gamma functions; half the two-tailed p and machine epsilon, turned for t > 0."""
    th = f"atan(abs({t}) / sqrt({df}))"
    odd = "2 * k * ln(2e0) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)"
    even = "lgamma(2 * k + 1) - 2 * lgamma(k + 1) - 2 * k * ln(2e0)"
    c2 = f"ln(cos({th}) * cos({th}))"
    terms = lambda c, m: f"(1 + coalesce(list_sum(list_transform(range(1, CAST({m} AS BIGINT) + 1), lambda k: exp({c} + k * {c2}))), 0))"
    inside = f"CASE WHEN {df} = 1 THEN 2 / pi() * {th} WHEN {df} % 2 = 1 THEN 2 / pi() * ({th} + sin({th}) * cos({th}) * {terms(odd, f'({df} - 3) // 2')}) ELSE sin({th}) * {terms(even, f'({df} - 2) // 2')} END"
    half = f"(greatest(least(1 - ({inside}), 1e0), 0e0) / 2 + 2.220446049250313e-16)"
    return f"CASE WHEN {t} > 0 THEN 1 - {half} ELSE {half} END"
