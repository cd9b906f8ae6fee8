"""Decompositions of many rows, sums of arrays and Gram matrices, against dense ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstat.operators import linalg


def rows_of(spark, a, parts=5):
    return spark.createDataFrame([(x.tolist(),) for x in a], "y array<double>").repartition(parts)


def vectors(df, k, n):
    out, s = np.zeros((k, n)), np.zeros(k)
    for r in df.collect():
        out[r["comp"], r["feature"]], s[r["comp"]] = r["v"], r["s"]
    return out, s


@pytest.mark.parametrize(("rows", "cols", "k"), [(300, 12, 5), (40, 60, 6), (200, 30, 30), (7, 50, 10)])
def test_top_components_equal_numpy(spark, rows, cols, k):
    rng = np.random.default_rng(rows)
    a = rng.standard_normal((rows, min(rows, cols))) * 0.9 ** np.arange(min(rows, cols)) @ np.linalg.qr(rng.standard_normal((cols, cols)))[0][: min(rows, cols)]
    _, s, vh = np.linalg.svd(a, full_matrices=False)
    df = linalg.top_components(rows_of(spark, a), k)
    k = min(k, len(s))
    got, sizes = vectors(df, k, cols)
    assert np.allclose(sizes, s[:k], rtol=1e-6)
    assert np.allclose(got, vh[:k] * linalg.signed(vh[:k])[:, None], atol=1e-4)
    share = df.groupBy("comp").agg(F.max("share").alias("share")).orderBy("comp").collect()
    assert np.allclose([r["share"] for r in share], (s**2 / (s**2).sum())[:k], rtol=1e-5)


def test_awkward_rows(spark):
    a = np.array([[1.0, 2.0], [3.0, 4.0]])
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],), ([None, float("nan")],), (None,)], "y array<double>")
    got, s = vectors(linalg.top_components(df, 2), 2, 2)
    assert np.allclose(s, np.linalg.svd(a)[1]) and (got[np.arange(2), np.abs(got).argmax(1)] > 0).all()
    assert linalg.top_components(df.limit(0), 2).count() == 0
    zeros = spark.createDataFrame([([0.0, 0.0],)], "y array<double>")
    assert linalg.top_components(zeros, 2).count() == 0
    with pytest.raises(Exception, match="different lengths"):
        linalg.top_components(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "y array<double>"), 1).count()


def test_sums_of_arrays_meet_in_two_steps(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(-5, 5, (400, 3)).astype(float)
    df = spark.createDataFrame([(int(i % 3), v.tolist()) for i, v in enumerate(a)], "k int, m array<double>").repartition(20)
    got = {r["k"]: r["m"] for r in linalg.summed(df, "k", "m", fan=4).collect()}
    assert got == {k: a[k::3].sum(0).tolist() for k in range(3)}


def test_gram_matrix_of_partial_rows(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((6, 40))
    long = [(f"r{i}", j, float(a[i, j])) for i in range(6) for j in range(40) if (i + j) % 5]
    a[[[(i + j) % 5 == 0 for j in range(40)] for i in range(6)]] = 0
    df = spark.createDataFrame(long + [("r0", 0, None)], "row string, feature int, x double").repartition(7)
    got = {(r["a"], r["b"]): r["g"] for r in linalg.gram(df, "row", "feature", "x").collect()}
    want = a @ a.T
    assert len(got) == 36 and all(abs(got[f"r{i}", f"r{j}"] - want[i, j]) < 1e-9 for i in range(6) for j in range(6))
    c = linalg.svd_components(df)
    assert np.allclose(sorted({r["s"] for r in c.select("s").distinct().collect()}), np.sort(np.linalg.svd(a)[1]))
    with pytest.raises(ValueError):
        linalg.gram(df, "row", "feature", "x", most_rows=3)
