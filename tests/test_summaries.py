"""Term summaries of components, errors of residuals, random points, appended logs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstat.operators import generate, linalg
from fieldstat.sources.ledger import RunLedger


def test_term_summaries_weigh_by_share(spark):
    s, beta, t = np.array([4.0, 2.0, 1.0]), np.array([[1.0, -2.0, 3.0], [0.5, 0.0, -1.0]]), np.array([[2.0, 1.0, 0.0], [1.0, 1.0, 7.0]])
    comps = spark.createDataFrame([(c, float(s[c]), f) for c in range(3) for f in range(4)], "comp int, s double, feature int")
    fits = spark.createDataFrame([(c, f"t{k}", float(beta[k, c]), float(t[k, c])) for k in range(2) for c in range(3)], "comp int, term string, beta double, t double")
    got = {r["term"]: (r["beta"], r["t"]) for r in linalg.term_summaries(comps, fits).collect()}
    for k in range(2):
        assert np.allclose(got[f"t{k}"], (beta[k] @ s / s.sum(), t[k] @ s / s.sum()))
    assert linalg.term_summaries(comps.limit(0), fits).count() == 0


def test_residual_errors(spark):
    df = spark.createDataFrame([(0, 9.0, 4.0), (1, 0.0, 4.0), (2, None, 1.0)], "feature int, rss double, mm double")
    got = {r["feature"]: r["sterr"] for r in linalg.residual_errors(df, F.col("mm"), 10).collect()}
    assert np.isclose(got[0], 2 * 3 / 3) and got[1] == 0 and got[2] is None
    assert np.isclose(linalg.residual_errors(df, 16.0, 10, 2).first()["sterr"], 4 * np.sqrt(9 / 8))


def test_random_points_are_drawn_with_replacement(spark):
    one = [r["feature"] for r in generate.random_points(spark, 0.5, (40, 50), seed=3).collect()]
    assert len(one) == len(set(one)) and all(0 <= f < 2000 for f in one)
    assert abs(len(one) / 2000 - (1 - np.exp(-0.5))) < 0.03  # repeated points count once
    assert set(one) == {r["feature"] for r in generate.random_points(spark, 0.5, (40, 50), seed=3).collect()}
    assert set(one) != {r["feature"] for r in generate.random_points(spark, 0.5, (40, 50), seed=4).collect()}
    assert generate.random_points(spark, 0.0, (4, 5)).count() == 0


def test_ledger_counts_whole_parts_alone(spark, tmp_path):
    ledger = RunLedger(spark, f"{tmp_path}/l", {"a": 1})
    assert ledger.next() == 0 and ledger.missing() == [] and ledger.read("run int").count() == 0
    ledger.ask(0, 4, 2)
    ledger.ask(5, 5, 2)
    assert ledger.missing() == [(0, 1, 0, 4), (2, 3, 0, 4), (4, 4, 0, 4), (5, 5, 5, 5)] and ledger.next() == 6
    ledger.write(spark.createDataFrame([(0,), (1,)], "run int"), 0, 1)
    ledger.write(spark.createDataFrame([(0,), (1,)], "run int"), 0, 1)  # the same part again
    again = RunLedger(spark, f"{tmp_path}/l", {"a": 1})
    assert again.committed() == [(0, 1)] and sorted(r[0] for r in again.read("run int").collect()) == [0, 1]
    assert again.missing()[0] == (2, 3, 0, 4)
    with pytest.raises(ValueError):
        RunLedger(spark, f"{tmp_path}/l", {"a": 2})
