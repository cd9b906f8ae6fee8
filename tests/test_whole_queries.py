"""Queries over whole tables, against brute force on small fixtures."""

import numpy as np
import pytest

import __spark_entry__ as entry
from fieldstat.functions.lmm import fit_crossed

FEATURES = 64


@pytest.fixture(scope="module")
def trials(spark, tmp_path_factory):
    """Four subjects of 35 to 50 rows, and a folder with them as embeddings."""
    rng, path = np.random.default_rng(4), str(tmp_path_factory.mktemp("whole"))
    label = rng.permutation(np.repeat(np.arange(4), [35, 40, 45, 50]))
    i = np.arange(len(label))
    beh, cont = np.where(i % 2 == 0, -0.5, 0.5), (i * 37) % 101 / 101 - 0.5
    u = rng.standard_normal((4, 2, FEATURES))
    x = u[label, 0] + (1 + u[label, 1]) * beh[:, None] + rng.standard_normal((len(i), FEATURES))
    x = x.astype(np.float32)
    spark.createDataFrame([(int(k), v.tolist(), int(g)) for k, v, g in zip(i, x, label)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, label, beh, cont, x.astype(float)


def test_random_slopes_of_all_features(spark, trials):
    path, label, beh, cont, x = trials
    got = {}
    for r in entry.queries()["lmm_random_slope"](spark, path).collect():
        got.setdefault(r["feature"], {})[r["term"]] = (r["beta"], r["t"])
    assert sorted(got) == list(range(FEATURES))
    d = np.c_[np.ones(len(beh)), beh, cont, beh * cont]
    for f in range(FEATURES):
        want = fit_crossed(d, x[:, f], [(d[:, :2], label)])
        have = np.array(sorted(got[f].values()))
        assert np.allclose(have, sorted(zip(want.beta, want.t)), atol=2e-3, rtol=2e-3)


def test_random_intercepts_of_all_rows(spark, trials):
    path, label, _, _, x = trials
    got = {r["feature"]: r for r in entry.queries()["lmm_random_intercept"](spark, path).collect()}
    assert sorted(got) == list(range(FEATURES))
    one = np.ones((len(label), 1))
    for f in range(FEATURES):
        want = fit_crossed(one, x[:, f], [(one, label)])
        have = [got[f][k] for k in ("beta", "se", "var_resid", "var_group")]
        assert np.allclose(have, [want.beta[0], want.se[0], want.sigma2, want.cov[0][0, 0]], atol=1e-3, rtol=1e-3)


def test_shards_of_all_events(spark, tmp_path):
    rows = [(i, float(i) / 8) for i in range(1001)]
    spark.createDataFrame(rows, "event_id bigint, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r["run"], r["value"]) for r in entry.queries()["shard_union"](spark, str(tmp_path)).collect())
    assert got == sorted((0 if i == 0 else i % 4 + 1, v) for i, v in rows if i == 0 or i >= 4)


def test_random_intercepts_of_balanced_rows_have_a_closed_form(spark, tmp_path):
    rng = np.random.default_rng(8)
    label = np.repeat(np.arange(6), 20)
    x = (rng.standard_normal((6, FEATURES))[label] + rng.standard_normal((120, FEATURES))).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(x, label))], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["feature"]: r for r in entry.queries()["lmm_random_intercept"](spark, str(tmp_path)).collect()}
    y = x.astype(float).reshape(6, 20, FEATURES)
    between, within = 20 * y.mean(1).var(0, ddof=1), y.var(1, ddof=1).mean(0)
    for f in np.nonzero(between > within)[0]:
        r = got[f]
        assert np.allclose([r["beta"], r["se"], r["var_resid"], r["var_group"]], [y[:, :, f].mean(), np.sqrt(between[f] / 120), within[f], (between[f] - within[f]) / 20], atol=1e-4)
