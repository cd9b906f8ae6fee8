"""Several random terms from sums by level and pair of levels, against dense fits on the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstat.functions.levels import Structure
from fieldstat.functions.lmm import fit_crossed
from fieldstat.operators import mixed


def sums(x, y, factors):
    zz, zx, zy, pairs = [], [], [], {}
    for z, c in factors:
        k, q = c.max() + 1, z.shape[1]
        for out, v in ((zz, z[:, :, None] * z[:, None]), (zx, z[:, :, None] * x[:, None]), (zy, z * y[:, None])):
            a = np.zeros((k, *v.shape[1:]))
            np.add.at(a, c, v)
            out.append(a)
    for f, (z, c) in enumerate(factors):
        for g in range(f + 1, len(factors)):
            z2, c2 = factors[g]
            k = c2.max() + 1
            code, at = np.unique(c * k + c2, return_inverse=True)
            b = np.zeros((len(code), z.shape[1], z2.shape[1]))
            np.add.at(b, at, z[:, :, None] * z2[:, None])
            pairs[f, g] = (code // k, code % k, b)
    return zz, zx, zy, pairs


def case(seed, n, levels, widths, nested=False):
    rng = np.random.default_rng(seed)
    x = np.c_[np.ones(n), rng.standard_normal(n)]
    y, factors, c = x @ [1.0, 2.0] + rng.standard_normal(n), [], None
    for k, q in zip(levels, widths):
        c = c * k // (c.max() + 1) if nested and c is not None else rng.integers(0, k, n)
        c = np.unique(c, return_inverse=True)[1]
        z = np.c_[np.ones(n), rng.standard_normal((n, q - 1))]
        y = y + (z * rng.standard_normal((c.max() + 1, q))[c]).sum(1)
        factors.append((z, c))
    return x, y, factors


@pytest.mark.parametrize(
    ("n", "levels", "widths", "nested", "dense"),
    [(400, [10, 20], [1, 1], False, 1), (500, [30, 8], [2, 1], False, 1), (600, [60, 12, 4], [1, 1, 1], True, 0), (500, [12, 12, 9], [1, 2, 1], False, 2), (300, [7], [2], False, 0)],
)
def test_levels_equal_dense_fits(n, levels, widths, nested, dense):
    x, y, factors = case(n, n, levels, widths, nested)
    zz, zx, zy, pairs = sums(x, y, factors)
    s = Structure(zz, pairs)
    assert len(s.dense) == dense
    got, want = s.fit(zx, zy, x.T @ x, x.T @ y, float(y @ y), n), fit_crossed(x, y, factors)
    assert abs(got.loglik - want.loglik) < 1e-8
    assert np.allclose(got.beta, want.beta, rtol=1e-4) and np.allclose(got.se, want.se, rtol=1e-3) and np.isclose(got.sigma2, want.sigma2, rtol=1e-4)
    for a, b in zip(got.cov, want.cov):
        assert np.allclose(a, b, atol=2e-3)
    e = y - x @ got.beta - sum((z * m[c]).sum(1) for (z, c), m in zip(factors, got.modes))
    for (z, c), m, cov in zip(factors, got.modes, got.cov):  # the modes solve their own equations
        g = np.zeros_like(m)
        np.add.at(g, c, z * e[:, None])
        assert np.allclose(m, g @ cov / got.sigma2, atol=1e-8)
    again = s.fit(zx, zy, x.T @ x, x.T @ y, float(y @ y), n, start=got.theta)
    assert np.allclose(again.beta, got.beta, rtol=1e-4)


def test_nested_levels_of_any_number_fill_nothing_in():
    x, y, factors = case(3, 60_000, [20_000, 300], [1, 1], nested=True)
    zz, zx, zy, pairs = sums(x, y, factors)
    s = Structure(zz, pairs)
    assert not s.dense
    fit = s.fit(zx, zy, x.T @ x, x.T @ y, float(y @ y), len(y))
    assert np.allclose(fit.beta, [1, 2], atol=0.3) and abs(fit.sigma2 - 1) < 0.05 and abs(fit.cov[0][0, 0] - 1) < 0.1
    with pytest.raises(ValueError):
        Structure(*sums(*case(4, 2000, [60, 50], [1, 1]))[::3], most_dense=10)


def rows_of(spark, n=1500, subjects=9, items=14, bad=True):
    rng = np.random.default_rng(8)
    s, i, b = rng.integers(0, subjects, n), rng.integers(0, items, n), rng.standard_normal(n)
    y = 1 + 2 * b + rng.standard_normal(subjects)[s] + b * rng.standard_normal(subjects)[s] * 0.5 + rng.standard_normal(items)[i] + rng.standard_normal(n)
    rows = [(int(k % 2), f"s{s[k]}", int(i[k]), float(b[k]), float(y[k])) for k in range(n)]
    df = spark.createDataFrame(rows + ([(0, None, 1, 1.0, 1.0), (0, "s1", None, 1.0, 1.0), (0, "s1", 1, None, 1.0), (0, "s1", 1, 1.0, None)] if bad else []), "k int, subj string, item int, beh double, val double")
    return df, s, i, b, y


def test_crossed_models_of_rows(spark):
    df, s, i, b, y = rows_of(spark)
    x = np.c_[np.ones(len(b)), b]
    for formula, factors in {
        "val ~ beh + (1|subj) + (1|item)": [(x[:, :1], s), (x[:, :1], i)],
        "val ~ beh + (beh|subj) + (1|item)": [(x, s), (x[:, :1], i)],
        "val ~ beh + (1|subj) + (0+beh|subj)": [(x[:, :1], s), (x[:, 1:], s)],  # terms that share their levels
    }.items():
        got = {(r["k"], r["term"]): r for r in mixed.fit_models(df.filter("item IS NOT NULL"), formula, ["k"]).collect()}
        for k in (0, 1):
            at = np.arange(len(b)) % 2 == k
            want = fit_crossed(x[at], y[at], [(z[at], np.unique(c[at], return_inverse=True)[1]) for z, c in factors])
            for j, term in enumerate(("(Intercept)", "beh")):
                r = got[k, term]
                assert np.allclose([r["beta"], r["se"], r["var_resid"]], [want.beta[j], want.se[j], want.sigma2], rtol=2e-3) and abs(r["loglik"] - want.loglik) < 1e-6
            assert np.allclose(r["re_var"], [v for c in want.cov for v in np.diag(c)], rtol=0.02, atol=1e-3)
            if "(beh|subj) +" in formula:
                c = want.cov[0]
                assert r["re_cor_name"] == ["subj.(Intercept)~subj.beh"] and abs(r["re_cor"][0] - c[0, 1] / np.sqrt(c[0, 0] * c[1, 1])) < 0.01
            else:
                assert r["re_cor"] == []


def test_no_row_reaches_a_crossed_fit(spark):
    df, *_ = rows_of(spark, 4000)
    f = "val ~ beh + (1|subj) + (1|item)"
    rows = mixed.level_sums(df.dropna(), [], [F.lit(1.0), F.col("beh")], [[F.lit(1.0)], [F.lit(1.0)]], [F.col("subj"), F.col("item")], F.col("val"))
    assert rows.count() == 9 + 14 + 9 * 14
    plan = mixed.fit_models(df, f)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and plan.index("FlatMapGroupsInPandas") < plan.index("Aggregate")


def test_modes_and_residuals_of_rows(spark):
    df, s, i, b, y = rows_of(spark, 600)
    f = "val ~ beh + (beh|subj) + (1|item)"
    x = np.c_[np.ones(len(b)), b]
    got = mixed.residuals(df.withColumn("id", F.monotonically_increasing_id()), f, ["k"]).collect()
    assert len(got) == len(y)
    want = {}
    for k in (0, 1):
        at = np.arange(len(b)) % 2 == k
        factors = [(x[at], s[at]), (x[at][:, :1], i[at])]
        zz, zx, zy, pairs = sums(x[at], y[at], factors)
        fit = Structure(zz, pairs).fit(zx, zy, x[at].T @ x[at], x[at].T @ y[at], float(y[at] @ y[at]), int(at.sum()))
        hat = x[at] @ fit.beta + sum((z * m[c]).sum(1) for (z, c), m in zip(factors, fit.modes))
        want |= {float(v): (h, v - h) for h, v in zip(hat, y[at])}
        modes = {(r["grp"], r["level"], r["term"]): r["mode"] for r in mixed.random_modes(df, f, ["k"]).filter(F.col("k") == k).collect()}
        assert len(modes) == 9 * 2 + 14
        assert all(abs(modes["item", str(c), "(Intercept)"] - fit.modes[1][c, 0]) < 1e-3 for c in range(14))
    for r in got:
        assert np.allclose((r["fitted"], r["residual"]), want[r["val"]], atol=2e-3)
    whole = mixed.residuals(df.filter("beh IS NOT NULL"), "val ~ beh + (1|subj)")
    assert whole.columns == ["k", "subj", "item", "beh", "val", "fitted", "residual"] and abs(whole.agg(F.avg("residual")).first()[0]) < 0.01
    none = df.filter("k = 0").limit(2).withColumn("beh", F.lit(1.0))
    assert [r["term"] for r in mixed.fit_models(none, f).collect()] == [None] and mixed.residuals(none, f).filter("residual IS NOT NULL").count() == 0


def test_yields_of_batches(spark):
    """Known yields of six batches of five: intercept 1527.5, its error 19.383, variances 1764.05 and 2451.25, log-likelihood -159.827."""
    yields = {"A": (1545, 1440, 1440, 1520, 1580), "B": (1540, 1555, 1490, 1560, 1495), "C": (1595, 1550, 1605, 1510, 1560), "D": (1445, 1440, 1595, 1465, 1545), "E": (1595, 1630, 1515, 1635, 1625), "F": (1520, 1455, 1450, 1480, 1445)}
    df = spark.createDataFrame([(k, float(v)) for k, own in yields.items() for v in own], "batch string, yield double")
    r = mixed.fit_models(df, "yield ~ 1 + (1|batch)").first()
    assert np.allclose([r["beta"], r["se"], r["t"], r["loglik"], r["var_resid"], r["re_var"][0]], [1527.5, 19.38341215, 78.80449469, -159.8271384, 2451.25, 1764.05], rtol=1e-5) and r["re_cor"] == []
    m = mixed.random_modes(df, "yield ~ 1 + (1|batch)").agg(F.sum("mode")).first()[0]
    assert abs(m) < 1e-6


def subjects_of(spark, n=3000, subjects=400):
    """Many subjects of one to twenty rows, few items, two models of which one lacks an item."""
    rng = np.random.default_rng(12)
    s = np.minimum(rng.geometric(0.01, n), subjects)
    i, b = rng.integers(0, 4, n), rng.standard_normal(n)
    k = np.where(i == 3, 0, rng.integers(0, 2, n))
    y = 1 + 2 * b + rng.standard_normal(subjects + 1)[s] + (i - 1.5) * (1 + 0.5 * b) + rng.standard_normal(n)
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(k, s, i, b, y)], "k double, subj double, item double, beh double, val double").selectExpr("int(k) k", "int(subj) subj", "int(item) item", "beh", "val"), k, s, i, b, y


@pytest.mark.parametrize("formula", ["val ~ beh + (1|subj)", "val ~ beh + (1|subj) + (1|item)"])
def test_what_reaches_a_fit_does_not_grow_with_levels(spark, monkeypatch, formula):
    from pyspark.sql import GroupedData

    seen, apply = [], GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, *a: seen.append(self._df.count()) or apply(self, *a))
    for levels in (1500, 6000):
        df = spark.range(levels * 3).selectExpr(f"id % {levels} AS subj", "id % 5 AS item", "sin(id) AS beh", "sin(id) + cos(id * id) AS val")
        assert len(mixed.fit_models(df, formula).collect()) == 2
    assert seen == [2, 2]  # all rows, and the levels of three rows


def test_intercepts_summed_up_by_size_equal_dense_fits(spark):
    df, k, s, i, b, y = subjects_of(spark)
    f, x = "val ~ beh + (1|subj)", np.c_[np.ones(len(b)), b]
    got = {(r["k"], r["term"]): r for r in mixed.fit_models(df, f, ["k"]).collect()}
    modes = {(r["k"], r["grp"], r["level"], r["term"]): r["mode"] for r in mixed.random_modes(df, f, ["k"]).collect()}
    assert len(modes) == len(set(zip(k, s)))
    for m in (0, 1):
        at = k == m
        want = fit_crossed(x[at], y[at], [(x[at][:, :1], np.unique(s[at], return_inverse=True)[1])])
        for j, term in enumerate(("(Intercept)", "beh")):
            r = got[m, term]
            assert np.allclose([r["beta"], r["se"], r["var_resid"], r["re_var"][0]], [want.beta[j], want.se[j], want.sigma2, want.cov[0][0, 0]], rtol=1e-4) and abs(r["loglik"] - want.loglik) < 1e-6
    for r in mixed.residuals(df, f, ["k"]).groupBy("k", "subj").agg(F.sum("residual").alias("e")).collect():  # the modes solve their own equations
        own = got[r["k"], "beh"]
        assert abs(modes[r["k"], "subj", str(r["subj"]), "(Intercept)"] - own["re_var"][0] / own["var_resid"] * r["e"]) < 1e-8


@pytest.mark.parametrize("formula", ["val ~ beh + (1|subj) + (1|item)", "val ~ beh + (beh|item) + (1|subj)"])
def test_intercepts_summed_up_beside_other_terms(spark, monkeypatch, formula):
    df, *_ = subjects_of(spark)
    out = {}
    for few in (10, 10**9):  # summed up by size; all levels
        monkeypatch.setattr(mixed, "FEW_LEVELS", few)
        fits = {(r["k"], r["term"]): [r["beta"], r["se"], r["loglik"], r["var_resid"], *r["re_var"], *r["re_cor"]] for r in mixed.fit_models(df, formula, ["k"]).collect()}
        out[few] = fits, {(r["k"], r["grp"], r["level"], r["term"]): r["mode"] for r in mixed.random_modes(df, formula, ["k"]).collect()}
    for a, b in zip(out[10], out[10**9]):
        assert a.keys() == b.keys() and all(np.allclose(a[key], b[key], rtol=1e-3, atol=1e-4) for key in a)
    monkeypatch.setattr(mixed, "FEW_LEVELS", 10)
    none = df.withColumn("beh", F.lit(1.0))
    assert [r["term"] for r in mixed.fit_models(none, formula).collect()] == [None] and mixed.random_modes(none, formula).count() == 0
