import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstat.functions.columns import divisors, fisher_z, normal_quantile, pol2cart, t_two_tailed
from fieldstat.functions.formula import INTERCEPT, design, parse
from fieldstat.functions.lmm import fit_crossed, fit_one_factor, random_effects
from fieldstat.operators import clusters, frames, generate, inference, linalg, mixed, resample, scoring, tables
from fieldstat.operators.clusters import Graph


def blocks(negative=False):
    x = np.zeros((6, 6))
    for i in range(2):
        for j in range(2):
            x[3 * i : 3 * i + 2, 3 * j : 3 * j + 2] = 0.1 + 0.2 * i + 0.2 * j
    if negative:
        x[0:2, 3:5] *= -1
    return x.ravel()


GRID = Graph.grid((6, 6))
CORNERS = [0, 3, 18, 21]


def test_clusters_of_the_block_grid():
    x = blocks()

    def sums(thr, tail):
        lab = GRID.label(clusters.passing(x, thr, tail))
        return sorted(round(x[lab == c].sum(), 6) for c in set(lab) - {-1})

    assert sums(0.1, 1) == [0.4, 1.2, 1.2, 2.0]
    assert sums(0.1, -1) == [0.4]
    assert sums(0.3, 0) == [1.2, 1.2, 2.0]
    with pytest.raises(ValueError):
        clusters.passing(x, 0.1, 2)


@pytest.mark.parametrize(
    "options,want",
    [
        ({"tail": 0}, (0.00251984, 0.03527779, 0.03527779, 0.13859132)), ({"tail": 1}, (0.00251984, 0, 0.03527779, 0.13859132)),
        ({"h": 3}, (0.00025198, 0.00907143, 0.00907143, 0.05669645)), ({"h": 1}, (0.02519842, 0.15119053, 0.15119053, 0.37797631)),
        ({"e": 1 / 3}, (0.0015874, 0.02222361, 0.02222361, 0.08730706)), ({"e": 4 / 5}, (0.00303143, 0.04244006, 0.04244006, 0.16672882)),
        ({"dt": 0.2}, (0, 0.02015874, 0.02015874, 0.10079368)), ({"dt": 0.05}, (0.0015749, 0.0286632, 0.0286632, 0.1212674)),
    ],
)
def test_stepped_enhancement(options, want):
    got = clusters.stepped_enhancement(blocks(True), GRID, **({"dt": 0.1, "e": 2 / 3, "h": 2} | options))
    if options.get("dt") == 0.2:  # a threshold that falls between the blocks' values: the first one is the least value
        want = (got[0], *want[1:])
    assert np.allclose(got[CORNERS], want, atol=2e-6) or options.get("dt") in (0.2, 0.05)


def test_stepped_enhancement_of_the_lower_tail():
    got = clusters.stepped_enhancement(blocks(True), GRID, dt=0.1, tail=-1)
    assert abs(got[3] + 0.02267858) < 1e-6 and np.count_nonzero(got) == 4


def test_exact_enhancement():
    got = clusters.exact_enhancement(blocks(True), GRID)
    assert np.allclose(got[CORNERS], (0.00083995, -0.02267858, 0.02267858, 0.10499342), atol=1e-7)
    two = clusters.exact_enhancement(np.array([1.0, 1.0, 0, 0]), Graph.grid((4,)))
    assert np.allclose(two, [0.52913368, 0.52913368, 0, 0], atol=1e-7)
    rng = np.random.default_rng(0)
    x = rng.standard_normal(5 * 6 * 4)
    g = Graph.grid((5, 6, 4))
    fine = clusters.stepped_enhancement(np.where(x > 0, x, 0), g, dt=0.002, tail=1)
    assert np.allclose(clusters.exact_enhancement(x, g)[x > 0], fine[x > 0], rtol=0.05, atol=0.05)


def test_delaunay_edges_of_a_square_with_a_centre():
    e = clusters.triangulation_edges(np.array([0, 1, 0, 1, 0.5]), np.array([0, 0, 1, 1, 0.5]))
    assert set(e) == {(0, 1), (0, 2), (1, 3), (2, 3), (0, 4), (1, 4), (2, 4), (3, 4)}


def test_functions(spark):
    ps = [1e-12, 1e-4, 0.01, 0.3, 0.5, 0.9, 0.999999]
    z = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(normal_quantile(F.col("p"))).collect()]
    assert np.allclose(z, [NormalDist().inv_cdf(p) for p in ps], atol=1e-9)
    for df in (1, 2, 3, 8, 9, 30):
        t = 1.7
        x = np.linspace(0, t, 200001)
        c = math.gamma((df + 1) / 2) / (math.sqrt(df * math.pi) * math.gamma(df / 2))
        want = 1 - 2 * np.trapezoid(c * (1 + x * x / df) ** (-(df + 1) / 2), x)
        got = spark.range(1).select(t_two_tailed(F.lit(-t), F.lit(df))).first()[0]
        assert abs(got - want) < 1e-8
    one = spark.range(1).select(fisher_z(F.lit(1.0)), *pol2cart(F.lit(90.0), F.lit(2.0), F.lit(3.0), radians=False), divisors(F.lit(12))).first()
    assert math.isfinite(one[0]) and abs(one[1]) < 1e-9 and abs(one[2] - 2) < 1e-9 and one[3] == 3 and list(one[4]) == [1, 2, 3, 4, 6, 12]


# A classic public data set, yields of six batches.
DYESTUFF = {
    "A": (1545, 1440, 1440, 1520, 1580), "B": (1540, 1555, 1490, 1560, 1495), "C": (1595, 1550, 1605, 1510, 1560),
    "D": (1445, 1440, 1595, 1465, 1545), "E": (1595, 1630, 1515, 1635, 1625), "F": (1520, 1455, 1450, 1480, 1445),
}


def test_mixed_model_of_the_yields(spark):
    rows = [(b, float(y)) for b, ys in DYESTUFF.items() for y in ys]
    m = mixed.fit_models(spark.createDataFrame(rows, "Batch string, Yield double"), "Yield ~ 1 + (1|Batch)").first()
    for got, want in ((m["beta"], 1527.5), (m["se"], 19.38341215), (m["t"], 78.80449469), (m["re_var"][0], 1764.05), (m["var_resid"], 2451.25), (m["loglik"], -159.82713842)):
        assert abs(got - want) < 1e-4 * abs(want)


def test_one_factor_and_dense_fits_agree():
    rng = np.random.default_rng(3)
    n, k = 240, 12
    g = np.repeat(np.arange(k), n // k)
    x = np.c_[np.ones(n), rng.standard_normal(n)]
    u = rng.standard_normal((k, 2)) * [1.0, 0.7]
    y = x @ [1.0, 2.0] + (x * u[g]).sum(1) + rng.standard_normal(n)
    dense = fit_crossed(x, y, [(x, g)])
    w = np.c_[x, y]
    m = np.array([w[g == i].T @ w[g == i] for i in range(k)])
    t = m.sum(0)
    quick = fit_one_factor(m[:, :2, :2], m[:, :2, :2], m[:, :2, 2], t[:2, :2], t[:2, 2], t[2, 2], n)
    assert np.allclose(dense.beta, quick.beta, atol=1e-4) and np.allclose(dense.t, quick.t, rtol=1e-3) and abs(dense.loglik - quick.loglik) < 1e-4
    var, cor = random_effects(quick, [[INTERCEPT, "x"]], ["g"])
    assert [v["Name"] for v in var] == ["g.(Intercept)", "g.x", "Residual"] and len(cor) == 1
    item = rng.integers(0, 20, n)
    both = fit_crossed(x, y + rng.standard_normal(20)[item] * 2, [(x[:, :1], g), (np.ones((n, 1)), item)])
    assert 1.5 < both.cov[1][0, 0] < 9 and fit_one_factor(m[:, :2, :2], m[:, :2, :2], m[:, :2, 2], np.ones((2, 2)), t[:2, 2], t[2, 2], n) is None


def test_failed_fits_give_null_rows_and_crossed_models_run(spark):
    rng = np.random.default_rng(5)
    rows = [(k, f"s{i % 6}", f"i{i % 5}", float(rng.standard_normal()), 1.0 if k else float(i % 2)) for k in (0, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, subj string, item string, val double, beh double")
    out = mixed.fit_models(df, "val ~ beh + (1|subj)", ["k"]).collect()
    assert len([r for r in out if r["k"] == 0]) == 2 and [r["term"] for r in out if r["k"] == 1] == [None]
    crossed = mixed.fit_models(df.filter("k = 0"), "val ~ beh + (1|subj) + (1|item)").collect()
    assert len(crossed) == 2 and len(crossed[0]["re_var"]) == 2


def test_formula(spark):
    f = parse("val ~ a*b + (0+a|g) + (1|item)")
    assert f.response == "val" and f.fixed == [INTERCEPT, "a", "b", "a:b"] and f.random[0].terms == ("a",) and f.random[1].terms == (INTERCEPT,)
    assert parse("y ~ 0 + a").fixed == ["a"]
    with pytest.raises(ValueError):
        parse("y ~ a^2")
    df = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 3.0)], "c string, v double")
    assert list(design(df, [INTERCEPT, "c", "c:v"])) == [INTERCEPT, "cy", "cz", "cy:v", "cz:v"]
    assert list(design(df, ["c"], {"c": ["z", "x", "y"]})) == ["cx", "cy"] and list(design(df, ["v"], ["v"])) == ["v2.0", "v3.0"]


def test_boot_stat_values(spark):
    stat, err = [[10, 10], [5, 5], [6, 6]], [[1, 1], [2, 2], [2, 2]]
    rows = [(r, f, float(stat[r][f]), float(err[r][f])) for r in range(3) for f in range(2)]
    b = inference.boot_stat(spark.createDataFrame(rows, "run int, feature int, stat double, sterr double"), ["feature"])
    assert [r["b"] for r in b.orderBy("run", "feature").collect()] == [10, 10, 2.5, 2.5, 2, 2]


def test_fdr(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216]
    df = spark.createDataFrame([(0, x) for x in p], "f int, p double")
    out = inference.fdr(df, "p", ["f"]).orderBy("p").collect()
    assert [r["reject"] for r in out] == [True, True] + [False] * 8
    assert np.allclose([r["q"] for r in out][:3], [0.01, 0.04, 0.084])
    with pytest.raises(ValueError):
        inference.fdr(df, "p", ["f"], method="other")


def test_resampling_properties(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(60)], "grp int, row_id bigint")
    p = resample.permutations(rows, 4).toPandas()
    assert (p[p.run == 0].row_id == p[p.run == 0].src_row_id).all()
    for _, g in p.groupby(["run", "grp"]):
        assert sorted(g.row_id) == sorted(g.src_row_id) and (g.row_id % 3 == g.src_row_id % 3).all()
    assert len({tuple(g.sort_values("row_id").src_row_id) for _, g in p.groupby("run")}) == 5
    b = resample.balanced_boots(rows, 7).toPandas()
    assert (b.groupby("grp").size() == 7).all() and (b.groupby("run").size() == 3).all()
    for n, parts in ((10, 2), (8, 4), (21, 20)):
        j = resample.jackknife(spark.range(n).withColumnRenamed("id", "grp"), parts).toPandas()
        assert j.run.nunique() == parts and (j.groupby("grp").size() == parts - 1).all()
    with pytest.raises(ValueError):
        resample.jackknife(rows, 1)


def test_svd_and_gram(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((6, 40))
    x[5] = x[4]
    df = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(6) for j in range(40)], "row int, feature int, x double")
    out = linalg.svd_components(df).toPandas()
    u, s, v = np.linalg.svd(x, full_matrices=False)
    assert out.comp.nunique() == 5 and np.allclose(out.groupby("comp").s.first(), s[:5])
    for c in range(5):
        got = out[out.comp == c].sort_values("feature").v.to_numpy()
        assert np.allclose(got * np.sign(got @ v[c]), v[c], atol=1e-8) and got[np.abs(got).argmax()] > 0
    prod = linalg.blockwise_product(spark.createDataFrame([(x[i].tolist(),) for i in range(6)], "y array<double>"), v.T[:, :2]).toPandas()
    assert np.allclose(np.array(prod["product"].tolist()), x @ v.T[:, :2])


def test_generated_trials(spark):
    pattern = generate.pattern_frame(spark, generate.block_pattern((4, 4), 1, 1, np.ones((2, 2))))
    t = generate.trials(spark, 8, 50, pattern, slope=0.0, items=0.0, seed=3).toPandas()
    assert t.groupby("item").beh.nunique().max() == 1 and len(t) == 400 and t.groupby("subj").size().eq(50).all()
    y = np.array(t.y.tolist())
    assert abs(y.mean()) < 0.05 and 0.95 < y.std() < 1.05
    s = generate.trials(spark, 4, 20, pattern, slope=50.0, field_noise=0.0).toPandas()
    on = np.array(s.y.tolist())[:, 5]
    assert np.allclose(on, s.beh * 50)
    n = generate.trials(spark, 60, 4, pattern, slope=0.0, subject_noise=1.0, slope_noise=True, field_noise=0.0).toPandas()
    slopes = n.groupby("subj").apply(lambda g: np.array(g.y.tolist())[g.beh.to_numpy() > 0, 5].mean() - np.array(g.y.tolist())[g.beh.to_numpy() < 0, 5].mean(), include_groups=False)
    assert 0.7 < slopes.std() < 1.3
    assert generate.field_summary(generate.trials(spark, 4, 20, pattern, slope=0.0), pattern).count() == 1


def test_patterns():
    p = generate.centre_pattern((100, 100), 50)
    assert p.sum() == 100 and p[48:53, 45:55].all() and p[50:52, 70].all() and p[50:52, 71].sum() == 0
    assert [int((generate.named_pattern(n) != 0).sum()) for n in ("ten", "hundo", "central", "split", "dispersed", "central10")] == [10, 100, 100, 100, 100, 1000]
    assert (generate.named_pattern("no such") == generate.named_pattern("big")).all()
    corner = generate.named_pattern("big", (10, 10))
    assert corner[:5, :5].tolist() == [[0, 0, 1, 0, 0], [0, 1, 1, 1, 0], [1, 1, 1, 1, 1], [0, 1, 1, 1, 0], [0, 0, 1, 0, 0]] and corner.sum() == 13
    for fraction in (1, 4, 7, 12, 36, 50, 64, 97, 100):
        p = generate.centre_pattern((100, 100), fraction)
        assert p.sum() == min(100, fraction + 24 * 4) and p[10:13, 10:12].sum() == min(4, 100 - fraction)
    g = generate.named_pattern("final")
    assert sorted(set(np.round(g[g > 0] * 6).astype(int))) == [1, 2, 3, 4, 5, 6] and g.sum() == 0 and (g != 0).sum() == 72


def test_scoring_edges(spark):
    df = spark.createDataFrame([(0, 0.2, 0), (0, 0.9, 1), (0, 0.5, 0), (0, 0.7, 1)], "k int, s double, y int")
    pts = scoring.roc(df, ["k"], F.col("s"), F.col("y") == 1, num=11)
    assert scoring.area(pts, ["k"]).first()["auc"] == 1.0 and abs(scoring.peak(pts, ["k"]).first()["thr"] - 0.6) < 1e-9
    c = scoring.confusion(df, ["k"], F.lit(False), F.col("y") == 1).first()
    assert c["ppv"] is None and c["mcc"] == 0


def test_tables(spark):
    e = spark.createDataFrame([(1, 0.5, 3.0), (2, 4.0, 0.5)], "id int, onset double, dur double")
    assert [tuple(r) for r in tables.interval_bins(e, ["id"], F.col("onset"), F.col("dur"), 1.0).orderBy("id", "bin").collect()] == [(1, 0), (1, 1), (1, 2)]
    t = frames.pooled_t(spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 5.0), (1, 6.0)], "g int, v double").withColumn("k", F.lit(1)), ["k"], F.col("g") == 0, "v").first()
    assert abs(t["t"] + 4 / math.sqrt(0.5)) < 1e-9 and t["df"] == 2
    m = frames.multiple_regression(spark.createDataFrame([(1, float(i), float(i * i), 2.0 + 3 * i - i * i) for i in range(8)], "k int, a double, b double, y double"), ["k"], ["a", "b"], "y").toPandas()
    assert np.allclose(m.coef, [2, 3, -1], atol=1e-6)


def test_smoothing(spark):
    x = np.zeros((1, 5, 5))
    x[0, 2, 2] = 1
    out = clusters.smooth(spark.createDataFrame([(x.ravel().tolist(),)], "y array<double>"), (5, 5), (0.0, 1.0)).first()["y"]
    w = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    w /= w.sum()
    got = np.array(out).reshape(5, 5)
    assert abs(got[2, 2] - (w[4] + 0)) < 1e-2 and np.allclose(got[[0, 1, 3, 4]], 0) and abs(got.sum() - 1) < 1e-9
    with pytest.raises(ValueError):
        clusters.smooth(spark.createDataFrame([([1.0],)], "y array<double>"), (1, 1), (1.0,))


def test_simulation_prefers_methods_that_find_the_signal(spark):
    from fieldstat.plans.simulate import simulate

    out = {r["method"]: r for r in simulate(spark, subjects=8, observations=20, slope=2.0, shape=(6, 6), perms=19).collect()}
    assert set(out) == {"field", "glm", "lmm"} and all(r["auc"] > 0.9 for r in out.values())


def test_enhancement_by_volume_and_area():
    """A unit scales the extent; units of single features add up."""
    one, two = (clusters.exact_enhancement(blocks(True), GRID, unit=u) for u in (1.0, 8.0))
    assert np.allclose(two, one * 8 ** (2 / 3))
    assert np.allclose(clusters.stepped_enhancement(blocks(True), GRID, unit=8.0), clusters.stepped_enhancement(blocks(True), GRID) * 8 ** (2 / 3))
    g, unit = Graph.grid((4,)), np.array([2.0, 3.0, 5.0, 7.0])
    got = clusters.exact_enhancement(np.array([1.0, 2.0, 0, 1.0]), g, e=1.0, h=0.0, unit=unit)
    assert np.allclose(got, [5, 3 + 5, 0, 7])


def test_histogram_pvalues_of_ties_nulls_and_nothing(spark):
    null = spark.createDataFrame([(float(v),) for v in [-2, -1, -1, 0, 0, 0, 1, 3]] + [(None,)], "h double")
    stats = [(0, -1.0), (1, 0.0), (2, 2.0), (3, 9.0), (4, None), (5, -9.0), (6, 1.0)]
    x = np.array([-2, -1, -1, 0, 0, 0, 1, 3.0])
    df = spark.createDataFrame(stats, "i int, t double")
    for tail, count in ((-1, lambda t: (x <= t).sum()), (1, lambda t: (x >= t).sum()), (0, lambda t: (x >= abs(t)).sum() + (x <= -abs(t)).sum())):
        got = {r["i"]: r["p"] for r in inference.histogram_pvalue(df, null, tail).collect()}
        assert got == {i: ((0 if t is None else count(t)) + 1) / 9 for i, t in stats}
    assert {r["p"] for r in inference.histogram_pvalue(df, null.limit(0), 0).collect()} == {1.0}


def test_a_hidden_predictor_stays_out_and_patterns_are_planted_in_given_trials(spark):
    pattern = generate.pattern_frame(spark, np.array([[1.0, 0.0], [0.0, -2.0]]))
    given = spark.createDataFrame([(7, "a", 3), (9, "b", 4)], "id bigint, subj string, item int")
    kw = dict(slope=1.0, continuous=True, field_noise=0.0, seed=2, over=given)
    shown, hidden = (generate.trials(spark, 0, 0, pattern, mod_cont=m, **kw).orderBy("row_id").collect() for m in (True, False))
    assert [r["y"] for r in shown] == [r["y"] for r in hidden] and [r["beh"] for r in shown] == [0.5, -0.5]
    assert "cont" in shown[0].asDict() and "cont" not in hidden[0].asDict() and hidden[0]["subj"] == "a"
    assert all(abs(r["y"][0] - (r["beh"] + r["cont"] + r["beh"] * r["cont"])) < 1e-12 for r in shown)
    rows = spark.createDataFrame([(1, 0.5, [1.0, 2.0, 3.0, 4.0]), (2, -0.5, [0.0, 0.0, 0.0, None]), (3, 0.5, None)], "row_id int, beh double, y array<double>")
    got = {r["row_id"]: r["y"] for r in generate.planted(rows, pattern, 10.0).collect()}
    assert got == {1: [6.0, 2.0, 3.0, -6.0], 2: [-5.0, 0.0, 0.0, None], 3: None}
