"""Runs of the whole analysis against plain versions on rows; appended, interrupted and resumed runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstat.functions.lmm import fit_crossed
from fieldstat.operators import resample
from fieldstat.plans.model import FieldModel, t_two_sided

SUBJECTS, ITEMS, FEATURES = 5, 4, 6
FORMULAS = {"val ~ beh + (1|subj)": (), "val ~ beh + (beh|subj) + (1|item)": ("item",)}


def trials(spark, seed=3, obs=16):
    rng = np.random.default_rng(seed)
    n = SUBJECTS * obs
    g, item = np.repeat(np.arange(SUBJECTS), obs), np.tile(np.arange(obs) % ITEMS, SUBJECTS)
    beh = rng.standard_normal(n)
    y = rng.standard_normal((n, FEATURES)) + rng.standard_normal((SUBJECTS, FEATURES))[g] + rng.standard_normal((ITEMS, FEATURES))[item]
    y[:, 1:4] += 1.5 * beh[:, None] * (1 + 0.3 * rng.standard_normal(SUBJECTS)[g][:, None])
    rows = [(i, f"s{g[i]}", f"i{item[i]}", float(beh[i]), y[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "row_id bigint, grp string, item string, beh double, y array<double>").repartition(3), g, item, beh, y


def plain_run(run, blocks, formula, total=None, seed=1, nboot=200, thresh=0.3):
    """blocks: of each subject (design column, items, responses as permuted). (beta, t, rss, mask, sum of singular values) by term and feature."""
    cube = np.array([[[np.corrcoef(y[:, f], b)[0, 1] for f in range(FEATURES)]] for b, _, y in blocks])
    z = np.arctanh(np.clip(cube, -1 + 1e-15, 1 - 1e-15))
    rng, n = np.random.Generator(np.random.PCG64([seed, run])), len(z)
    w = rng.multinomial(n, np.full(n, 1 / n), nboot) / n
    se = np.tensordot(w, z, (1, 0)).std(0)
    stable = t_two_sided(z.mean(0) / se, n - 1) < thresh
    m = np.where(stable, z, 0.0).reshape(-1, FEATURES)
    _, s, vh = np.linalg.svd(m, full_matrices=False)
    keep = s**2 > 1e-12 * (s**2).sum()
    s, vh = s[keep], vh[keep]
    vh = vh * np.where(vh[np.arange(len(vh)), np.abs(vh).argmax(1)] < 0, -1.0, 1.0)[:, None]
    b, item, y = (np.concatenate([x[i] for x in blocks]) for i in range(3))
    g = np.repeat(np.arange(len(blocks)), [len(x[0]) for x in blocks])
    x = np.c_[np.ones(len(b)), b]
    betas, ts, left = [], [], []
    for v in vh:
        e = y @ v
        factors = [(x, g), (x[:, :1], item)] if FORMULAS[formula] else [(x[:, :1], g)]
        f = fit_crossed(x, e, factors)
        betas.append(f.beta)
        ts.append(f.t)
        zs = np.concatenate([_columns(c, k) for c, k in factors], 1)
        cov = np.zeros((zs.shape[1],) * 2)
        at = 0
        for (c, k), own in zip(factors, f.cov):
            size = own.shape[0] * (k.max() + 1)
            cov[at : at + size, at : at + size] = np.kron(np.eye(k.max() + 1), own)
            at += size
        r = e - x @ f.beta
        left.append(r - zs @ (cov @ zs.T @ np.linalg.solve(zs @ cov @ zs.T + f.sigma2 * np.eye(len(e)), r)))
    betas, ts, left = np.array(betas), np.array(ts), np.array(left)
    rss = ((left.T @ (s[:, None] * vh)) ** 2).sum(0)
    return betas.T @ vh, ts.T @ (s[:, None] * vh), rss, stable.any(0), s.sum(), betas.T @ (s / (total or s.sum()))


def _columns(c, k):
    out = np.zeros((len(k), (k.max() + 1) * c.shape[1]))
    for j in range(c.shape[1]):
        out[np.arange(len(k)), k * c.shape[1] + j] = c[:, j]
    return out


def maps_of(m):
    out = {}
    for r in m.maps.collect():
        out.setdefault(r["run"], {})[r["term"], r["feature"]] = r
    return out


def same(rows, want, run, rss=False):
    beta, t, squares, mask, _, _ = want
    for i, term in enumerate(("(Intercept)", "beh")):
        for f in range(FEATURES):
            r = rows[term, f]
            assert np.isclose(r["beta"], beta[i, f], atol=2e-3, rtol=2e-3) and np.isclose(r["t"], t[i, f], atol=2e-2, rtol=2e-3) and r["mask"] == mask[f], (run, term, f, r, beta[i, f], t[i, f])
            if rss:
                assert np.isclose(r["rss"], squares[f], rtol=5e-3, atol=1e-3)


@pytest.mark.parametrize("formula", FORMULAS)
def test_permutations_equal_a_plain_version(spark, formula):
    df, g, item, beh, y = trials(spark)
    m = FieldModel(df, formula, feat_nboot=200, feat_thresh=0.3).run_perms(2)
    rows = maps_of(m)
    assert sorted(rows) == [0, 1, 2]
    perms, total = resample.permutations(df, [0, 1, 2]).collect(), None
    sums = {(r["run"], r["term"]): r["beta"] for r in m.summaries.collect()}
    for run in (0, 1, 2):
        src = {p["row_id"]: p["src_row_id"] for p in perms if p["run"] == run}
        met = np.array([src[i] for i in range(len(g))])
        blocks = [(beh[g == s], item[g == s], y[met[g == s]]) for s in range(SUBJECTS)]
        want = plain_run(run, blocks, formula, total)
        total = want[4] if total is None else total
        same(rows[run], want, run)
        assert np.allclose([sums[run, "(Intercept)"], sums[run, "beh"]], want[5], atol=2e-3)


@pytest.mark.parametrize("formula", FORMULAS)
def test_bootstraps_and_residual_errors_equal_a_plain_version(spark, formula):
    df, g, item, beh, y = trials(spark)
    m = FieldModel(df, formula, feat_nboot=200, feat_thresh=0.3).run_boots(3, inner=0)
    rows, masked, errors = maps_of(m), {}, {}
    assert sorted(rows) == [0, 1, 2, 3]
    drawn = resample.balanced_slots(SUBJECTS, 1, 3)
    for run in range(4):
        slots = np.arange(SUBJECTS) if run == 0 else drawn[run]
        blocks = [(beh[g == s], item[g == s], y[g == s]) for s in slots]
        want = plain_run(run, blocks, formula)
        same(rows[run], want, run, rss=True)
        masked[run] = np.where(want[3], want[0][1], 0.0)
        errors[run] = np.sqrt(beh @ beh) * np.sqrt(want[2] / (len(beh) - 1))
    t = {r["feature"]: r["t"] for r in m.t_features(["beh"]).collect()}
    b = [np.where(errors[k] > 0, np.abs((masked[k] - (masked[0] if k else 0)) / np.where(errors[k] > 0, errors[k], 1)), 0) for k in range(4)]
    assert np.allclose([t[f] for f in range(FEATURES)], b[0], rtol=1e-2, atol=1e-3)
    p, null = {r["feature"]: r["p"] for r in m.p_features(["beh"]).collect()}, np.array([x.max() for x in b])
    assert all(abs(p[f] - (null >= b[0][f] - 1e-9).mean()) < 1e-9 for f in range(FEATURES) if np.abs(null - b[0][f]).min() > 0.01 or np.argmax(b[0]) == f)
    with pytest.raises(ValueError):
        m.run_boots(1, inner=2)


class Table:
    """Rows of maps; sums added in another order may differ in their last digits."""

    def __init__(self, df):
        rows = sorted(df.collect(), key=lambda r: (r["run"], r["term"], r["feature"]))
        self.keys = [(r["run"], r["outer_id"], r["inner_id"], r["term"], r["feature"], r["mask"]) for r in rows]
        self.values = np.array([[r["beta"], r["t"]] for r in rows])

    def __eq__(self, other):
        return self.keys == other.keys and np.allclose(self.values, other.values, rtol=1e-4, atol=1e-5)


table = Table


def test_runs_are_added_to_earlier_ones(spark, tmp_path):
    df, *_ = trials(spark)
    make = lambda **kw: FieldModel(df, "val ~ beh + (1|subj)", feat_nboot=50, feat_thresh=0.5, **kw)
    whole = table(make().run_perms(5).maps)
    assert table(make().run_perms(3).run_perms(2).maps) == whole
    assert table(make(batch=2, ledger=f"{tmp_path}/a").run_perms(3).run_perms(2).maps) == whole
    again = make(batch=2, ledger=f"{tmp_path}/a").run_perms(0)  # a model made anew finds them
    assert table(again.maps) == whole and again.p_features().count() == FEATURES
    boots = table(make().run_boots(3, inner=2, balance=2).maps)
    assert table(make().run_boots(1, inner=2, balance=2).run_boots(2).maps) == boots
    with pytest.raises(ValueError, match="seed"):
        make().run_perms(1).run_perms(1, seed=2)
    with pytest.raises(ValueError, match="another model"):
        FieldModel(df, "val ~ beh + (beh|subj)", ledger=f"{tmp_path}/a").run_perms(1)
    table_of = resample.permutations(df, 4)
    given = make().run_perms(table_of.filter("run < 2")).run_perms(table_of.filter("run >= 2").unionByName(resample.permutations(df, [5])))
    assert table(given.maps) == whole
    with pytest.raises(ValueError, match="run 0"):
        make().run_perms(table_of.filter("run > 2"))


def test_an_interrupted_call_resumes(spark, tmp_path, monkeypatch):
    df, *_ = trials(spark)
    make = lambda ledger=None: FieldModel(df, "val ~ beh + (1|subj)", feat_nboot=50, feat_thresh=0.5, batch=2, ledger=ledger)
    whole, plain, done = table(make().run_perms(5).maps), FieldModel._fit, []

    def failing(self, r, perms, plan):
        if len(done) == 2:
            raise RuntimeError("lost")
        done.append(1)
        return plain(self, r, perms, plan)

    monkeypatch.setattr(FieldModel, "_fit", failing)
    with pytest.raises(RuntimeError):
        make(f"{tmp_path}/l").run_perms(5)
    spark.createDataFrame([(99,)], "run int").write.parquet(f"{tmp_path}/l/perms/parts/runs-00000004-00000005")  # a part cut off while it was written
    (tmp_path / "l/perms/parts/runs-00000004-00000005/_SUCCESS").unlink()
    done.clear()
    m = make(f"{tmp_path}/l")
    m._only("perms", 1, None)
    assert m.ledger.committed() == [(0, 1), (2, 3)] and m.ledger.missing() == [(4, 5, 0, 5)] and m.ledger.next() == 6
    assert table(m.resume().maps) == whole and len(done) == 1  # only what was missing was computed
    assert m.ledger.missing() == []


def test_slots_are_balanced():
    whole = resample.balanced_slots(7, 1, 30, seed=4, block=10)
    for first, last in ((1, 1), (2, 12), (13, 30)):
        assert all((whole[k] == v).all() for k, v in resample.balanced_slots(7, first, last, seed=4, block=10).items())
    for i in range(1, 31, 10):
        assert (np.bincount(np.concatenate([whole[k] for k in range(i, i + 10)]), minlength=7) == 10).all()
    for first, last in ((1, 6), (7, 19)):
        own = resample.balanced_slots(7, first, last)
        assert sorted(own) == list(range(first, last + 1)) and (np.bincount(np.concatenate(list(own.values())), minlength=7) == last - first + 1).all()
