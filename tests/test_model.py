import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstat.operators.clusters import Graph
from fieldstat.plans.model import FieldModel


def planted(spark, seed=42, subjects=6, obs=24, shape=(6, 10)):
    """Rows 2 and 3 of the grid follow beh; nothing follows beh2."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(subjects):
        beh = np.repeat([1.0, 0.0], obs // 2)
        y = rng.standard_normal((obs, *shape))
        y[:, 2:4, 1:9] += beh[:, None, None] * 4
        rows += [(s * obs + i, f"subj{s:02d}", float(beh[i]), float(rng.random()), y[i].ravel().tolist()) for i in range(obs)]
    signal = np.zeros(shape, bool)
    signal[2:4, 1:9] = True
    return spark.createDataFrame(rows, "row_id bigint, grp string, beh double, beh2 double, y array<double>"), signal.ravel()


def by_feature(df, term, col):
    return np.array([r[col] for r in df.filter(F.col("term") == term).orderBy("feature").collect()])


def test_permutations_find_the_planted_block(spark):
    df, signal = planted(spark)
    m = FieldModel(df, "val ~ beh + beh2 + (1|subj)", shape=(6, 10), feat_nboot=300)
    with pytest.raises(ValueError):
        m.p_features()
    m.run_perms(19)
    p, q, t = by_feature(m.p_features(), "beh", "p"), by_feature(m.p_features(), "beh2", "p"), by_feature(m.t_features(), "beh", "t")
    assert (p[signal] <= 0.11).mean() > 0.9 and (p[~signal] <= 0.11).mean() < 0.25 and (q > 0.11).all()
    assert np.abs(t[signal]).min() > np.abs(t[~signal]).max()
    assert {r["term"] for r in m.p_features(conj=["beh", "beh2"]).select("term").distinct().collect()} == {"beh&beh2"}
    with pytest.raises(ValueError):
        m.run_boots(2)


def test_bootstraps_find_the_planted_block(spark):
    df, signal = planted(spark, seed=1)
    m = FieldModel(df, "val ~ beh + beh2 + (1|subj)", shape=(6, 10), feat_nboot=300).run_boots(9)
    t = by_feature(m.t_features(), "beh", "t")
    assert np.median(t[signal]) > 5 * np.median(t[~signal]) + 1
    p = by_feature(m.p_features(), "beh", "p")
    assert (p[signal] <= 0.1).mean() > 0.9


def test_mask_and_enhancement(spark):
    df, signal = planted(spark, seed=2)
    mask = np.ones((6, 10), bool)
    mask[0] = mask[:, 0] = False
    m = FieldModel(df, "val ~ beh + beh2 + (1|subj)", shape=(6, 10), mask=mask, tfce=True, feat_nboot=200).run_perms(4)
    t = by_feature(m.t_features(), "beh", "t")
    assert len(t) == mask.sum()
    kept = signal[mask.ravel()]
    assert np.abs(t[kept]).min() > np.abs(t[~kept]).max()
    assert isinstance(m.graph, Graph) and set(m.t_terms().columns) == {"run", "term", "beta", "t"}


def test_permuted_correlations_match_numpy(spark):
    from fieldstat.operators.permuted import permuted_correlations
    from fieldstat.operators.resample import permutations

    df, _ = planted(spark, seed=3, subjects=3, obs=10, shape=(2, 3))
    perms = permutations(df, 2, seed=7)
    got = {(r["run"], r["grp"], r["feature"]): r["r"] for r in permuted_correlations(df, perms, ["beh"]).collect()}
    rows = {r["row_id"]: r for r in df.collect()}
    for run in range(3):
        for g in ("subj00", "subj02"):
            ps = [p for p in perms.collect() if p["run"] == run and p["grp"] == g]
            x = np.array([rows[p["src_row_id"]]["y"] for p in ps])
            a = np.array([rows[p["row_id"]]["beh"] for p in ps])
            for f in range(6):
                assert abs(got[run, g, f] - np.corrcoef(x[:, f], a)[0, 1]) < 1e-9
