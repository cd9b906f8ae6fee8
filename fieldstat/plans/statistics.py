"""Queries: group statistics, regressions and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import average_rank, clamp, divisors, normal_quantile, pol2cart, t_two_tailed, tidy
from ..operators import frames, linalg, scoring, tables
from ..operators.inference import fdr, stable_features
from ..operators.resample import balanced_boots
from ..sources.files import read_tables
from ..streaming.running import running_moments
from .catalogue import query
from .data import CELLS, FEATURES, TMAP, Z, corr_sql, frame, long, one_sided_p_sql, p9_sql, quantile_sql, tidy_sql


@query("group_corr_fisher_t", f"WITH {TMAP} SELECT feature, n, {tidy_sql('mean_z')} AS mean_z, {tidy_sql('t')} AS t FROM tmap")
def group_corr_fisher_t(spark, sf):
    """Correlation of each feature with the condition by subject, Fisher z, and a one-sample t over subjects."""
    r = frames.group_correlations(long(spark, sf, "beh"), ["beh"])
    return frames.fisher_t(r).select("feature", "n", tidy(F.col("mean_z")).alias("mean_z"), tidy(F.col("t")).alias("t"))


@query("group_correlations_two_terms", f"""WITH {CELLS}, r AS (SELECT grp, feature, {corr_sql('x', 'beh')} AS beh, {corr_sql('x', 'cont')} AS cont FROM cells GROUP BY grp, feature)
SELECT grp, feature, 'beh' AS term, {tidy_sql('beh')} AS r FROM r UNION ALL SELECT grp, feature, 'cont', {tidy_sql('cont')} FROM r""")
def group_correlations_two_terms(spark, sf):
    r = frames.group_correlations(long(spark, sf), ["beh", "cont"])
    return r.withColumn("r", tidy(F.col("r")))


@query("group_covariation_raw", f"""WITH {CELLS} SELECT grp, feature, {tidy_sql('covar_pop(x, beh) * count(*) / sqrt(var_pop(beh) * count(*))')} AS r FROM cells GROUP BY grp, feature""")
def group_covariation_raw(spark, sf):
    r = frames.group_correlations(long(spark, sf, "beh"), ["beh"], use_norm=False)
    return r.select("grp", "feature", tidy(F.col("r")).alias("r"))


@query("row_feature_mask", f"""WITH {CELLS} SELECT grp, feature, count(*) AS n, {tidy_sql('avg(x)')} AS mean_x FROM cells
WHERE row_id % 5 <> 0 AND feature // 8 BETWEEN 2 AND 5 GROUP BY grp, feature""")
def row_feature_mask(spark, sf):
    """Rows and features masked before anything is computed."""
    mask = spark.range(FEATURES).select(F.col("id").cast("int").alias("feature")).filter(F.floor(F.col("feature") / 8).between(2, 5))
    from .data import predictors

    rows = frames.model_frame(read_tables(spark, sf, "embeddings"), "vec_id", "label", "embedding", predictors(), row_mask=F.col("vec_id") % 5 != 0)
    return frames.cells(rows, features=mask).groupBy("grp", "feature").agg(F.count("*").alias("n"), tidy(F.avg("x")).alias("mean_x"))


@query("clamp_recode", """SELECT event_id, user_id AS subj, CASE WHEN event_type = 'click' THEN -1 ELSE 0 END AS cond, round(greatest(least(value, 100e0), -100e0), 6) + 0e0 AS val
FROM events WHERE event_type NOT IN ('error') AND event_type IN ('click', 'view', 'purchase') AND user_id % 2 = 0""")
def clamp_recode(spark, sf):
    """Conditions kept and left out, recoded, values clamped at 100."""
    e = read_tables(spark, sf, "events").filter(~F.col("event_type").isin("error") & F.col("event_type").isin("click", "view", "purchase")).filter("user_id % 2 = 0")
    return e.select("event_id", F.col("user_id").alias("subj"), F.when(F.col("event_type") == "click", -1).otherwise(0).alias("cond"), tidy(clamp(F.col("value"), 100)).alias("val"))


@query("parameterised_filter", "SELECT event_type, count(*) AS n FROM events WHERE user_id < 50 AND event_type IN ('view', 'click') GROUP BY event_type")
def parameterised_filter(spark, sf):
    return spark.sql("SELECT event_type, count(*) AS n FROM {e} WHERE user_id < :most AND event_type IN (:a, :b) GROUP BY event_type", args={"most": 50, "a": "view", "b": "click"}, e=read_tables(spark, sf, "events"))


@query("avg_rank_scaled", """WITH r AS (SELECT event_id, user_id, value, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2e0 AS rk, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, rk, round(CASE WHEN n > 1 THEN (rk - 1) / (n - 1) END, 6) AS scaled FROM r""")
def avg_rank_scaled(spark, sf):
    r = frames.scaled_ranks(read_tables(spark, sf, "events").select("event_id", "user_id", "value"), "value", ["user_id"])
    return r.select("event_id", "rk", F.round("scaled", 6).alias("scaled"))


@query("center_l2_norm", f"""WITH {CELLS}, s AS (SELECT grp, feature, avg(x) AS mu, sqrt(var_pop(x) * count(*)) AS len FROM cells GROUP BY grp, feature)
SELECT row_id, feature, {tidy_sql('CASE WHEN len > 0 THEN (x - mu) / len ELSE 0 END')} AS m FROM cells JOIN s USING (grp, feature)""")
def center_l2_norm(spark, sf):
    return frames.centred_unit(long(spark, sf, "beh")).select("row_id", "feature", tidy(F.col("m")).alias("m"))


@query("paired_condition_t", f"""WITH {CELLS}, d AS (SELECT grp, feature, avg(CASE WHEN beh = -0.5 THEN x END) - avg(CASE WHEN beh = 0.5 THEN x END) AS d FROM cells GROUP BY grp, feature)
SELECT feature, {tidy_sql('avg(d)')} AS mean_d, {tidy_sql('CASE WHEN count(*) > 1 AND stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END')} AS t FROM d GROUP BY feature""")
def paired_condition_t(spark, sf):
    from ..functions.columns import one_sample_t

    d = frames.condition_differences(long(spark, sf, "beh"), "beh", -0.5, 0.5)
    return d.groupBy("feature").agg(tidy(F.avg("d")).alias("mean_d"), tidy(one_sample_t("d")).alias("t"))


POOLED = f"""{CELLS}, s AS (SELECT feature, count(*) FILTER (beh < 0) AS na, count(*) FILTER (beh > 0) AS nb, avg(x) FILTER (beh < 0) AS ma, avg(x) FILTER (beh > 0) AS mb, var_samp(x) FILTER (beh < 0) AS va, var_samp(x) FILTER (beh > 0) AS vb FROM cells GROUP BY feature),
p AS (SELECT feature, na + nb - 2 AS df, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1e0 / na + 1e0 / nb)) AS t FROM s)"""


@query("pooled_t", f"WITH {POOLED} SELECT feature, df, {tidy_sql('t')} AS t FROM p")
def pooled_t(spark, sf):
    t = frames.pooled_t(long(spark, sf, "beh"), ["feature"], F.col("beh") < 0, "x")
    return t.select("feature", "df", tidy(F.col("t")).alias("t"))


@query("one_sided_z", f"WITH {POOLED}, o AS (SELECT feature, {one_sided_p_sql('t', 'df')} AS p FROM p) SELECT feature, {tidy_sql(quantile_sql('p'))} AS z FROM o")
def one_sided_z(spark, sf):
    """Normal deviates of one-sided p-values (also held against numerical integration in the tests)."""
    t = frames.pooled_t(long(spark, sf, "beh"), ["feature"], F.col("beh") < 0, "x")
    return t.select("feature", tidy(frames.one_sided_z(F.col("t"), F.col("df"))).alias("z"))


@query("student_p", f"WITH {TMAP} SELECT feature, {tidy_sql(p9_sql('t'))} AS p FROM tmap")
def student_p(spark, sf):
    t = frames.fisher_t(frames.group_correlations(long(spark, sf, "beh"), ["beh"]))
    return t.select("feature", tidy(t_two_tailed(F.col("t"), (F.col("n") - 1).cast("int"))).alias("p"))


@query("ols_per_group_feature", f"""WITH {CELLS} SELECT grp, feature, {tidy_sql('covar_pop(x, cont) / var_pop(cont)')} AS slope, {tidy_sql('avg(x) - covar_pop(x, cont) / var_pop(cont) * avg(cont)')} AS intercept FROM cells GROUP BY grp, feature""")
def ols_per_group_feature(spark, sf):
    m = frames.simple_regression(long(spark, sf, "cont"), ["grp", "feature"], "cont", "x")
    return m.select("grp", "feature", tidy(F.col("slope")).alias("slope"), tidy(F.col("intercept")).alias("intercept"))


@query("ols_lineitem", """SELECT l_returnflag, l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def ols_lineitem(spark, sf):
    m = frames.simple_regression(read_tables(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice")
    return m.select("l_returnflag", "l_linestatus", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@query("ols_multiple", """WITH c AS (SELECT l_returnflag AS f, l_quantity - avg(l_quantity) OVER g AS a, l_discount - avg(l_discount) OVER g AS b, l_tax - avg(l_tax) OVER g AS c, l_extendedprice - avg(l_extendedprice) OVER g AS y,
avg(l_quantity) OVER g AS ma, avg(l_discount) OVER g AS mb, avg(l_tax) OVER g AS mc, avg(l_extendedprice) OVER g AS my FROM lineitem WINDOW g AS (PARTITION BY l_returnflag)),
s AS (SELECT f, sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc, sum(a * y) AS ay, sum(b * y) AS by_, sum(c * y) AS cy, any_value(ma) AS ma, any_value(mb) AS mb, any_value(mc) AS mc, any_value(my) AS my FROM c GROUP BY f),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s),
k AS (SELECT f, my, ma, mb, mc, (ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / det AS ka,
(aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / det AS kb, (aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / det AS kc FROM d)
SELECT f AS l_returnflag, term, round(coef, 4) AS coef FROM (SELECT f, '(Intercept)' AS term, my - ka * ma - kb * mb - kc * mc AS coef FROM k UNION ALL SELECT f, 'l_quantity', ka FROM k UNION ALL SELECT f, 'l_discount', kb FROM k UNION ALL SELECT f, 'l_tax', kc FROM k)""")
def ols_multiple(spark, sf):
    """Least squares on several predictors by group, from cross products (held against a solver in the tests)."""
    m = frames.multiple_regression(read_tables(spark, sf, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return m.withColumn("coef", F.round("coef", 4))


@query("describe_moments", """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS var, round(stddev_samp(value), 6) AS sd, min(value) AS low, max(value) AS high FROM events GROUP BY event_type""")
def describe_moments(spark, sf):
    e = read_tables(spark, sf, "events")
    m = running_moments(e, ["event_type"], "value")
    s = e.groupBy("event_type").agg(F.stddev_samp("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))
    return m.join(s, "event_type").select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("var", 4).alias("var"), F.round("sd", 6).alias("sd"), "low", "high")


@query("group_keys", "SELECT DISTINCT user_id FROM events ORDER BY user_id")
def group_keys(spark, sf):
    return read_tables(spark, sf, "events").select("user_id").distinct().orderBy("user_id")


@query("histogram_mode", """WITH e AS (SELECT event_type, value, min(value) OVER (PARTITION BY event_type) AS lo, max(value) OVER (PARTITION BY event_type) AS hi FROM events),
k AS (SELECT event_type, lo, hi, least(floor((value - lo) / ((hi - lo) / 500)), 499) AS k, count(*) AS n FROM e GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, k) AS rk FROM k)
SELECT event_type, round(lo + k * (hi - lo) / 500, 6) AS mode FROM b WHERE rk = 1""")
def histogram_mode(spark, sf):
    m = tables.histogram_mode(read_tables(spark, sf, "events"), ["event_type"], "value")
    return m.select("event_type", F.round("mode", 6).alias("mode"))


FDR = TMAP + f", p AS (SELECT feature, {p9_sql('t')} AS p FROM tmap)"


def _fdr(spark, sf, method):
    p = frames.fisher_t(frames.group_correlations(long(spark, sf, "beh"), ["beh"])).select("term", "feature", t_two_tailed(F.col("t"), (F.col("n") - 1).cast("int")).alias("p"))
    return fdr(p, "p", ["term"], 0.2, method).select("feature", tidy(F.col("q")).alias("q"), "reject")


def _fdr_sql(c: str) -> str:
    return f"""WITH {FDR}, r AS (SELECT feature, p, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS n FROM p), c AS (SELECT *, {c} AS c FROM r),
q AS (SELECT feature, p, rk, n, c, least(min(p * n * c / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING), 1e0) AS q FROM c)
SELECT feature, {tidy_sql('q')} AS q, rk <= coalesce((SELECT max(rk) FROM q WHERE p < 0.2e0 * rk / (n * c)), 0) AS reject FROM q"""


@query("fdr_bh", _fdr_sql("1e0"))
def fdr_bh(spark, sf):
    return _fdr(spark, sf, "indep")


@query("fdr_by", _fdr_sql("list_sum(list_transform(range(1, n + 1), lambda i: 1e0 / i))"))
def fdr_by(spark, sf):
    return _fdr(spark, sf, "negcorr")


BOOTS = """g AS (SELECT DISTINCT label AS grp FROM embeddings), n AS (SELECT count(*) AS n FROM g),
o AS (SELECT grp, row_number() OVER (ORDER BY md5('3-' || c || '-' || grp), c, grp) - 1 AS pos FROM g, unnest(range(0, 200)) AS t(c)),
boots AS (SELECT CAST(pos // n + 1 AS INTEGER) AS run, grp FROM o, n)"""


@query("stable_features", f"""WITH {Z}, {BOOTS}, w AS (SELECT run, grp, count(*) AS w FROM boots GROUP BY run, grp),
m AS (SELECT feature, run, sum(w * z) / (SELECT n FROM n) AS m FROM z JOIN w USING (grp) GROUP BY feature, run),
s AS (SELECT feature, stddev_pop(m) AS se FROM m GROUP BY feature), a AS (SELECT feature, avg(z) AS mz FROM z GROUP BY feature),
p AS (SELECT feature, mz / se AS score, coalesce({p9_sql('(mz / se)')}, 1) AS p FROM a JOIN s USING (feature))
SELECT feature, {tidy_sql('score')} AS score, {tidy_sql('p')} AS p, p < 0.05 AS stable FROM p""")
def stable_features_query(spark, sf):
    from ..functions.columns import fisher_z

    r = frames.group_correlations(long(spark, sf, "beh"), ["beh"]).withColumn("z", F.coalesce(fisher_z(F.col("r")), F.lit(0.0)))
    boots = balanced_boots(frame(spark, sf).select("grp"), 200, seed=3)
    s = stable_features(r, boots)
    return s.select("feature", tidy(F.col("score")).alias("score"), tidy(F.col("p")).alias("p"), "stable")


RATES = """tp / nullif(tp + fn, 0) AS tpr, tn / nullif(fp + tn, 0) AS spc, tp / nullif(tp + fp, 0) AS ppv, tn / nullif(tn + fn, 0) AS npv, fp / nullif(fp + tn, 0) AS fpr,
fp / nullif(fp + tp, 0) AS fdr, fn / nullif(fn + tp, 0) AS fnr, (tp + tn) / (tp + tn + fp + fn) AS acc, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1,
(tp * tn - fp * fn) / CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 1e0 ELSE sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn) END AS mcc"""
COLS = ["tpr", "spc", "ppv", "npv", "fpr", "fdr", "fnr", "acc", "f1", "mcc"]


def _counts(hit: str, true: str) -> str:
    return ", ".join(f"CAST(count(*) FILTER ({a}({hit}) AND {b}({true})) AS DOUBLE) AS {n}" for n, a, b in (("tp", "", ""), ("fp", "", "NOT "), ("fn", "NOT ", ""), ("tn", "NOT ", "NOT ")))


def scored(spark, sf):
    return read_tables(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(read_tables(spark, sf, "labels"), "doc_id")


@query("confusion_terms", f"WITH c AS (SELECT lang, {_counts('n_chars > 1500', 'quality = 1')} FROM documents JOIN labels USING (doc_id) GROUP BY lang), r AS (SELECT lang, tp, fp, fn, tn, {RATES} FROM c) SELECT lang, tp, fp, fn, tn, {', '.join(f'round({c}, 6) + 0e0 AS {c}' for c in COLS)} FROM r")
def confusion_terms(spark, sf):
    c = scoring.confusion(scored(spark, sf), ["lang"], F.col("n_chars") > 1500, F.col("quality") == 1)
    return c.withColumns({k: tidy(F.col(k)) for k in COLS})


@query("map_agreement", f"WITH {CELLS}, m AS (SELECT row_id, CASE WHEN abs(x) > 0.1 THEN x ELSE 0 END AS a, CASE WHEN abs(lag_x) > 0.1 THEN lag_x ELSE 0 END AS b FROM (SELECT row_id, x, first_value(x) OVER (PARTITION BY grp, feature ORDER BY row_id) AS lag_x FROM cells)), c AS (SELECT row_id, {_counts('a <> 0', 'b <> 0')}, CAST(count(*) FILTER (sign(a) * sign(b) < 0) AS DOUBLE) AS s FROM m GROUP BY row_id), r AS (SELECT row_id, tp, fp, fn, tn, s, {RATES} FROM c) SELECT row_id, tp, fp, fn, tn, s, round(f1, 6) AS dice, round(mcc, 6) + 0e0 AS mcc FROM r")
def map_agreement(spark, sf):
    """Each trial's map against the first of its subject."""
    x = long(spark, sf, "beh")
    first = x.groupBy("grp", "feature").agg(F.min_by("x", "row_id").alias("y"))
    both = x.join(first, ["grp", "feature"])
    cut = lambda c: F.when(F.abs(c) > 0.1, F.col(c)).otherwise(0.0)
    return scoring.agreement(both, ["row_id"], cut("x"), cut("y")).withColumns({"dice": tidy(F.col("dice")), "mcc": tidy(F.col("mcc"))})


@query("pairwise_agreement", f"WITH {CELLS}, m AS (SELECT grp AS run, feature, CASE WHEN abs(avg(x)) > 0.02 THEN avg(x) ELSE 0 END AS v FROM cells GROUP BY grp, feature), c AS (SELECT a.run AS run_a, b.run AS run_b, {_counts('a.v <> 0', 'b.v <> 0')}, CAST(count(*) FILTER (sign(a.v) * sign(b.v) < 0) AS DOUBLE) AS s FROM m a JOIN m b USING (feature) WHERE a.run < b.run GROUP BY a.run, b.run), r AS (SELECT run_a, run_b, tp, fp, fn, tn, s, {RATES} FROM c) SELECT run_a, run_b, tp, fp, fn, tn, s, round(f1, 6) AS dice, round(mcc, 6) + 0e0 AS mcc FROM r")
def pairwise_agreement(spark, sf):
    m = long(spark, sf, "beh").groupBy(F.col("grp").alias("run"), "feature").agg(F.avg("x").alias("m"))
    m = m.withColumn("v", F.when(F.abs("m") > 0.02, F.col("m")).otherwise(0.0))
    return scoring.pairwise(m, "run", "feature", "v").withColumns({"dice": tidy(F.col("dice")), "mcc": tidy(F.col("mcc"))})


ROC = f"""s AS (SELECT lang, n_chars / 20000e0 AS score, quality = 1 AS y FROM documents JOIN labels USING (doc_id)),
thr AS (SELECT CASE WHEN i < 1000 THEN 0e0 + i * (1e0 / 999) ELSE 1e0 + 1e0 / 999 END AS thr FROM unnest(range(0, 1001)) AS t(i)),
c AS (SELECT lang, thr, {_counts('score >= thr', 'y')} FROM s, thr GROUP BY lang, thr), r AS (SELECT lang, thr, tp, fp, fn, tn, {RATES} FROM c)"""


def _roc(spark, sf):
    return scoring.roc(scored(spark, sf), ["lang"], F.col("n_chars") / 20000.0, F.col("quality") == 1)


@query("roc_auc", f"WITH {ROC}, p AS (SELECT lang, (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS part FROM r WINDOW w AS (PARTITION BY lang ORDER BY fpr, tpr)) SELECT lang, round(coalesce(sum(part), 0), 6) AS auc FROM p GROUP BY lang")
def roc_auc(spark, sf):
    return scoring.area(_roc(spark, sf), ["lang"]).withColumn("auc", tidy(F.col("auc")))


@query("peak_mcc", f"WITH {ROC}, p AS (SELECT lang, thr, mcc, row_number() OVER (PARTITION BY lang ORDER BY round(mcc, 9) DESC, thr) AS rk FROM r) SELECT lang, round(thr, 6) AS thr, round(mcc, 6) AS mcc FROM p WHERE rk = 1")
def peak_mcc(spark, sf):
    p = _roc(spark, sf).withColumn("mcc", F.round("mcc", 9))
    return scoring.peak(p, ["lang"]).select("lang", F.round("thr", 6).alias("thr"), F.round("mcc", 6).alias("mcc"))


@query("roc_points", f"WITH {ROC} SELECT lang, round(thr, 6) AS thr, tp, fp, fn, tn FROM r")
def roc_points(spark, sf):
    return _roc(spark, sf).select("lang", F.round("thr", 6).alias("thr"), "tp", "fp", "fn", "tn")


@query("error_rates", f"""WITH {CELLS}, b AS (SELECT feature, {corr_sql('x', 'beh')} AS beh, {corr_sql('x', 'cont')} AS cont FROM cells GROUP BY feature),
m AS (SELECT feature, 'beh' AS term, beh AS b, 0.01e0 AS p FROM b UNION ALL SELECT feature, 'cont', cont, 0.5e0 FROM b),
c AS (SELECT {_counts('p <= 1 - 0.05e0 AND abs(b) >= 0.05e0', 'feature < 32')} FROM m), r AS (SELECT tp, fp, fn, tn, {RATES} FROM c) SELECT round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM r""")
def error_rates(spark, sf):
    x = long(spark, sf).withColumn("grp", F.lit(0))
    maps = frames.group_correlations(x, ["beh", "cont"]).select("term", "feature", F.col("r").alias("b"))
    pvals = spark.createDataFrame([("beh", 0.01), ("cont", 0.5)], "term string, p double")
    truth = spark.range(FEATURES).select(F.col("id").cast("int").alias("feature"), F.when(F.col("id") < 32, 1.0).otherwise(0.0).alias("signal"))
    return scoring.error_rates(maps, pvals, truth, 0.05).select(tidy(F.col("tpr")).alias("tpr"), tidy(F.col("fpr")).alias("fpr"))


@query("polar_and_divisors", """SELECT event_id, round((event_id % 7) * cos(radians(value * 3.6e0)), 6) + 0e0 AS x, round((event_id % 7) * sin(radians(value * 3.6e0)), 6) + 0e0 AS y, value AS z,
array_to_string(list_filter(range(1, event_id % 24 + 2), lambda k: (event_id % 24 + 1) % k = 0), ' ') AS divisors FROM events""")
def polar_and_divisors(spark, sf):
    """Events placed on circles by their value, and the divisors of a number of each."""
    e = read_tables(spark, sf, "events")
    x, y, z = pol2cart(F.col("value") * 3.6, (F.col("event_id") % 7).cast("double"), F.col("value"), radians=False)
    number = (F.col("event_id") % 24 + 1).cast("int")
    p = e.select("event_id", x, y, z, F.array_join(F.transform(divisors(number), lambda v: v.cast("string")), " ").alias("divisors"))
    return p.withColumns({"x": tidy(F.col("x")), "y": tidy(F.col("y"))})


@query("rank_correlation", f"""WITH {CELLS}, r AS (SELECT grp, feature, beh, rank() OVER (PARTITION BY grp, feature ORDER BY x) + (count(*) OVER (PARTITION BY grp, feature, x) - 1) / 2e0 AS rx FROM cells)
SELECT grp, feature, {tidy_sql(corr_sql('rx', 'beh'))} AS r FROM r GROUP BY grp, feature""")
def rank_correlation(spark, sf):
    """Correlation of each feature's ranks with the condition."""
    from ..functions.columns import corr_guarded

    x = long(spark, sf, "beh").withColumn("rx", average_rank("x", ["grp", "feature"]))
    return x.groupBy("grp", "feature").agg(tidy(corr_guarded("rx", "beh")).alias("r"))


@query("gram_matrix", f"WITH {Z} SELECT a.grp AS a, b.grp AS b, {tidy_sql('sum(a.z * b.z)')} AS g FROM z a JOIN z b USING (feature) GROUP BY a.grp, b.grp")
def gram_matrix(spark, sf):
    from ..functions.columns import fisher_z

    z = frames.group_correlations(long(spark, sf, "beh"), ["beh"]).select("grp", "feature", F.coalesce(fisher_z(F.col("r")), F.lit(0.0)).alias("z"))
    return linalg.gram(z, "grp", "feature", "z").select("a", "b", tidy(F.col("g")).alias("g"))


@query("normal_quantiles", f"""WITH p AS (SELECT user_id, (count(*) FILTER (event_type = 'click') + 0.5e0) / (count(*) + 1) AS p FROM events GROUP BY user_id)
SELECT user_id, round(p, 9) AS p, {tidy_sql(quantile_sql('p'))} AS z FROM p""")
def normal_quantiles(spark, sf):
    """The normal deviate of each user's share of clicks, half a click added (the quantile is held against the standard library in the tests)."""
    share = (F.count(F.when(F.col("event_type") == "click", 1)) + 0.5) / (F.count("*") + 1)
    p = read_tables(spark, sf, "events").groupBy("user_id").agg(share.alias("p"))
    return p.select("user_id", F.round("p", 9).alias("p"), tidy(normal_quantile(F.col("p"))).alias("z"))


@query("roc_at_values", f"""WITH s AS (SELECT lang, n_chars AS thr, quality = 1 AS y FROM documents JOIN labels USING (doc_id)), a AS (SELECT lang, thr, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM s GROUP BY lang, thr)
SELECT lang, thr, CAST(sum(p) OVER w AS DOUBLE) AS tp, CAST(sum(n) OVER w AS DOUBLE) AS fp, CAST(sum(p) OVER (PARTITION BY lang) - sum(p) OVER w AS DOUBLE) AS fn, CAST(sum(n) OVER (PARTITION BY lang) - sum(n) OVER w AS DOUBLE) AS tn FROM a WINDOW w AS (PARTITION BY lang ORDER BY thr DESC)""")
def roc_at_values(spark, sf):
    return scoring.roc_at_values(scored(spark, sf), ["lang"], F.col("n_chars"), F.col("quality") == 1).select("lang", "thr", "tp", "fp", "fn", "tn")


@query("first_n", "SELECT page_id, url FROM pages ORDER BY url, page_id LIMIT 20")
def first_n(spark, sf):
    """The first of a sorted listing."""
    return read_tables(spark, sf, "pages").select("page_id", "url").orderBy("url", "page_id").limit(20)
