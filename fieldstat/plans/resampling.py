"""Queries: resampling and corrected p-values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import tidy
from ..operators import frames, inference, resample
from ..operators.permuted import permuted_correlations
from ..sources.files import read_tables
from .catalogue import query
from .data import CELLS, corr_sql, frame, long, one_sided_p_sql, quantile_sql, tidy_sql, z_sql

RUNS = 20


def _perm_sql(rows: str, runs: int, seed: int) -> str:
    return f"""base AS (SELECT run, grp, row_id FROM {rows}, unnest(range(0, {runs + 1})) AS t(run)),
place AS (SELECT *, row_number() OVER (PARTITION BY run, grp ORDER BY row_id) AS p FROM base),
mixed AS (SELECT run, grp, row_id AS src_row_id, row_number() OVER (PARTITION BY run, grp ORDER BY CASE WHEN run = 0 THEN lpad(CAST(row_id AS VARCHAR), 20, '0') ELSE md5('{seed}-' || run || '-' || row_id) END, row_id) AS p FROM base),
perms AS (SELECT CAST(run AS INTEGER) AS run, grp, row_id, src_row_id FROM place JOIN mixed USING (run, grp, p))"""


@query("perm_within_group", f"WITH ev AS (SELECT user_id AS grp, event_id AS row_id FROM events), {_perm_sql('ev', 5, 1)} SELECT run, grp, row_id, src_row_id FROM perms")
def perm_within_group(spark, sf):
    rows = read_tables(spark, sf, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("row_id"))
    return resample.permutations(rows, 5, seed=1)


G = "g AS (SELECT DISTINCT user_id AS grp FROM events)"


@query("balanced_boots", f"""WITH {G}, n AS (SELECT count(*) AS n FROM g), o AS (SELECT grp, row_number() OVER (ORDER BY md5('2-' || c || '-' || grp), c, grp) - 1 AS pos FROM g, unnest(range(0, 10)) AS t(c))
SELECT CAST(pos // n + 1 AS INTEGER) AS run, CAST(pos % n AS INTEGER) AS slot, grp FROM o, n""")
def balanced_boots(spark, sf):
    return resample.balanced_boots(read_tables(spark, sf, "events").select(F.col("user_id").alias("grp")), 10, seed=2)


@query("jackknife", f"""WITH {G}, p AS (SELECT grp, CAST((row_number() OVER (ORDER BY md5('4-' || grp), grp) - 1) % 7 + 1 AS INTEGER) AS part FROM g)
SELECT CAST(run AS INTEGER) AS run, grp FROM p, unnest(range(1, 8)) AS t(run) WHERE part <> run""")
def jackknife(spark, sf):
    return resample.jackknife(read_tables(spark, sf, "events").select(F.col("user_id").alias("grp")), 7, seed=4)


@query("stimulus_subsets", f"""WITH {G}, b AS (SELECT size, run, grp AS user_id FROM g, (VALUES (5), (20)) AS s(size), unnest(range(1, 4)) AS t(run)),
o AS (SELECT *, row_number() OVER (PARTITION BY size, run ORDER BY md5('6-' || size || '-' || run || '-' || user_id), user_id) AS place FROM b)
SELECT size, CAST(run AS INTEGER) AS run, user_id FROM o WHERE place <= size""")
def stimulus_subsets(spark, sf):
    return resample.subsets(read_tables(spark, sf, "events"), "user_id", [5, 20], 3, seed=6)


def _permuted(spark, sf):
    x = frame(spark, sf)
    r = permuted_correlations(x, resample.permutations(x, RUNS, seed=5), ["beh", "cont"])
    from ..functions.columns import fisher_z, one_sample_t

    z = r.withColumn("z", F.coalesce(fisher_z(F.col("r")), F.lit(0.0)))
    return z.groupBy("run", "term", "feature").agg(F.round(one_sample_t("z"), 6).alias("t"))


PERM = f"""{CELLS}, {_perm_sql('emb', RUNS, 5)}, px AS (SELECT p.run, e.grp, e.beh, e.cont, c.feature, c.x FROM perms p JOIN emb e ON e.row_id = p.row_id JOIN cells c ON c.row_id = p.src_row_id),
r AS (SELECT run, grp, feature, {z_sql(corr_sql('x', 'beh'))} AS beh, {z_sql(corr_sql('x', 'cont'))} AS cont FROM px GROUP BY run, grp, feature),
z AS (SELECT run, grp, feature, 'beh' AS term, beh AS z FROM r UNION ALL SELECT run, grp, feature, 'cont', cont FROM r),
tm AS (SELECT run, term, feature, round(CASE WHEN count(*) > 1 AND stddev_samp(z) > 0 THEN avg(z) / (stddev_samp(z) / sqrt(count(*))) END, 6) AS t FROM z GROUP BY run, term, feature),
mx AS (SELECT term, run, max(abs(t)) AS m FROM tm GROUP BY term, run),
p1 AS (SELECT tm.term, tm.run, feature, count(*) FILTER (m >= abs(t)) / CAST(count(*) AS DOUBLE) AS p FROM tm JOIN mx ON mx.term = tm.term GROUP BY tm.term, tm.run, feature)"""


@query("permuted_t_maps", f"WITH {PERM} SELECT run, term, feature, t + 0e0 AS t FROM tm")
def permuted_t_maps(spark, sf):
    return _permuted(spark, sf).withColumn("t", F.col("t") + 0.0)


@query("max_t_pvalues", f"WITH {PERM} SELECT term, feature, round(p, 6) AS p FROM p1 WHERE run = 0")
def max_t_pvalues(spark, sf):
    p = inference.max_stat_pvalues(_permuted(spark, sf), ["term"])
    return p.filter("run = 0").select("term", "feature", F.round("p", 6).alias("p"))


@query("min_p_two_stage", f"""WITH {PERM}, mn AS (SELECT run, min(p) AS m FROM p1 GROUP BY run)
SELECT term, feature, round(count(*) FILTER (m <= p) / CAST(count(*) AS DOUBLE), 6) AS p FROM p1, mn WHERE p1.run = 0 GROUP BY term, feature""")
def min_p_two_stage(spark, sf):
    return inference.two_stage_pvalues(_permuted(spark, sf)).withColumn("p", F.round("p", 6))


@query("conjunction_p", f"""WITH {PERM}, b AS (SELECT run, feature, max(p) AS p FROM p1 GROUP BY run, feature), mn AS (SELECT run, min(p) AS m FROM b GROUP BY run)
SELECT 'beh&cont' AS term, feature, round(count(*) FILTER (m <= p) / CAST(count(*) AS DOUBLE), 6) AS p FROM b, mn WHERE b.run = 0 GROUP BY feature""")
def conjunction_p(spark, sf):
    return inference.conjunction_pvalues(_permuted(spark, sf), ["beh", "cont"]).withColumn("p", F.round("p", 6))


@query("boot_stat", f"""WITH {CELLS}, s AS (SELECT grp AS run, feature, avg(x) AS stat, CASE WHEN feature = 3 THEN 0 ELSE stddev_samp(x) / sqrt(count(*)) END AS sterr FROM cells GROUP BY grp, feature),
f AS (SELECT feature, stat AS stat0 FROM s WHERE run = 0)
SELECT run, feature, {tidy_sql('CASE WHEN sterr <> 0 THEN abs((stat - CASE WHEN run = 0 THEN 0 ELSE stat0 END) / sterr) ELSE 0 END')} AS b FROM s JOIN f USING (feature)""")
def boot_stat(spark, sf):
    s = long(spark, sf, "beh").groupBy(F.col("grp").alias("run"), "feature").agg(F.avg("x").alias("stat"), (F.stddev_samp("x") / F.sqrt(F.count("*"))).alias("se"))
    s = s.withColumn("sterr", F.when(F.col("feature") == 3, 0.0).otherwise(F.col("se")))
    return inference.boot_stat(s, ["feature"]).select("run", "feature", tidy(F.col("b")).alias("b"))


HIST = "s AS (SELECT user_id, round(avg(value), 6) - 50 AS t FROM events GROUP BY user_id), h AS (SELECT value - 50 AS h FROM events)"


def _histogram(spark, sf, tail):
    e = read_tables(spark, sf, "events")
    s = e.groupBy("user_id").agg((F.round(F.avg("value"), 6) - 50).alias("t"))
    p = inference.histogram_pvalue(s, e.select((F.col("value") - 50).alias("h")), tail)
    return p.select("user_id", F.round("p", 6).alias("p"))


def _histogram_sql(count: str) -> str:
    return f"WITH {HIST} SELECT user_id, round(({count} + 1e0) / (count(*) + 1), 6) AS p FROM s, h GROUP BY user_id"


@query("histogram_pvalue_low", _histogram_sql("count(*) FILTER (h <= t)"))
def histogram_pvalue_low(spark, sf):
    return _histogram(spark, sf, -1)


@query("histogram_pvalue_high", _histogram_sql("count(*) FILTER (h >= t)"))
def histogram_pvalue_high(spark, sf):
    return _histogram(spark, sf, 1)


@query("histogram_pvalue_both", _histogram_sql("count(*) FILTER (h >= abs(t)) + count(*) FILTER (h <= -abs(t))"))
def histogram_pvalue_both(spark, sf):
    return _histogram(spark, sf, 0)


NESTED = f"{CELLS}, s AS (SELECT grp // 5 AS outer_id, grp % 5 AS inner_id, feature, avg(x) AS stat FROM cells GROUP BY grp, feature), o AS (SELECT outer_id, feature, stat AS s0 FROM s WHERE inner_id = 0), m AS (SELECT outer_id, feature, avg(stat) AS mean FROM s GROUP BY outer_id, feature)"


def _nested(spark, sf, groups):
    s = long(spark, sf, "beh").groupBy("grp", "feature").agg(F.avg("x").alias("stat"))
    s = s.select(F.floor(F.col("grp") / 5).cast("int").alias("outer_id"), (F.col("grp") % 5).alias("inner_id"), "feature", "stat")
    return inference.nested_standard_errors(s, ["feature"], groups).withColumns({"stat": tidy(F.col("stat")), "sterr": tidy(F.col("sterr"))})


@query("jackknife_error", f"WITH {NESTED} SELECT feature, CAST(outer_id AS INTEGER) AS outer_id, {tidy_sql('any_value(s0)')} AS stat, {tidy_sql('4e0 / 5 * sqrt(sum(CASE WHEN inner_id > 0 THEN (s0 - stat) * (s0 - stat) ELSE 0 END))')} AS sterr FROM s JOIN o USING (outer_id, feature) GROUP BY outer_id, feature")
def jackknife_error(spark, sf):
    return _nested(spark, sf, 10)


@query("nested_boot_error", f"WITH {NESTED} SELECT feature, CAST(outer_id AS INTEGER) AS outer_id, {tidy_sql('any_value(mean)')} AS stat, {tidy_sql('1e0 / 4 * sqrt(sum((mean - stat) * (mean - stat)))')} AS sterr FROM s JOIN m USING (outer_id, feature) GROUP BY outer_id, feature")
def nested_boot_error(spark, sf):
    return _nested(spark, sf, 3)


@query("boot_gather", f"""WITH g AS (SELECT DISTINCT label AS grp FROM embeddings), n AS (SELECT count(*) AS n FROM g), o AS (SELECT grp, row_number() OVER (ORDER BY md5('8-' || c || '-' || grp), c, grp) - 1 AS pos FROM g, unnest(range(0, 5)) AS t(c)),
boots AS (SELECT CAST(pos // n + 1 AS INTEGER) AS run, CAST(pos % n AS INTEGER) AS slot, grp FROM o, n), {CELLS}, m AS (SELECT grp, feature, avg(x) AS m FROM cells GROUP BY grp, feature)
SELECT run, feature, {tidy_sql('avg(m)')} AS mean, count(DISTINCT slot) AS slots FROM boots JOIN m USING (grp) GROUP BY run, feature""")
def boot_gather(spark, sf):
    """Group results gathered by resampled group, repeated groups as groups of their own."""
    boots = resample.balanced_boots(frame(spark, sf).select("grp"), 5, seed=8)
    m = long(spark, sf, "beh").groupBy("grp", "feature").agg(F.avg("x").alias("m"))
    return m.join(boots, "grp").groupBy("run", "feature").agg(tidy(F.avg("m")).alias("mean"), F.countDistinct("slot").alias("slots"))


def _two_samples(spark, sf):
    from ..operators.permuted import permutation_test

    x = frame(spark, sf).withColumn("side", (F.col("beh") < 0).cast("double"))
    return permutation_test(x, "side", 10, seed=12)


TWO_SAMPLES = f"""{CELLS}, flat AS (SELECT 0 AS grp, row_id FROM emb), {_perm_sql('flat', 10, 12)},
px AS (SELECT p.run, e.beh, c.feature, c.x FROM perms p JOIN emb e ON e.row_id = p.row_id JOIN cells c ON c.row_id = p.src_row_id),
s AS (SELECT run, feature, count(*) FILTER (beh < 0) AS na, count(*) FILTER (beh > 0) AS nb, avg(x) FILTER (beh < 0) AS ma, avg(x) FILTER (beh > 0) AS mb, var_samp(x) FILTER (beh < 0) AS va, var_samp(x) FILTER (beh > 0) AS vb FROM px GROUP BY run, feature),
u AS (SELECT run, feature, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1e0 / na + 1e0 / nb)) AS t, CAST(na + nb - 2 AS INTEGER) AS df FROM s)"""


@query("permutation_test", f"WITH {TWO_SAMPLES} SELECT run, feature, {tidy_sql('t')} AS t, df FROM u")
def permutation_test_query(spark, sf):
    """Two samples dealt anew over all rows."""
    return _two_samples(spark, sf).select("run", "feature", tidy(F.col("t")).alias("t"), "df")


@query("permutation_test_z", f"WITH {TWO_SAMPLES}, o AS (SELECT run, feature, {one_sided_p_sql('t', 'df')} AS p FROM u) SELECT run, feature, {tidy_sql(quantile_sql('p'))} AS z FROM o")
def permutation_test_z(spark, sf):
    return _two_samples(spark, sf).select("run", "feature", tidy(F.col("z")).alias("z"))
