"""Queries: clusters, enhancement, decomposition, mixed models and the whole analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import fisher_z, tidy
from ..operators import clusters, frames, linalg, mixed
from ..operators.bands import enhance_large
from ..sources.files import read_tables
from .catalogue import ORACLE, query
from .data import CELLS, FEATURES, SHAPE, Z, frame, long, tidy_sql
from .model import FieldModel

GRID = """edges AS (SELECT CAST(i AS INTEGER) AS src, CAST(i + 1 AS INTEGER) AS dst FROM unnest(range(0, 64)) AS t(i) WHERE i % 8 < 7
UNION ALL SELECT CAST(i AS INTEGER), CAST(i + 8 AS INTEGER) FROM unnest(range(0, 56)) AS t(i)), near AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"""
MAPS = CELLS + ", maps AS (SELECT grp, feature, avg(x) * 10 AS x FROM cells GROUP BY grp, feature)"


def _maps(spark, sf):
    return long(spark, sf, "beh").groupBy("grp", "feature").agg((F.avg("x") * 10).alias("x"))


def _steps(maps, edges):
    """(grp, src, dst, step): how much a map falls along each edge."""
    a, b = maps.select("grp", F.col("feature").alias("src"), F.col("x").alias("xa")), maps.select("grp", F.col("feature").alias("dst"), F.col("x").alias("xb"))
    return a.join(edges, "src").join(b, ["grp", "dst"]).select("grp", "src", "dst", tidy(F.col("xa") - F.col("xb")).alias("step"))


def _steps_sql(edges: str) -> str:
    return f"SELECT a.grp, src, dst, {tidy_sql('a.x - b.x')} AS step FROM {edges} JOIN maps a ON a.feature = src JOIN maps b ON b.feature = dst AND b.grp = a.grp"


@query("grid_edges", f"WITH {GRID}, {MAPS} {_steps_sql('edges')}")
def grid_edges(spark, sf):
    """Each subject's map along the edges of the grid."""
    return _steps(_maps(spark, sf), clusters.grid_edges(spark, SHAPE))


@query("path_and_product_edges", f"""WITH {GRID}, {MAPS}, p AS (SELECT CAST(i AS INTEGER) AS src, CAST(i + 1 AS INTEGER) AS dst FROM unnest(range(0, 7)) AS t(i))
SELECT 'grid' AS kind, * FROM ({_steps_sql('edges')}) UNION ALL SELECT 'path', * FROM ({_steps_sql('p')})""")
def path_and_product_edges(spark, sf):
    """Each subject's map along a path, and along the grid that is the product of two paths."""
    p, maps = clusters.path_edges(spark, 8), _maps(spark, sf)
    grid, path = _steps(maps, clusters.product_edges([p, p], [8, 8])), _steps(maps, p)
    return grid.select(F.lit("grid").alias("kind"), "*").union(path.select(F.lit("path"), "*"))


@query("masked_edges", f"WITH {GRID}, {MAPS}, keep AS (SELECT feature FROM maps GROUP BY feature HAVING avg(x) > 0), inside AS (SELECT src, dst FROM edges WHERE src IN (FROM keep) AND dst IN (FROM keep)) {_steps_sql('inside')}")
def masked_edges(spark, sf):
    """Edges among the features whose mean over subjects is positive."""
    maps = _maps(spark, sf)
    keep = maps.groupBy("feature").agg(F.avg("x").alias("m")).filter("m > 0").select("feature")
    return _steps(maps, clusters.inside(clusters.grid_edges(spark, SHAPE), keep))


LABELS = f"""WITH RECURSIVE {GRID}, {MAPS}, n AS (SELECT grp, feature, x FROM maps WHERE abs(x) >= 0.2e0),
reach AS (SELECT grp, feature, feature AS lab FROM n UNION SELECT r.grp, e.dst, r.lab FROM reach r JOIN near e ON e.src = r.feature JOIN n ON n.grp = r.grp AND n.feature = e.dst),
lab AS (SELECT grp, feature, min(lab) AS cluster FROM reach GROUP BY grp, feature),
c AS (SELECT grp, cluster, CAST(count(*) AS INTEGER) AS size, sum(x) AS total FROM lab JOIN maps USING (grp, feature) GROUP BY grp, cluster)"""


@query("cluster_label_sum", f"{LABELS} SELECT grp, feature, cluster, size, {tidy_sql('total')} AS total FROM lab JOIN c USING (grp, cluster)")
def cluster_label_sum(spark, sf):
    c = clusters.find_clusters(_maps(spark, sf), ["grp"], clusters.Graph.grid(SHAPE), 0.2, 0)
    return c.withColumn("total", tidy(F.col("total")))


@query("cluster_size_lookup", f"{LABELS} SELECT grp, cluster, size, round(1e0 / (1 + least(size, 5)), 6) AS p FROM c")
def cluster_size_lookup(spark, sf):
    c = clusters.find_clusters(_maps(spark, sf), ["grp"], clusters.Graph.grid(SHAPE), 0.2, 0).select("grp", "cluster", "size").distinct()
    table = spark.range(1, 6).select(F.col("id").cast("int").alias("size"), F.round(1 / (1 + F.col("id")), 6).alias("p"))
    return clusters.sized_pvalues(c, table)


@query("tfce_exact", f"""WITH RECURSIVE {GRID}, {MAPS}, s AS (SELECT grp, feature, x * sg AS x, sg FROM maps, (VALUES (1), (-1)) AS v(sg) WHERE x * sg > 0),
l AS (SELECT grp, sg, x AS lev, lag(x, 1, 0) OVER (PARTITION BY grp, sg ORDER BY x) AS below FROM (SELECT DISTINCT grp, sg, x FROM s)),
n AS (SELECT l.grp, l.sg, lev, below, feature FROM l JOIN s ON s.grp = l.grp AND s.sg = l.sg AND s.x >= lev),
reach AS (SELECT grp, sg, lev, feature, feature AS lab FROM n UNION SELECT r.grp, r.sg, r.lev, e.dst, r.lab FROM reach r JOIN near e ON e.src = r.feature JOIN n ON n.grp = r.grp AND n.sg = r.sg AND n.lev = r.lev AND n.feature = e.dst),
lab AS (SELECT grp, sg, lev, feature, min(lab) AS c FROM reach GROUP BY ALL), sz AS (SELECT grp, sg, lev, c, count(*) AS k FROM lab GROUP BY ALL),
v AS (SELECT lab.grp, lab.feature, sum(lab.sg * pow(k, 2e0 / 3) * (pow(lab.lev, 3) - pow(below, 3)) / 3) AS tfce FROM lab JOIN sz USING (grp, sg, lev, c) JOIN l USING (grp, sg, lev) GROUP BY ALL)
SELECT grp, feature, {tidy_sql('coalesce(tfce, 0)')} AS tfce FROM maps LEFT JOIN v USING (grp, feature)""")
def tfce_exact(spark, sf):
    return clusters.enhance(_maps(spark, sf), ["grp"], clusters.Graph.grid(SHAPE), e=2 / 3, h=2.0).withColumn("tfce", tidy(F.col("tfce")))


@query("tfce_bands", None)
def tfce_bands(spark, sf):
    """As tfce_exact, a band of heights at a time."""
    return enhance_large(_maps(spark, sf), ["grp"], clusters.grid_edges(spark, SHAPE), bands=3).withColumn("tfce", tidy(F.col("tfce")))


ORACLE["tfce_bands"] = ORACLE["tfce_exact"]


@query("tfce_step", f"""WITH RECURSIVE {GRID}, {MAPS}, s AS (SELECT grp, feature, abs(x) AS x FROM maps), m AS (SELECT grp, min(x) FILTER (x > 0) AS lo, max(x) AS hi FROM s GROUP BY grp),
l AS (SELECT grp, i, lo + i * 0.05e0 AS lev FROM m, unnest(range(0, 1000)) AS t(i) WHERE i < ceil((hi + 0.05e0 - lo) / 0.05e0)),
n AS (SELECT l.grp, i, lev, feature FROM l JOIN s ON s.grp = l.grp AND s.x >= lev),
reach AS (SELECT grp, i, feature, feature AS lab FROM n UNION SELECT r.grp, r.i, e.dst, r.lab FROM reach r JOIN near e ON e.src = r.feature JOIN n ON n.grp = r.grp AND n.i = r.i AND n.feature = e.dst),
lab AS (SELECT grp, i, feature, min(lab) AS c FROM reach GROUP BY ALL), sz AS (SELECT grp, i, c, count(*) AS k FROM lab GROUP BY ALL),
v AS (SELECT grp, feature, sum(pow(k, 2e0 / 3) * pow(lev, 2) * 0.05e0) AS tfce FROM lab JOIN sz USING (grp, i, c) JOIN l USING (grp, i) GROUP BY ALL)
SELECT grp, feature, {tidy_sql('coalesce(tfce, 0)')} AS tfce FROM maps LEFT JOIN v USING (grp, feature)""")
def tfce_step(spark, sf):
    return clusters.enhance(_maps(spark, sf), ["grp"], clusters.Graph.grid(SHAPE), exact=False, dt=0.05, e=2 / 3, h=2.0, tail=0).withColumn("tfce", tidy(F.col("tfce")))


def _z(spark, sf):
    z = frames.group_correlations(long(spark, sf, "beh"), ["beh"])
    return z.select(F.col("grp").alias("row"), "feature", F.coalesce(fisher_z(F.col("r")), F.lit(0.0)).alias("x"))


@query("svd_components")
def svd_components(spark, sf):
    """Components of the subjects' z maps (held against a dense decomposition in the tests)."""
    return linalg.svd_components(_z(spark, sf)).withColumns({c: tidy(F.col(c)) for c in ("s", "share", "v")})


@query("svd_total", f"""WITH {CELLS}, r AS (SELECT grp, feature, coalesce(atanh(covar_pop(x, beh) / sqrt(var_pop(x) * var_pop(beh))), 0e0) AS z FROM cells GROUP BY grp, feature) SELECT {tidy_sql('sum(z * z)')} AS total FROM r""")
def svd_total(spark, sf):
    """Squared singular values add up to the matrix's sum of squares."""
    c = linalg.svd_components(_z(spark, sf)).select("comp", "s").distinct()
    return c.agg(tidy(F.sum(F.col("s") * F.col("s"))).alias("total"))


@query("backproject", f"""WITH {Z}, g AS (SELECT a.grp AS a, b.grp AS b, sum(a.z * b.z) AS g FROM z a JOIN z b USING (feature) GROUP BY a.grp, b.grp),
m AS (SELECT g.b AS grp, z.feature, sum(g * z.z) AS t FROM g JOIN z ON z.grp = g.a GROUP BY g.b, z.feature)
SELECT CAST(grp AS VARCHAR) AS term, feature, {tidy_sql('z')} AS beta, {tidy_sql('t')} AS t FROM z JOIN m USING (grp, feature)""")
def backproject(spark, sf):
    """Each subject's map from its loadings: as beta they give the map back, times s as t the map times the matrix's cross product, whatever the signs."""
    z = _z(spark, sf)
    c = linalg.svd_components(z)
    fits = c.join(z, "feature").groupBy("comp", "s", F.col("row").cast("string").alias("term")).agg(F.sum(F.col("x") * F.col("v")).alias("beta"))
    fits = fits.select("comp", "term", "beta", (F.col("beta") * F.col("s")).alias("t"))
    return linalg.backproject(c, fits).withColumns({"beta": tidy(F.col("beta")), "t": tidy(F.col("t"))})


@query("svd_trials")
def svd_trials(spark, sf):
    """The eight largest components of all trials, whatever their number, by block iteration (held against a dense decomposition in the tests)."""
    c = linalg.top_components(frame(spark, sf).select("y"), 8)
    return c.withColumns({"s": tidy(F.col("s"), 4), "share": tidy(F.col("share")), "v": tidy(F.col("v"), 4)})


@query("svd_trials_total", f"WITH {CELLS} SELECT {tidy_sql('sum(x * x)')} AS total FROM cells")
def svd_trials_total(spark, sf):
    """All squared singular values of the trials add up to the sum of squares."""
    c = linalg.top_components(frame(spark, sf).select("y"), FEATURES).select("comp", "s").distinct()
    return c.agg(tidy(F.sum(F.col("s") * F.col("s"))).alias("total"))


@query("lmm_random_intercept")
def lmm_random_intercept(spark, sf):
    """One mixed model for each feature on all rows of every subject, however many each has (held against dense fits, and the closed form of balanced data, in the tests)."""
    m = mixed.fit_models(long(spark, sf, "beh"), "x ~ 1 + (1|grp)", ["feature"])
    return m.select("feature", tidy(F.col("beta"), 5).alias("beta"), tidy(F.col("se"), 5).alias("se"), tidy(F.col("var_resid"), 5).alias("var_resid"), tidy(F.col("re_var")[0], 5).alias("var_group"))


@query("lmm_random_slope")
def lmm_random_slope(spark, sf):
    m = mixed.fit_models(long(spark, sf), "x ~ beh*cont + (beh|grp)", ["feature"])
    return m.select("feature", "term", tidy(F.col("beta"), 4).alias("beta"), tidy(F.col("t"), 3).alias("t"))


@query("lmm_orders")
def lmm_orders(spark, sf):
    """Prices by priority with a random intercept of customers: any number of rows becomes one sum for each customer."""
    o = read_tables(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    m = mixed.fit_models(o, "o_totalprice ~ o_orderpriority + (1|o_custkey)")
    return m.select("term", F.round("beta", 1).alias("beta"), F.round("t", 2).alias("t"))


@query("lmm_crossed")
def lmm_crossed(spark, sf):
    """Values of events by part of the day, with crossed effects of users and kinds of event (held against dense fits in the tests)."""
    e = read_tables(spark, sf, "events").select("user_id", "event_type", "value", (F.hour("ts") / 24.0).alias("day"))
    m = mixed.fit_models(e, "value ~ day + (1|user_id) + (1|event_type)")
    return m.select("term", F.round("beta", 3).alias("beta"), F.round("se", 3).alias("se"), F.round("var_resid", 2).alias("var_resid"))


@query("lmm_slope_residuals")
def lmm_slope_residuals(spark, sf):
    """Residual sums of squares by subject and feature, from fits with random slopes and crossed items; all trials."""
    x = long(spark, sf, "beh", "row_id").withColumn("item", F.col("row_id") % 25)
    r = mixed.residuals(x, "x ~ beh + (beh|grp) + (1|item)", ["feature"])
    return r.groupBy("grp", "feature").agg(F.count("*").alias("n"), F.round(F.sum(F.col("residual") * F.col("residual")), 2).alias("rss"))


def _model(spark, sf, formula="val ~ beh + cont + (1|subj)"):
    trials = frame(spark, sf)
    return FieldModel(trials.withColumn("item", F.col("row_id") % 25), formula, shape=SHAPE, feat_nboot=200, feat_thresh=0.2)


@query("pipeline_crossed")
def pipeline_crossed(spark, sf):
    """Corrected p-values by permutation where items cross the subjects."""
    m = _model(spark, sf, "val ~ beh + cont + (1|subj) + (1|item)").run_perms(10)
    return m.p_features().withColumn("p", F.round("p", 6))


@query("pipeline_residual")
def pipeline_residual(spark, sf):
    """Corrected p-values by bootstraps without inner replicates: errors come from the residuals."""
    return _model(spark, sf).run_boots(5, inner=0).p_features().withColumn("p", F.round("p", 6))


@query("pipeline_perm")
def pipeline_perm(spark, sf):
    """Corrected p-values of the whole analysis by permutation."""
    return _model(spark, sf).run_perms(10).p_features().withColumn("p", F.round("p", 6))


@query("pipeline_boot")
def pipeline_boot(spark, sf):
    """Corrected p-values of the whole analysis by bootstrap, enhanced."""
    return _model(spark, sf).run_boots(5).p_features().withColumn("p", F.round("p", 6))


@query("alpha_map", f"""WITH RECURSIVE {GRID}, {MAPS}, n AS (SELECT grp, feature, CAST(sign(x) AS INTEGER) AS side FROM maps WHERE abs(x) >= 0.1e0),
reach AS (SELECT grp, feature, side, feature AS lab FROM n UNION SELECT r.grp, e.dst, r.side, r.lab FROM reach r JOIN near e ON e.src = r.feature JOIN n ON n.grp = r.grp AND n.feature = e.dst AND n.side = r.side),
lab AS (SELECT grp, feature, side, min(lab) AS cluster FROM reach GROUP BY ALL), c AS (SELECT grp, side, cluster, CAST(count(*) AS INTEGER) AS size FROM lab GROUP BY ALL)
SELECT grp, feature, side, cluster, size, round(1e0 / (1 + least(size, 5)), 6) AS p FROM lab JOIN c USING (grp, side, cluster)""")
def alpha_map(spark, sf):
    table = spark.range(1, 6).select(F.col("id").cast("int").alias("size"), F.round(1 / (1 + F.col("id")), 6).alias("p"))
    return clusters.alpha_map(_maps(spark, sf), ["grp"], clusters.Graph.grid(SHAPE), 0.1, table)


@query("smoothed_maps", f"""WITH {CELLS}, m AS (SELECT grp, feature, avg(x) AS x FROM cells GROUP BY grp, feature),
k AS (SELECT d, exp(-0.5e0 * d * d) / sum(exp(-0.5e0 * d * d)) OVER () AS w FROM unnest(range(-4, 5)) AS t(d)),
axis AS (SELECT i, CASE WHEN i + d < 0 THEN -1 - i - d WHEN i + d > 7 THEN 15 - i - d ELSE i + d END AS s, w FROM k, unnest(range(0, 8)) AS t(i))
SELECT grp, CAST(a.i * 8 + b.i AS INTEGER) AS feature, {tidy_sql('sum(a.w * b.w * x)')} AS x FROM axis a, axis b, m WHERE m.feature = a.s * 8 + b.s GROUP BY grp, a.i, b.i""")
def smoothed_maps(spark, sf):
    """Maps smoothed along both axes (also held against a direct convolution in the tests)."""
    from ..operators.frames import cells

    x = cells(clusters.smooth(frame(spark, sf).select("row_id", "grp", "y"), SHAPE, (1.0, 1.0)))
    return x.groupBy("grp", "feature").agg(tidy(F.avg("x")).alias("x"))


@query("simulation")
def simulation(spark, sf):
    """Methods compared on the table's trials, with a block of known signal planted in them."""
    from .simulate import simulate

    return simulate(spark, shape=SHAPE, slope=0.1, perms=5, noise=frame(spark, sf).select("row_id", "grp", "beh", "y")).drop("seconds")


@query("masked_volumes", f"""WITH {MAPS}, keep AS (SELECT feature FROM maps GROUP BY feature HAVING avg(x) > 0)
SELECT grp, feature, {tidy_sql('x')} AS x FROM maps WHERE feature IN (FROM keep)""")
def masked_volumes(spark, sf):
    """Subjects' maps written as volumes of 4 x 4 x 4 to the shared folder, read back by slabs and masked by a volume of their mean."""
    import uuid

    import numpy as np

    from ..session import kept, shared_folder
    from ..sources import nifti

    shape, folder, maps = (4, 4, 4), f"{shared_folder(spark)}/volumes-{uuid.uuid4().hex}", _maps(spark, sf)
    mask = maps.groupBy("feature").agg(F.when(F.avg("x") > 0, 1.0).otherwise(0.0).alias("x")).withColumn("grp", F.lit("mask"))
    rows = maps.select(F.col("grp").cast("string").alias("grp"), "feature", "x").unionByName(mask)
    pairs = F.array_sort(F.collect_list(F.struct("feature", "x")))
    rows = rows.groupBy("grp").agg(F.transform(pairs, lambda v: v["x"]).alias("y"))
    nifti.write_volumes(rows, folder, ["grp"], shape, np.diag([4.0, 4.0, 4.0, 1.0])).foreach(lambda r: None)
    v = nifti.read_volumes(spark, folder).withColumn("grp", F.regexp_extract("path", r"grp-(\w+)\.nii", 1))
    out = nifti.in_mask(v.filter("grp <> 'mask'"), v.filter("grp = 'mask'"))
    return kept(out.select(F.col("grp").cast("int").alias("grp"), "feature", tidy(F.col("value")).alias("x")))


@query("resampled_volumes", f"""WITH {MAPS}, p AS (SELECT i * 9 + j * 3 + k AS feature, i * 1.5e0 AS x, j * 1.5e0 AS y, k * 1.5e0 AS z FROM unnest(range(0, 3)) AS a(i), unnest(range(0, 3)) AS b(j), unnest(range(0, 3)) AS c(k)),
w AS (SELECT p.feature, CAST((a * 4 + b) * 4 + c AS INTEGER) AS source, (1 - abs(a - x)) * (1 - abs(b - y)) * (1 - abs(c - z)) AS w FROM p, unnest(range(0, 4)) AS d(a), unnest(range(0, 4)) AS e(b), unnest(range(0, 4)) AS f(c) WHERE abs(a - x) < 1 AND abs(b - y) < 1 AND abs(c - z) < 1)
SELECT grp, CAST(w.feature AS INTEGER) AS feature, {tidy_sql('sum(w * x)')} AS x FROM w JOIN maps m ON m.feature = source GROUP BY grp, w.feature""")
def resampled_volumes(spark, sf):
    """Subjects' maps as volumes of 4 x 4 x 4 voxels of one unit, on a grid of 3 x 3 x 3 of one and a half."""
    import numpy as np

    from ..sources import nifti

    cells = _maps(spark, sf).select(F.col("grp").alias("path"), F.lit(0).alias("t"), "feature", F.col("x").alias("value"))
    r = nifti.resample(cells, (4, 4, 4), np.eye(4), (3, 3, 3), np.diag([1.5, 1.5, 1.5, 1.0]))
    return r.select(F.col("path").alias("grp"), "feature", tidy(F.col("value")).alias("x"))
