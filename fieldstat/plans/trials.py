"""Queries: trial tables, joins and generators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import tidy
from ..operators import generate, tables
from ..sources.files import read_tables
from .catalogue import query
from .data import CELLS, FEATURES, TMAP, long, p9_sql, quantile_sql, tidy_sql


def _events(spark, sf):
    """Events with onset in whole seconds and a duration from the id."""
    return read_tables(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.unix_timestamp("ts").alias("ts"))


EV = "ev AS (SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)"


@query("interval_bins", f"""WITH {EV}, z AS (SELECT user_id, event_id, s - min(s) OVER (PARTITION BY user_id) AS onset, event_id % 4 * 1.5e0 AS dur FROM ev),
b AS (SELECT user_id, event_id, CAST(trunc(onset / 2e0) AS INTEGER) AS a, CAST(trunc((onset + dur) / 2e0) AS INTEGER) AS e FROM z)
SELECT user_id, event_id, CAST(bin AS INTEGER) AS bin FROM b, unnest(range(a, e)) AS t(bin)""")
def interval_bins(spark, sf):
    e = _events(spark, sf)
    first = e.groupBy("user_id").agg(F.min("ts").alias("first"))
    e = e.join(first, "user_id").withColumn("onset", (F.col("ts") - F.col("first")).cast("double"))
    return tables.interval_bins(e, ["user_id", "event_id"], F.col("onset"), F.col("event_id") % 4 * 1.5, 2.0)


@query("design_matrix_text", "SELECT user_id, string_agg(event_type || ':' || (event_id % 10), ' ' ORDER BY event_id) AS line FROM events GROUP BY user_id")
def design_matrix_text(spark, sf):
    return tables.joined_text(read_tables(spark, sf, "events"), ["user_id"], ["event_id"], [F.col("event_type"), F.col("event_id") % 10])


@query("failed_runs", "SELECT DISTINCT user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.user_id = e.user_id AND d.event_type = e.event_type AND d.value > 150)")
def failed_runs(spark, sf):
    e = read_tables(spark, sf, "events").select("user_id", "event_type", "value")
    return tables.missing(e.select("user_id", "event_type").distinct(), e.filter("value > 150"), ["user_id", "event_type"])


@query("shard_union", """WITH s AS (SELECT shard, CASE WHEN rk = 1 THEN 0 ELSE shard + 1 END AS run, value FROM (SELECT event_id % 4 AS shard, value, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS rk FROM events))
SELECT run, round(value, 6) AS value FROM s WHERE shard = 0 OR run <> 0""")
def shard_union(spark, sf):
    """All events dealt into four shards and combined; event_id is unique. A shard's first event comes from an aggregation, so no shard is one task's."""
    e = read_tables(spark, sf, "events").select((F.col("event_id") % 4).alias("shard"), "event_id", "value")
    first = e.groupBy("shard").agg(F.min("event_id").alias("first"))
    e = e.join(F.broadcast(first), "shard")
    e = e.select("shard", F.when(F.col("event_id") == F.col("first"), 0).otherwise(F.col("shard") + 1).alias("run"), F.round("value", 6).alias("value"))
    return tables.recombine([e.filter(F.col("shard") == i).select("run", "value") for i in range(4)])


@query("left_merge", """WITH a AS (SELECT c_nationkey AS run_n, round(avg(c_acctbal), 4) AS dice_full FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS run_n, round(avg(s_acctbal), 4) AS dice_half FROM supplier GROUP BY 1)
SELECT run_n, dice_full, dice_half FROM a LEFT JOIN b USING (run_n)""")
def left_merge(spark, sf):
    a = read_tables(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("run_n")).agg(F.round(F.avg("c_acctbal"), 4).alias("dice_full"))
    b = read_tables(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("run_n")).agg(F.round(F.avg("s_acctbal"), 4).alias("dice_half"))
    return a.join(b, "run_n", "left")


@query("positional_zip", """WITH v AS (SELECT user_id, event_id AS view_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events WHERE event_type = 'view'),
c AS (SELECT user_id, event_id AS click_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events WHERE event_type = 'click')
SELECT user_id, view_id, click_id FROM v JOIN c USING (user_id, p)""")
def positional_zip(spark, sf):
    e = read_tables(spark, sf, "events")
    one = lambda kind, name: e.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name))
    return tables.zip_by_position(one("view", "view_id"), one("click", "click_id"), ["user_id"], "view_id", "click_id")


@query("lookup_noise", """SELECT o_orderkey, round(o_totalprice + c_acctbal * 0.5e0 + coalesce(n_regionkey, 0) * 100, 4) AS noisy FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def lookup_noise(spark, sf):
    """Subject and item shifts looked up for each row; the optimiser broadcasts a side only within its size limit."""
    o = read_tables(spark, sf, "orders").join(read_tables(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(read_tables(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return o.select("o_orderkey", F.round(F.col("o_totalprice") + F.col("c_acctbal") * 0.5 + F.coalesce(F.col("n_regionkey"), F.lit(0)) * 100, 4).alias("noisy"))


@query("collect_lists", "SELECT user_id, event_type, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS onsets FROM events GROUP BY user_id, event_type")
def collect_lists(spark, sf):
    ids = F.array_sort(F.collect_list("event_id"))
    return read_tables(spark, sf, "events").groupBy("user_id", "event_type").agg(F.array_join(F.transform(ids, lambda v: v.cast("string")), ",").alias("onsets"))


@query("path_fields", r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, string_split(url, '/')[-1] AS last, lpad(CAST(page_id AS VARCHAR), 8, '0') AS code FROM pages")
def path_fields(spark, sf):
    return read_tables(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"), F.element_at(F.split("url", "/"), -1).alias("last"), F.lpad(F.col("page_id").cast("string"), 8, "0").alias("code"))


@query("threshold_scatter", f"""WITH {TMAP}, p AS (SELECT feature, t, {p9_sql('t')} AS p FROM tmap WHERE feature % 3 <> 0), f AS (SELECT CAST(i AS INTEGER) AS feature FROM unnest(range(0, 64)) AS t(i))
SELECT feature, {tidy_sql('coalesce(t, 0)')} AS t, {tidy_sql('coalesce(p, 1)')} AS p, {tidy_sql('CASE WHEN coalesce(p, 1) < 0.3e0 THEN coalesce(t, 0) ELSE 0 END')} AS shown FROM f LEFT JOIN p USING (feature)""")
def threshold_scatter(spark, sf):
    """A masked map put back on the grid, and what passes the threshold."""
    from ..functions.columns import t_two_tailed
    from ..operators.frames import fisher_t, group_correlations

    t = fisher_t(group_correlations(long(spark, sf, "beh"), ["beh"])).filter("feature % 3 <> 0")
    t = t.select("feature", "t", t_two_tailed(F.col("t"), (F.col("n") - 1).cast("int")).alias("p"))
    whole = tables.scatter(t, spark.range(FEATURES).select(F.col("id").cast("int").alias("feature")))
    return whole.select("feature", tidy(F.col("t")).alias("t"), tidy(F.col("p")).alias("p"), tidy(tables.thresholded(F.col("t"), F.col("p"), 0.3)).alias("shown"))


_RECTANGLES = [("central01", 49, 47, 5, 2), ("central", 45, 45, 10, 10), ("central10", 37, 30, 25, 40)]
_RECTANGLES += [(name, y, x, h, w) for name, (ys, xs, h, w) in generate.LATTICE.items() for y in ys for x in xs]
_PICTURES = ", ".join(f"('{name}', '{text.strip()}')" for name, text in generate.PLACED.items())


@query("hide_blobs", f"""WITH {CELLS}, m AS (SELECT grp, feature, avg(x) AS x FROM cells GROUP BY grp, feature), r AS (SELECT * FROM (VALUES {", ".join(map(str, _RECTANGLES))}) AS t(name, y, x, h, w)),
p AS (SELECT name, string_split(text, chr(10)) AS lines FROM (VALUES {_PICTURES}) AS t(name, text)),
l AS (SELECT name, i, string_split(lines[i + 1], ' ') AS cells FROM p, unnest(range(0, len(lines))) AS t(i)),
c AS (SELECT name, i, j, CAST(cells[j + 1] AS DOUBLE) AS signal FROM l, unnest(range(0, len(cells))) AS t(j)),
g AS (SELECT 'final' AS name, 5 * half + dy AS i, 4 * k + dx AS j, (1 - 2 * half) * (k + 1) / 6e0 AS signal
      FROM unnest(range(0, 2)) AS a(half), unnest(range(0, 6)) AS b(k), unnest(range(0, 3)) AS c(dy), unnest(range(0, 2)) AS d(dx)),
s AS (SELECT name, CAST(y + dy AS INTEGER) AS i, CAST(x + dx AS INTEGER) AS j, 1e0 AS signal FROM r, unnest(range(0, h)) AS t(dy), unnest(range(0, w)) AS u(dx)
UNION ALL SELECT name, CAST(i AS INTEGER), CAST(j AS INTEGER), signal FROM c WHERE signal <> 0
UNION ALL SELECT name, CAST(i AS INTEGER), CAST(j AS INTEGER), signal FROM g)
SELECT grp, name, i, j, {tidy_sql('x + signal')} AS x FROM s JOIN m ON m.feature = i % 8 * 8 + j % 8""")
def hide_blobs(spark, sf):
    """The signal cells of every named pattern, hidden in each subject's mean map, which repeats over the field."""
    out = None
    for name in [*generate.CENTRAL, *generate.LATTICE, *generate.PLACED, "final"]:
        one = generate.pattern_frame(spark, generate.named_pattern(name)).filter("signal <> 0").select(F.lit(name).alias("name"), "i", "j", "signal")
        out = one if out is None else out.union(one)
    m = long(spark, sf, "beh").groupBy("grp", "feature").agg(F.avg("x").alias("x"))
    hidden = out.withColumn("feature", F.col("i") % 8 * 8 + F.col("j") % 8).join(m, "feature")
    return hidden.select("grp", "name", "i", "j", tidy(F.col("x") + F.col("signal")).alias("x"))


def _design(spark, sf):
    """The table's trials as a design: subject and one of 25 items."""
    e = read_tables(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("subj"), (F.col("vec_id") % 25).cast("int").alias("item"))


@query("synth_data", f"""WITH {CELLS}, f AS (SELECT feature, sign(avg(x)) AS signal FROM cells GROUP BY feature),
u AS (SELECT grp AS subj, CASE WHEN row_id % 25 % 2 = 0 THEN -0.5e0 ELSE 0.5e0 END AS beh, feature, signal, (CAST('0x' || substr(md5('9-y-' || row_id || '-' || feature), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS p FROM emb, f)
SELECT subj, beh, feature, {tidy_sql(f"avg(signal * beh * 2 + ({quantile_sql('p')}))")} AS mean FROM u GROUP BY subj, beh, feature""")
def synth_data(spark, sf):
    """Trials generated for the table's subjects and items, with the signs of its mean map as signal: mean of each condition."""
    pattern = long(spark, sf, "beh").groupBy("feature").agg(F.signum(F.avg("x")).alias("signal"))
    x = generate.trials(spark, 0, 0, pattern, slope=2.0, seed=9, over=_design(spark, sf))
    cells = x.select("subj", "beh", F.posexplode("y").alias("feature", "x"))
    return cells.groupBy("subj", "beh", "feature").agg(tidy(F.avg("x")).alias("mean"))


@query("synth_design", """SELECT vec_id AS row_id, label AS subj, CAST(vec_id % 25 AS INTEGER) AS item, CASE WHEN vec_id % 25 % 2 = 0 THEN -0.5e0 ELSE 0.5e0 END AS beh FROM embeddings""")
def synth_design(spark, sf):
    """The design of trials over given rows: each item has one condition; a hidden continuous predictor stays out of the table."""
    pattern = generate.pattern_frame(spark, generate.np.ones((1, 1)))
    return generate.trials(spark, 0, 0, pattern, slope=1.0, continuous=True, mod_cont=False, over=_design(spark, sf)).drop("y")
