"""The opN_ queries over the driver's tables, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .balls import CLUSTERS, DIMS, ROUNDS, ball_kmeans
from .common import fold_of, table
from .decontam import decontaminate
from .divergence import audit
from .exact import exact_duplicates
from .langid import fit as fit_languages
from .langid import identify
from .shards import materialise
from .spans import remove_repeats
from .toxicity import fit as fit_toxicity
from .toxicity import rate
from .tree import shard_rows
from .packing import pack
from .lm import katz_scores
from .warc import round_trip
from .minhash import near_duplicates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a similarity of 0.85 on 5-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("node", "h")


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("h")


ORACLE["op7_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
), g AS (
  SELECT doc_id, t,
         first_value(doc_id) OVER (PARTITION BY t ORDER BY length(text) DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document words inside occurrences of 10-word windows of benchmark items."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE["op8_benchmark_decontamination"] = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS p, least(10, len(w)) AS k
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(s) WHERE len(w) > 0
), k AS (SELECT DISTINCT k FROM win), grams AS (
  SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS p FROM d, k, unnest(range(1, len(w) - k + 2)) AS t(s) WHERE len(w) >= k
), hit AS (
  SELECT doc_id, item_id, s, g.k FROM grams g JOIN win USING (p, k)
), cover AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM hit, unnest(range(s, s + k)) AS t(x) GROUP BY doc_id
), named AS (
  SELECT doc_id, list(DISTINCT CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(list_sort(ids), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit_languages(docs))
    return found.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = rate(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))


@query
def op10_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz bigram and add-one unigram scores of all documents."""
    return katz_scores(table(spark, sf_dir, "documents"))


@query
def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to zstandard archives and read back."""
    return round_trip(table(spark, sf_dir, "pages"))


ORACLE["op5_warc_round_trip"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""


@query
def op3_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without sentences that repeat a span seen before."""
    return remove_repeats(table(spark, sf_dir, "documents"))


@query
def op6_training_order_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token sequences in shards in training order, read back."""
    return materialise(table(spark, sf_dir, "documents"))


@query
def op11_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of a weighted hash tree, and where each stands once there are nine."""
    return shard_rows(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack")


def _draw(path: str, children: list[str]) -> str:
    """The child of least draw; all shards of the query weigh 1, so a child weighs as many as it has below."""
    draws = [f"{{'d': -ln((CAST('0x' || substr(md5('{path}/{name}:' || key), 1, 13) AS BIGINT) + 0.5) / 4503599627370496) / {weight}, 'n': '{path}/{name}'}}" for name, weight in (c.split("*") for c in children)]
    return f"list_sort([{', '.join(draws)}])[1].n"


ORACLE["op11_hash_tree_sharding"] = f"""
WITH k AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents
), r AS (
  SELECT *, {_draw("", ["r0*4", "r1*4"])} AS region, {_draw("", ["r0*4", "r1*4", "r2*1"])} = '/r2' AS moves FROM k
), c AS (
  SELECT *, CASE region WHEN '/r0' THEN {_draw("/r0", ["k0*2", "k1*2"])} ELSE {_draw("/r1", ["k0*2", "k1*2"])} END AS rack FROM r
), s AS (
  SELECT *, CAST(split_part(CASE rack WHEN '/r0/k0' THEN {_draw("/r0/k0", ["0*1", "1*1"])} WHEN '/r0/k1' THEN {_draw("/r0/k1", ["2*1", "3*1"])}
    WHEN '/r1/k0' THEN {_draw("/r1/k0", ["4*1", "5*1"])} ELSE {_draw("/r1/k1", ["6*1", "7*1"])} END, '/', 4) AS INTEGER) AS shard FROM c
), t AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(0, 8) AS BIGINT[])), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM range(0, 256) AS r(i))
), b AS (
  SELECT *, list_transform(range(0, CAST(strlen(text) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(text)), 2 * i + 1, 2) AS BIGINT)) AS bytes FROM s
), o AS (
  SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size, shard, CASE WHEN moves THEN 8 ELSE shard END AS grown_shard, substr(region, 2) AS region, split_part(rack, '/', 3) AS rack,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda a, x: xor(a >> 8, t[CAST(xor(a & 255, x) + 1 AS BIGINT)])), 4294967295) AS text_crc32
  FROM b, t
)
SELECT *, 'key' AS law, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot FROM o
"""


@query
def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all pairs of sources of a language, and each source's most telling terms."""
    return audit(table(spark, sf_dir, "documents"))


_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE["op12_divergence_audit"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_TERM}') AS w FROM documents
), t AS (
  SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL
), kept AS MATERIALIZED (
  SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM t GROUP BY ALL HAVING count(*) >= 3
), g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d), c AS (
  SELECT lang, source, term, sum(t.n) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
), f AS (
  SELECT lang, source, term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)
), p AS MATERIALIZED (
  SELECT *, 1 + (1000000000 * (n + 1)) // (sum(n) OVER win + count(*) OVER win) AS p FROM f WINDOW win AS (PARTITION BY lang, source)
), q AS (
  SELECT lang, term, 1 + (1000000000 * (n + 1)) // (sum(n) OVER win + count(*) OVER win) AS q FROM kept WINDOW win AS (PARTITION BY lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
), u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM u QUALIFY part = 'pair' OR rank <= 200
"""


@query
def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all valid embeddings by exact ball k-means."""
    return ball_kmeans(table(spark, sf_dir, "embeddings"))


def _kmeans_sql() -> str:
    steps = [f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM k ORDER BY h, v LIMIT {CLUSTERS})
)"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min({{'d': d, 'c': c}}) AS x
  FROM (SELECT r, c, CAST(list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM k, c{i}) GROUP BY r
)""")
        if i < ROUNDS:
            steps.append(f"""s{i} AS (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m
  FROM (SELECT x.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{i} JOIN k USING (r), range(1, {DIMS} + 1) AS t(i) GROUP BY x.c, i) GROUP BY c
), c{i + 1} AS MATERIALIZED (SELECT c, coalesce(s{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN s{i} USING (c))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(x.c AS INTEGER) AS cluster, x.d AS distance, CAST(sum(x.d) OVER (PARTITION BY x.c) AS BIGINT) AS cluster_inertia, CAST(sum(x.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM k JOIN a{ROUNDS} USING (r) JOIN c{ROUNDS} ON c{ROUNDS}.c = x.c
"""


ORACLE["op13_ball_kmeans"] = _kmeans_sql()
