"""Benchmark decontamination on a distributed positional inverted index, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, kept_whole, lower_ascii

#: What parts words, after A-Z are lower-cased: words are runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Distinct terms (or anchor places, or documents) above which a lookup shuffles instead of broadcasting.
BROADCAST_ROWS = 300_000


def fast_lower(c: Column) -> Column:
    """A-Z to lower case: the built-in where the text is ASCII throughout, character by character elsewhere."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(lower_ascii(c))


def words(c: Column) -> Column:
    """Splitting is linear in a text's length; extracting every match copies the text for each."""
    return F.array_remove(F.split(fast_lower(F.coalesce(c, F.lit(""))), BETWEEN), "")


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if a count shows at most ``rows`` rows (written tables: the count reads footers)."""
    return F.broadcast(df) if df.count() <= rows else df


def keyed(docs: DataFrame) -> DataFrame:
    """(id, doc_id, h, text): id is the row's own; doc_id, which is never null, and h tell rows apart by id and text."""
    return docs.select(F.col("doc_id").alias("id"), F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("doc_id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("h"), "text")


def postings(rows: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The index of :func:`keyed` rows: (term, doc_id, h, pos); within each segment sorted by term.

    Each input partition makes its own segment, so building it shuffles nothing but a ``terms`` table (column
    term) too large to broadcast. With ``terms`` only their postings are stored. Null and wordless texts have none.
    """
    rows = rows.select("doc_id", "h", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    if terms is not None:
        rows = rows.join(terms, "term", "left_semi")
    return rows.select("term", "doc_id", "h", "pos").sortWithinPartitions("term", "doc_id", "pos")


def item_words(items: DataFrame) -> DataFrame:
    """(item, item_id, n, at, term): the words of each benchmark row; item tells rows with one item_id apart."""
    rows = items.select("item_id", F.xxhash64("item_id", "text").alias("item"), words(F.col("text")).alias("w")).distinct()
    return rows.select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("at", "term"))


def anchors(item_terms: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(item, at, term, at2, term2): for each window the places of its two rarest terms, by the index's counts.

    A window with a term that the index lacks cannot occur and has no anchor; in a window of one word the two
    are the same.
    """
    known = item_terms.join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    ahead = Window.partitionBy("item").orderBy("at").rowsBetween(0, window - 1)
    each = known.withColumn("w", F.array_sort(F.collect_list(F.struct("count", "at", "term")).over(ahead)))
    starts = each.filter((F.col("at") + window <= F.col("n")) | (F.col("at") == 0)).select("item", F.col("w")[0].alias("a"), F.get("w", F.lit(1)).alias("b"))
    starts = starts.withColumn("b", F.coalesce("b", "a"))
    return starts.filter("a.count > 0").select("item", "a.at", "a.term", F.col("b.at").alias("at2"), F.col("b.term").alias("term2")).distinct()


def phrase_hits(index: DataFrame, item_terms: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """(doc_id, h, item, pos): document words inside an occurrence of a window of ``window`` item words.

    The postings of each window's rarest term give its alignments (document place minus item place). These
    are intersected with the list of its second rarest term, shifted by that term's place, and what is left
    with those of all other terms of the item: an alignment's expected (document, place, term) is looked up
    in the index. Runs of at least ``window`` consecutive matched item words, or the whole of a shorter item,
    are occurrences. Rows follow the number of rarest-term postings, never pairs of documents. Repeated rows have
    equal postings, which count once here.
    """
    counts = scratch.write(index.groupBy("term").count(), "counts")
    item_terms = scratch.write(item_terms, "items")
    rare = scratch.write(anchors(item_terms, counts, window), "anchors")
    doc = ["doc_id", "h"]
    firsts = rare.select("item", "at", "term").distinct()
    seconds = rare.select("item", "at", "at2", "term2").distinct()
    found = index.join(_bounded(firsts, BROADCAST_ROWS), "term").select(*doc, "item", "at", (F.col("pos") - F.col("at")).alias("shift"))
    wanted = found.join(_bounded(seconds, BROADCAST_ROWS), ["item", "at"]).select(*doc, "item", "shift", (F.col("shift") + F.col("at2")).alias("pos"), F.col("term2").alias("term")).distinct()
    lists = index.join(_bounded(seconds.select(F.col("term2").alias("term")).distinct(), BROADCAST_ROWS), "term", "left_semi")
    aligned = scratch.write(wanted.join(lists, [*doc, "pos", "term"]).select(*doc, "item", "shift").distinct(), "aligned")
    here = scratch.write(aligned.select(*doc).distinct(), "candidates")
    near = index.join(_bounded(here, BROADCAST_ROWS), doc, "left_semi").distinct()
    wanted = aligned.join(_bounded(item_terms, BROADCAST_ROWS), "item").withColumn("pos", F.col("shift") + F.col("at"))
    met = wanted.join(near, [*doc, "pos", "term"])
    by = [*doc, "item", "shift"]
    runs = met.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy(*by).orderBy("at")))
    spans = runs.groupBy(*by, "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("k"), F.first("n").alias("n"))
    spans = spans.filter(F.col("k") >= F.least(F.lit(window), F.col("n")))
    return spans.select(*doc, "item", F.explode(F.sequence("first", "last")).alias("pos"))


def proximity_matches(index: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """(query_id, doc_id, h, pos): places of a query's rarest term with every other term at most ``within`` words away.

    queries: (query_id, term); repeated terms count once; a query with a term the index lacks matches nothing. A null
    term is in no document, so its query matches nothing; a null query_id is a query like others. An empty
    index or no queries give no rows.
    """
    q = queries.select("query_id", "term").distinct()
    known = q.join(index.groupBy("term").count(), "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rare = known.groupBy("query_id").agg(F.min(F.struct("count", "term")).alias("r"), F.count("*").alias("terms"))
    rare = rare.filter("r.count > 0").select("query_id", "terms", F.col("r.term").alias("rarest"))
    at = index.join(rare, F.col("term") == F.col("rarest")).select("query_id", "terms", "rarest", "doc_id", "h", "pos")
    others = at.join(q, "query_id").filter("term <> rarest")
    near = others.join(index.withColumnRenamed("pos", "p"), ["term", "doc_id", "h"]).filter(F.abs(F.col("p") - F.col("pos")) <= within)
    both = near.groupBy("query_id", "terms", "doc_id", "h", "pos").agg(F.countDistinct("term").alias("k")).filter("k = terms - 1")
    return both.select("query_id", "doc_id", "h", "pos").union(at.filter("terms = 1").select("query_id", "doc_id", "h", "pos"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, full_index: bool = False) -> DataFrame:
    """(doc_id, h, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    docs: doc_id bigint, text string; items: item_id, text. h: the text's xxhash64. A-Z are lower-cased, words are
    runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``.
    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.
    A document word inside any occurrence of a window is hit. Null and wordless texts have no words and no
    hits; such items have no windows. A null doc_id is kept. Rows with the same doc_id and text get the same answer, rows with the
    same doc_id and other texts their own. Items with the same item_id count once. Other columns are not
    read. Empty tables: no documents give no rows, no items give no hits. The index holds the postings of the
    items' terms, which are all that is looked up; with ``full_index`` those of every term, with equal results.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    docs = keyed(docs)
    item_terms = scratch.write(item_words(items), "words")
    terms = scratch.write(item_terms.select("term").distinct(), "terms")
    index = scratch.write(postings(docs, None if full_index else _bounded(terms, BROADCAST_ROWS)), "index")
    hits = phrase_hits(index, item_terms, scratch, window)
    ids = item_terms.select("item", F.col("item_id").cast("string").alias("item_id")).distinct()
    hits = scratch.write(hits, "hits")
    n = hits.groupBy("doc_id", "h", "pos").count().groupBy("doc_id", "h").agg(F.count("*").alias("n_hit"))
    named = hits.select("doc_id", "h", "item").distinct().join(_bounded(ids, BROADCAST_ROWS), "item")
    named = named.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    per_doc = n.join(named, ["doc_id", "h"]).withColumnsRenamed({"doc_id": "hit_id", "h": "hit_h"})
    per_doc = scratch.write(per_doc, "per_doc")
    light = docs.select("id", "doc_id", "h", F.xxhash64("text").alias("text_h"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = light.join(per_doc, (F.col("doc_id") == F.col("hit_id")) & (F.col("h") == F.col("hit_h")), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    out = out.select(
        F.col("id").alias("doc_id"), F.col("text_h").alias("h"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
    out = kept_whole(out)
    scratch.drop()
    return out
