"""How far the sources of a language diverge in their words: equal columns of counts are evaluated once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL, Scratch, kept_whole, settings, small_batches

#: Parts of a whole that probabilities are given in.
SCALE = 1_000_000_000
LEAST_DOCS, TOP = 3, 200
#: Counts of (lang, source, term) that a task adds up before it hands them on.
HELD = 1_000_000
#: Groups (lang, source) up to which their sums are broadcast (about 60 bytes each).
BROADCAST_GROUPS = 100_000

#: Bytes of terms, A-Z lower-cased; all others become spaces. Bytes from 0x80 on are those of letters beyond ASCII.
_BYTES = np.full(256, 0x20, np.uint8)
_BYTES[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_BYTES[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_BYTES[0x80:] = np.arange(0x80, 256)


def split_terms(texts: pa.Array) -> pa.Array:
    """Lists of the runs of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]``, A-Z lower-cased; an empty string may stand at either end."""
    texts = pa.concat_arrays([texts.cast(pa.large_string()), pa.array([""], pa.large_string())])  # copied: its bytes begin at 0
    _, offsets, data = texts.buffers()
    plain = _BYTES[np.frombuffer(data, np.uint8)] if data is not None else np.empty(0, np.uint8)
    return pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(plain)]))[:-1]


def _counted(b: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of each (lang, source, term) of a batch (lang, source, text)."""
    lists = split_terms(b.column(2))
    words = lists.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    code, names = words.indices.to_numpy(), words.dictionary
    some = pc.not_equal(names, "").to_numpy(zero_copy_only=False)[code]
    n_names = max(len(names), 1)
    pair, times = np.unique(doc[some] * n_names + code[some], return_counts=True)
    lang, source = b.column(0).dictionary_encode(), b.column(1).dictionary_encode()
    n_sources = len(source.dictionary)
    group = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
    cell, at, docs = np.unique(group[pair // n_names] * n_names + pair % n_names, return_inverse=True, return_counts=True)
    n = np.zeros(len(cell), np.int64)
    np.add.at(n, at, times)
    group, term = cell // n_names, cell % n_names
    cols = [lang.dictionary.take(pa.array(group // n_sources)), source.dictionary.take(pa.array(group % n_sources)), names.take(pa.array(term)).cast(pa.string()), pa.array(n), pa.array(docs.astype(np.int64))]
    return pa.Table.from_arrays(cols, ["lang", "source", "term", "n", "docs"])


def _count(batches):
    held, rows = [], 0

    def out():
        total = pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return total.rename_columns(["lang", "source", "term", "n", "docs"])

    for b in small_batches(batches, 2048):
        held.append(_counted(b))
        rows += held[-1].num_rows
        if rows > HELD:
            held = [out()]
            rows = held[0].num_rows
            if rows > HELD // 2:
                yield from held[0].combine_chunks().to_batches(max_chunksize=50_000)
                held, rows = [], 0
    if rows:
        yield from out().combine_chunks().to_batches(max_chunksize=50_000)


def _p(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exactly: in decimals of 38 digits."""
    return F.lit(1) + F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(20,0)"))


def _f(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q); the square is at most 10 ** 18."""
    return F.call_function("div", (p - q) * (p - q), q)


def term_vectors(docs: DataFrame, scratch: Scratch, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, vec): each term of at least ``least_docs`` documents of its lang; vec: its sources and counts, those above 0 alone."""
    read = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = read.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    with settings(docs.sparkSession, SMALL):
        cells = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        terms = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vec"))
        return scratch.write(terms.filter(F.col("docs") >= least_docs).select("lang", "term", "total", "vec"), "terms")


def group_sums(docs: DataFrame, terms: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, source, v, d, dl, p0) of every occurring group: kept terms of the lang, v + occurrences of the group and of the lang, p of a count of 0."""
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    own = terms.select("lang", F.inline("vec")).groupBy("lang", "source").agg(F.sum("n").alias("own"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("whole"))
    out = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["own", "v", "whole"])
    out = out.select("lang", "source", "v", (F.col("v") + F.col("own")).alias("d"), (F.col("v") + F.col("whole")).alias("dl"))
    return scratch.write(out.withColumn("p0", F.when(F.col("v") > 0, _p(F.lit(0), F.col("d"))).otherwise(1)), "sums")


def term_part(terms: DataFrame, sums: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` terms of each group that are likelier there than in the lang; each task ranks its own first."""
    cells = terms.select("lang", "term", "total", F.inline("vec")).join(sums, ["lang", "source"])
    cells = cells.select("lang", "source", "term", _p(F.col("n"), F.col("d")).alias("p"), _p(F.col("total"), F.col("dl")).alias("q")).filter("p > q")
    cells = cells.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    return ranked(cells).filter(F.col("rank") <= top)


def pair_part(terms: DataFrame, sums: DataFrame, scratch: Scratch) -> DataFrame:
    """Each group against each other source of its lang, summed over all kept terms.

    Terms with equal vectors are one row with a multiplicity. A term that neither source has counts as f(0, 0), so a pair's sum is v times
    that, and what single counts and counts in both add to it: only pairs of sources inside a vector are
    looked at, once for each distinct vector, and pairs of equal counts together.
    """
    vectors = scratch.write(terms.groupBy("lang", "vec").agg(F.count("*").alias("m")), "vectors")
    mine = sums.select("lang", "source", "v", "d", "p0")
    other = sums.select("lang", F.col("source").alias("item"), F.col("d").alias("d2"), F.col("p0").alias("q0"))
    zero = _f(F.col("p0"), F.col("q0"))
    # of all terms as if no source had them
    base = mine.join(other, "lang").filter("source <> item").select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * zero).otherwise(0).alias("value"))
    # of counts in one source, as if the other one had none
    seen = vectors.select("lang", "m", F.inline("vec")).groupBy("lang", "source", "n").agg(F.sum("m").alias("m"))
    seen = seen.join(mine, ["lang", "source"]).select("lang", "source", "m", "p0", _p(F.col("n"), F.col("d")).alias("p"))
    seen = seen.groupBy("lang", "source", "p0", "p").agg(F.sum("m").alias("m")).join(other.drop("d2"), "lang").filter("source <> item")
    there = seen.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (_f(F.col("p"), F.col("q0")) - zero)).alias("value"))
    back = seen.groupBy("lang", F.col("item").alias("source"), F.col("source").alias("item")).agg(F.sum(F.col("m") * (_f(F.col("q0"), F.col("p")) - _f(F.col("q0"), F.col("p0")))).alias("value"))
    # of counts in both: what is missing to the truth
    both = vectors.filter(F.size("vec") > 1).select("lang", "m", "vec", F.inline("vec")).toDF("lang", "m", "vec", "source", "n")
    both = both.select("lang", "m", "source", "n", F.inline(F.filter("vec", lambda x: x["source"] > F.col("source")))).toDF("lang", "m", "source", "n", "item", "n2")
    both = both.groupBy("lang", "source", "item", "n", "n2").agg(F.sum("m").alias("m"))
    both = both.join(mine.drop("v"), ["lang", "source"]).join(other, ["lang", "item"])
    both = both.select("lang", "source", "item", "m", "p0", "q0", _p(F.col("n"), F.col("d")).alias("p"), _p(F.col("n2"), F.col("d2")).alias("q"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    gap = [(F.col("m") * (_f(a, b) - _f(a, b0) - _f(a0, b) + _f(a0, b0))) for a, b, a0, b0 in ((p, q, p0, q0), (q, p, q0, p0))]
    both = both.groupBy("lang", "source", "item").agg(F.sum(gap[0]).alias("value"), F.sum(gap[1]).alias("turned"))
    both = both.select("lang", "source", "item", "value").union(both.select("lang", F.col("item"), F.col("source"), "turned"))
    whole = base.union(there).union(back.select("lang", "source", "item", "value")).union(both)
    return ranked(whole.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value"))


def ranked(rows: DataFrame) -> DataFrame:
    by = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item").asc())
    return rows.withColumn("rank", F.row_number().over(by))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of ``docs`` (text, lang, source strings).

    Part ``pair``: every other source of the lang by divergence; part ``term``: the ``top`` terms by which the group exceeds its lang.
    Null text, lang and source count as ''. Rows are documents, repeated ones too. Texts without a term, and langs without a kept
    one, still have their pairs, with value 0 in the latter case; a lang's only source has none. Ties go by the item's UTF-8 bytes.
    Texts of any length are read whole, extra columns not at all; an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    docs = docs.select("lang", "source", "text")
    terms = term_vectors(docs, scratch, least_docs)
    sums = group_sums(docs, terms, scratch)
    if sums.count() <= BROADCAST_GROUPS:
        sums = F.broadcast(sums)
    out = pair_part(terms, sums, scratch).union(term_part(terms, sums, top))
    out = kept_whole(out)
    scratch.drop()
    return out
