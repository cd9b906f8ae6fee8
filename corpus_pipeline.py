"""A training corpus from raw documents: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldstat.llm import langid
from fieldstat.llm.common import Scratch, kept_whole, table, without
from fieldstat.llm.decontam import decontaminate
from fieldstat.llm.exact import exact_duplicates
from fieldstat.llm.minhash import near_duplicates
from fieldstat.llm.packing import pack
from fieldstat.session import ship_package

#: Several stages can't be expressed in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


# What holds for every stage but the last: all columns of documents are returned, whatever others there are and however
# they are named; a null text counts as empty; a null doc_id is an id like others; rows that repeat a doc_id and
# text share their fate, but for exact, where one of them stays; texts of any length are read whole; an empty
# table gives an empty table.


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is recognised with enough confidence; texts that are null, empty or without a letter go."""
    ship_package(spark)
    return langid.accepted(docs, langid.fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest original text, of ties the smallest doc_id, a null one last."""
    found = exact_duplicates(docs)
    out = without(docs, found.filter("not kept"))
    twice = found.filter("kept").groupBy("doc_id", "h").count().filter("count > 1")
    if not twice.isEmpty():  # the same row several times
        out = out.dropDuplicates(["doc_id", "text"])
    return out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, linked at a similarity of 0.8 or more: the smallest doc_id.

    Texts without words are linked with nothing and stay; where all ids of a component are null, one text stays.
    """
    return without(docs, near_duplicates(docs, percent=80).filter("not kept"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window; an empty benchmark drops nothing."""
    return without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents and their places in training sequences; a null or empty text is its end id."""
    return pack(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("minhash_near_dedup", near), ("benchmark_decontamination", clean), ("best_fit_packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; the last one's rows."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), str(i))
        if i:
            scratch.drop(str(i - 1))
    docs = kept_whole(docs)
    scratch.drop()
    return docs
