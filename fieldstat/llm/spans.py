"""Substring deduplication by sliding sentence spans."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, kept_whole, mix64, small_batches

#: A sentence ends after full stops, exclamation or question marks and the white space behind them, or at a line break.
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?=\s|$)\s*|\n\s*|[.!?]+)|[^.!?\n]+")
#: A span: the fewest consecutive sentences, LEAST_SENTENCES at least, that hold LEAST_WORDS words.
LEAST_SENTENCES, LEAST_WORDS = 2, 20
_M = 0x9E3779B97F4A7C15
_M_INVERSE = pow(_M, -1, 2**64)
#: A span's name has 96 bits, key and more: two of a million million different spans share one with a probability of 6e-6.
_RUNS = "doc_id bigint, h bigint, n_sentences bigint, runs array<struct<key:bigint,more:int,first:int,last:int,again:boolean>>"
_RUN_TYPE = pa.list_(pa.struct([("key", pa.int64()), ("more", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("again", pa.bool_())]))
#: Repeated spans above which their lookup shuffles instead of broadcasting (some 16 bytes each).
BROADCAST_SPANS = 500_000


def sentences(text: str | None) -> list[str]:
    """The text cut into sentences; joined they are the text again."""
    return SENTENCE.findall(text) if text else []


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def runs(parts: list[str], least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS):
    """(key, more, first, last) of the shortest sufficient span from each sentence on, and up to each sentence.

    Equal spans (A-Z lower-cased, white space apart) have equal names (key, more) wherever they stand. Both parts come from sums over
    independent hashes of the sentences, 64 bits each.
    """
    n = len(parts)
    if n < least_sentences:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
    words = [p.encode("utf-8", "surrogatepass").lower().split() for p in parts]
    sizes = np.fromiter(map(len, words), np.int64, n)
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(w)) for w in words), "<u8").reshape(n, 2)
    total = np.append(0, np.cumsum(sizes))
    s = np.arange(n)
    ahead = np.maximum(np.searchsorted(total, total[:-1] + least_words), s + least_sentences)
    behind = np.minimum(np.searchsorted(total, total[1:] - least_words, "right") - 1, s + 1 - least_sentences)
    first = np.concatenate([s[ahead <= n], behind[behind >= 0]])
    end = np.concatenate([ahead[ahead <= n], (s + 1)[behind >= 0]])
    place = np.unique(first * (n + 1) + end)
    first, end = place // (n + 1), place % (n + 1)
    powers, back = _powers(_M, n), _powers(_M_INVERSE, n)[first]

    def name(h):
        sums = np.append(np.uint64(0), np.cumsum(h * powers, dtype=np.uint64))
        return mix64((sums[end] - sums[first]) * back + (end - first).astype(np.uint64))

    more = (name(both[:, 1]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return name(both[:, 0]).view(np.int64), more, first, end - 1


def _find(least_sentences: int, least_words: int):
    def run(batches):
        for b in small_batches(batches):
            out = []
            for doc_id, h, text in zip(*(c.to_pylist() for c in b.columns)):
                parts = sentences(text)
                key, more, first, last = runs(parts, least_sentences, least_words)
                again = np.ones(len(key), bool)
                again[np.unique(np.c_[key, more], axis=0, return_index=True)[1]] = False
                each = zip(key.tolist(), more.tolist(), first.tolist(), last.tolist(), again.tolist())
                out.append((doc_id, h, len(parts), [{"key": k, "more": m, "first": f, "last": e, "again": a} for k, m, f, e, a in each]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), _RUN_TYPE))], ["doc_id", "h", "n_sentences", "runs"])

    return run


def _remove(batches):
    for b in small_batches(batches):
        out = []
        for doc_id, text, spans in zip(*(c.to_pylist() for c in b.columns)):
            parts = sentences(text)
            gone = sorted({i for s in spans or () for i in range(s["first"], s["last"] + 1)})
            if gone:
                out_of = set(gone)
                text = "".join(p for i, p in enumerate(parts) if i not in out_of)
            out.append((doc_id, text, len(parts), len(gone), gone))
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "text", "n_sentences", "n_removed", "removed"])


def remove_repeats(docs: DataFrame, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed, removed) for every row of ``docs`` (doc_id bigint, text string).

    A span is a run of consecutive sentences, the shortest of at least ``least_sentences`` with at least
    ``least_words`` words that begins, or that ends, at a sentence. Of all occurrences of a span anywhere the
    first stays, by doc_id and then place; sentences covered by any other occurrence are removed from text.
    removed: their numbers, from 0. Null texts stay null, with no sentences; a document may end up empty.
    Rows that share a doc_id count as one document when looking for the first occurrence; null ids come last.
    Other columns are not read. An empty table gives an empty table.

    The shortest spans remove what every run of at least so many sentences and words would: a run that repeats
    is covered by the shortest spans from and up to its sentences, and these repeat wherever it does.
    Only hashes of spans are shuffled; a span that a third of the documents share leaves each task as one
    partial minimum, and the join back to its occurrences is by key with rows of a few bytes.
    """
    scratch = Scratch(docs.sparkSession, "spans")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    found = scratch.write(docs.mapInArrow(_find(least_sentences, least_words), _RUNS), "runs")
    each = found.select("doc_id", "h", F.inline("runs"))
    firsts = each.groupBy("key", "more").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = scratch.write(firsts, "firsts")
    # the first document is the smallest id; null only if no occurrence has one
    spans = each.join(firsts, ["key", "more"]).filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")) | F.col("again"))
    spans = spans.groupBy("doc_id", "h").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    spans = scratch.write(spans.withColumnsRenamed({"doc_id": "s_id", "h": "s_h"}), "spans")
    few = (spans.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST_SPANS
    rows = docs.join(F.broadcast(spans) if few else spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h")), "left")
    out = rows.select("doc_id", "text", "spans")
    out = kept_whole(out.mapInArrow(_remove, "doc_id bigint, text string, n_sentences bigint, n_removed bigint, removed array<int>"))
    scratch.drop()
    return out
