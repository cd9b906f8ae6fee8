"""Katz backoff language model: Good-Turing discounted counts, exactly normalised, in partitioned tables.

The corpus is cut into blocks of about BLOCK tokens. A block asks for what it needs by sending each distinct
key once to the bucket that owns it, and gets an answer of the same length; a bucket sees all blocks' requests
at once, so it counts and answers in one pass. Words go first (ids and counts), then pairs of words. A word or
pair that fills a third of the corpus is one key of a block, and the successors of a frequent word are dealt
over several buckets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHash, fold_of, kept_whole, mix64, settle, small_batches, words_of, worker_table

#: Tokens of a block, requested keys of a bucket.
BLOCK, BUCKET = 1_000_000, 1_000_000
BEGIN, END, FIRST_ID = 0, 1, 2
#: Counts up to this are discounted.
K = 5
#: A context seen this often has its successors dealt over several buckets; there are at most HOT_MOST such.
HOT_COUNT, HOT_MOST = 1_000_000, 500_000
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _z(a: np.ndarray) -> bytes:
    """Compressed with the values' bytes apart: the upper ones of small or ordered numbers nearly vanish."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _uz(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b, max_output_size=2**31), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _schema(*fields: tuple[str, str]) -> tuple[pa.Schema, str]:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in fields]), ", ".join(f"{n} {t}" for n, t in fields)


BLOCKS = _schema(("block", "bigint"), ("doc_ids", "array<bigint>"), ("train", "array<boolean>"), ("sizes", "array<bigint>"), ("codes", "binary"), ("vocab", "binary"), ("counts", "binary"), ("n_vocab", "bigint"), ("n_tokens", "bigint"), ("train_tokens", "bigint"), ("train_docs", "bigint"))
WORD_ASK = _schema(("bucket", "int"), ("block", "bigint"), ("keys", "binary"), ("counts", "binary"))
WORD_ANSWER = _schema(("bucket", "int"), ("block", "bigint"), ("ranks", "binary"), ("counts", "binary"), ("n", "bigint"), ("n_train", "bigint"))
PAIR_ASK = _schema(("bucket", "int"), ("block", "bigint"), ("ctx", "binary"), ("cur", "binary"), ("counts", "binary"), ("of_cur", "binary"), ("hot", "binary"))
PAIR_ANSWER = _schema(("bucket", "int"), ("block", "bigint"), ("counts", "binary"), ("sums", "binary"), ("plain", "binary"), ("ctx", "binary"), ("cur", "binary"), ("n_of", "array<bigint>"))
SCORES = _schema(("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double"))


def _by_count(counts: np.ndarray) -> np.ndarray:
    """The words, most frequent first: codes are stored by this order, in which most are small."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


def _cut(batches):
    """Blocks of whole documents: local word codes, the words' hashes in order, and their counts in training rows."""
    hashes, k, base = worker_table("hashes", WordHash), 0, TaskContext.get().partitionId() << 32
    docs: list[tuple] = []
    total = 0

    def flush():
        nonlocal k, docs, total
        ids, train, toks = zip(*docs)
        sizes = np.fromiter(map(len, toks), np.int64, len(toks))
        vocab, codes = np.unique(np.concatenate(toks), return_inverse=True)
        learn = np.repeat(np.array(train), sizes)
        counts = np.bincount(codes[learn], minlength=len(vocab))
        codes = np.argsort(_by_count(counts))[codes]
        row = (base + k, list(ids), list(train), sizes.tolist(), _z(codes.astype("<u4")), _z(vocab), _z(counts.astype("<u4")), len(vocab), int(sizes.sum()) + len(ids), int(learn.sum()) + sum(train), sum(train))
        k, docs, total = k + 1, [], 0
        return _batch([row], BLOCKS[0])

    for b in small_batches(batches):
        for doc_id, text, train in zip(*(c.to_pylist() for c in b.columns)):
            words = words_of(text)
            docs.append((doc_id, train, np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))))
            total += len(words) + 1
            if total >= BLOCK:
                yield flush()
    if docs:
        yield flush()


def _owner(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a hash by its high bits, so that sorted hashes meet buckets in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _ask_words(buckets: int):
    def run(batches):
        for b in batches:
            for block, vocab, counts in zip(*(c.to_pylist() for c in b.columns)):
                v, n = _uz(vocab, np.uint64), _uz(counts, "<u4")
                cut = np.searchsorted(_owner(v, buckets), np.arange(buckets + 1))
                rows = [(j, block, _z(v[x:y]), _z(n[x:y])) for j, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if y > x]
                yield _batch(rows, WORD_ASK[0])

    return run


def _groups(batches, width: int):
    """Rows sorted by their first column, as one list for each of its values."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[0] != key and rows:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield key, rows


def _merge_words(batches):
    for bucket, rows in _groups(batches, 4):
        keys = [_uz(r[2], np.uint64) for r in rows]
        words, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate([_uz(r[3], "<u4") for r in rows]), len(words)).astype(np.int64)
        yield _batch([(bucket, -1, None, None, len(words), int((total > 0).sum()))], WORD_ANSWER[0])
        i = 0
        for r, k in zip(rows, keys):
            mine = at[i : i + len(k)]
            i += len(k)
            yield _batch([(bucket, r[1], _z(mine.astype("<u4")), _z(total[mine].astype("<u8")), 0, 0)], WORD_ANSWER[0])


class Block:
    """A block with its words' global ids and counts, and its distinct pairs in the order they are asked for."""

    def __init__(self, row: dict, offsets: dict[int, int], buckets: int, hot_count: int, train_docs: int):
        parts = sorted(row["answers"], key=lambda a: a["bucket"])
        none = [np.empty(0, np.uint64)]
        gid = np.concatenate(none + [_uz(a["ranks"], "<u4").astype(np.uint64) + np.uint64(offsets[a["bucket"]] + FIRST_ID) for a in parts])
        count = np.concatenate([np.empty(0, np.int64)] + [_uz(a["counts"], "<u8").astype(np.int64) for a in parts])
        gid = np.concatenate([np.array([BEGIN, END], np.uint64), gid])
        self.count = np.concatenate([np.array([train_docs, train_docs], np.int64), count])  # by local code
        codes = _by_count(_uz(row["counts"], "<u4"))[_uz(row["codes"], "<u4").astype(np.int64)] + 2
        self.sizes = np.array(row["sizes"], np.int64)
        n = self.sizes + 1
        last = np.cumsum(n) - 1
        self.first = last - self.sizes
        total = int(n.sum())
        inner = np.ones(total, bool)
        inner[last] = False
        self.cur = np.full(total, END, np.int64)
        self.cur[inner] = codes
        after = np.ones(total, bool)
        after[self.first] = False
        self.prev = np.full(total, BEGIN, np.int64)
        self.prev[after] = codes
        self.doc = np.repeat(np.arange(len(n)), n)
        width = np.int64(len(gid))
        pair, self.pair = np.unique(self.prev * width + self.cur, return_inverse=True)
        self.pair_prev, self.pair_cur = pair // width, pair % width
        c = self.count[self.pair_prev]
        salts = np.where(c >= hot_count, -(-c // hot_count), 1).astype(np.uint64)
        salt = mix64(gid[self.pair_cur] + _SALT) % salts
        self.bucket = (mix64(gid[self.pair_prev] * _SALT + salt) % np.uint64(buckets)).astype(np.int64)
        self.order = np.lexsort((gid[self.pair_cur], gid[self.pair_prev], self.bucket))
        self.gid, self.hot = gid, self.count >= hot_count

    def slices(self):
        """(bucket, rows of ``order``) for each bucket asked."""
        sorted_ = self.bucket[self.order]
        cut = np.nonzero(np.diff(sorted_, prepend=-1, append=-1))[0] if len(sorted_) else np.empty(0, np.int64)
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
            yield int(sorted_[x]), self.order[x:y]


def _rows_of(batches):
    for b in batches:
        yield from b.to_pylist()


def _ask_pairs(*args):
    def run(batches):
        for row in _rows_of(batches):
            b = Block(row, *args)
            learn = np.array(row["train"], bool)[b.doc]
            counts = np.bincount(b.pair[learn], minlength=len(b.pair_prev))
            rows = [(j, row["block"], _z(b.gid[b.pair_prev[s]]), _z(b.gid[b.pair_cur[s]]), _z(counts[s].astype("<u4")), _z(b.count[b.pair_cur[s]].astype("<u8")), _z(b.hot[b.pair_prev[s]])) for j, s in b.slices()]
            yield _batch(rows, PAIR_ASK[0])

    return run


def _merge_pairs(tokens: int, types: int):
    """Global counts of each block's pairs; for each context whether any count of it is discounted (plain), and for one
    with an unseen pair the numbers of its pairs seen 1 to K times and the share of its successors (sums).

    The row with block -1 holds the bucket's part of the model (context, successor, count), how many pairs
    were seen 1 to K + 1 times, and the sums of its frequent contexts, which other buckets share.
    """

    def run(batches):
        for bucket, rows in _groups(batches, 7):
            ctxs = [_uz(r[2], np.uint64) for r in rows]
            ctx, cur = np.concatenate(ctxs), np.concatenate([_uz(r[3], np.uint64) for r in rows])
            order = np.lexsort((cur, ctx))
            new = np.ones(len(order), bool)
            new[1:] = (ctx[order][1:] != ctx[order][:-1]) | (cur[order][1:] != cur[order][:-1])
            at = np.empty(len(order), np.int64)
            at[order] = np.cumsum(new) - 1
            firsts = order[new]
            total = np.bincount(at, np.concatenate([_uz(r[4], "<u4") for r in rows]), len(firsts)).astype(np.int64)
            share = (np.concatenate([_uz(r[5], "<u8") for r in rows])[firsts] + 1.0) / (tokens + types + 1.0)
            hot = np.concatenate([_uz(r[6], bool) for r in rows])[firsts]
            mctx, mcur = ctx[firsts], cur[firsts]
            names, c_at = np.unique(mctx, return_inverse=True)
            sums = np.zeros((len(names), K + 1))
            for r in range(1, K + 1):
                sums[:, r - 1] = np.bincount(c_at, total == r, len(names))
            sums[:, K] = np.bincount(c_at, share * (total > 0), len(names))
            seen = total > 0
            n_of = [int((total == r).sum()) for r in range(1, K + 2)]
            mine = np.unique(c_at[hot])
            packed = np.concatenate([names[mine].astype(np.float64)[:, None], sums[mine]], 1)
            yield _batch([(bucket, -1, _z(total[seen].astype("<u8")), _z(packed.ravel()), None, _z(mctx[seen]), _z(mcur[seen]), n_of)], PAIR_ANSWER[0])
            i = 0
            for r, k in zip(rows, ctxs):
                part = at[i : i + len(k)]
                i += len(k)
                asked, needy = np.unique(c_at[part]), np.unique(c_at[part][total[part] == 0])
                yield _batch([(bucket, r[1], _z(total[part].astype("<u8")), _z(sums[needy].ravel()), _z(sums[asked, :K].any(1)), None, None, None)], PAIR_ANSWER[0])

    return run


def discounts(n_of: list[int]) -> np.ndarray:
    """Katz's Good-Turing discounts of counts 0 to K (that of 0 is unused), from how many pairs were seen 1 to K + 1 times.

    Where these numbers give no proper discount (none seen so often, or outside 0 to 1), it is (r - 0.5) / r.
    """
    d = np.ones(K + 1)
    n = [0, *n_of]
    last = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        star = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
        d[r] = (star - last) / (1 - last) if last < 1 else 0.0
        if not 0 < d[r] < 1:
            d[r] = (r - 0.5) / r
    return d


def _firsts(ctx: np.ndarray) -> np.ndarray:
    """The first of each run of equal contexts."""
    return ctx[np.nonzero(np.diff(ctx, prepend=-1))[0]]


def _score(args, tokens: int, types: int, d: np.ndarray, hot_sums):
    def run(batches):
        hot, hot_values = hot_sums.value
        for row in _rows_of(batches):
            b = Block(row, *args)
            r = np.zeros(len(b.pair_prev), np.int64)
            sums = np.zeros((len(b.gid), K + 1))  # by local code, where a pair is unseen
            cut = np.zeros(len(b.gid), bool)  # some count of the context is discounted
            answers = {a["bucket"]: a for a in row["pairs"] or []}
            for j, s in b.slices():
                r[s] = _uz(answers[j]["counts"], "<u8")
                ctx = b.pair_prev[s]  # in order of global id
                cut[_firsts(ctx)] = _uz(answers[j]["plain"], bool)
                sums[_firsts(ctx[r[s] == 0])] = _uz(answers[j]["sums"], np.float64).reshape(-1, K + 1)
            if len(hot):
                mine = np.nonzero(b.hot)[0]
                at = np.minimum(np.searchsorted(hot, b.gid[mine]), len(hot) - 1)
                mine, at = mine[hot[at] == b.gid[mine]], at[hot[at] == b.gid[mine]]
                sums[mine] = hot_values[at]
                cut[mine] = hot_values[at, :K].any(1)
            c = b.count.astype(np.float64)
            uni = (c + 1) / (tokens + types + 1)
            times = np.arange(1, K + 1)
            kept = c - sums[:, :K] @ (times * (1 - d[1:]))  # discounted counts of a context, summed
            whole = c + ~cut  # no count of it is discounted: one more is set aside
            with np.errstate(divide="ignore", invalid="ignore"):
                alpha = (1 - kept / whole) / (1 - sums[:, K])
                seen = d[np.minimum(r, K)] * r
                seen = np.where(r > K, r, seen) / whole[b.pair_prev]
                p = np.where(r > 0, seen, np.where(c[b.pair_prev] > 0, alpha[b.pair_prev], 1.0) * uni[b.pair_cur])
            n = len(b.sizes)
            score = np.bincount(b.doc, np.log10(p)[b.pair], n)
            base = np.bincount(b.doc, np.log10(uni)[b.cur], n)
            known = np.bincount(b.doc, (c > 0)[b.cur], n).astype(np.int64)
            yield _batch([(i, not t, int(m) + 1, int(k), tokens, float(x), float(y)) for i, t, m, k, x, y in zip(row["doc_ids"], row["train"], b.sizes, known, base, score)], SCORES[0])

    return run


def katz_scores(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    docs: doc_id bigint, text string (null: empty). A-Z are lower-cased; tokens are the runs of
    ``[^\\x20\\x09-\\x0D]`` and one end. Learned from all rows but the held-out fold; a null doc_id is in none.
    base_score: sum of log10((c + 1) / (N + V + 1)) with c the token's count, N all tokens and V distinct
    tokens of training rows. score: log10 probability of the text, its end included, under the bigram model:
    a pair seen r times in training has d_r * r / c(context), d_r being Katz's Good-Turing discount for r up
    to K; any other token gets alpha(context) times the unigram probability (c + 1) / (N + V + 1), in which
    all unknown words are one type. alpha makes each context's probabilities sum to 1. A context not seen in
    training backs off with weight 1; in one where no count is discounted a count of 1 is set aside.
    Repeated rows are learned as often as they come and score alike; other columns are not read; an empty
    table gives an empty table. With no training rows N = V = 0 and every token has probability 1.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", (fold_of(F.col("doc_id"), folds) != held).alias("train"))
    whole = scratch.write(rows.mapInArrow(_cut, BLOCKS[1]), "whole")
    blocks = whole.drop("vocab")
    asked, n_tokens, tokens, train_docs = (int(x or 0) for x in blocks.agg(F.sum("n_vocab"), F.sum("n_tokens"), F.sum("train_tokens"), F.sum("train_docs")).first())
    word_buckets, pair_buckets = max(1, -(-asked // BUCKET)), max(1, -(-n_tokens // BUCKET))
    hot_count = max(HOT_COUNT, math.ceil(tokens / HOT_MOST))

    asks = whole.select("block", "vocab", "counts").mapInArrow(_ask_words(word_buckets), WORD_ASK[1])
    words = scratch.write(_dealt(asks, word_buckets).mapInArrow(_merge_words, WORD_ANSWER[1]), "words")
    settle(spark)
    sizes = {r["bucket"]: (r["n"], r["n_train"]) for r in words.filter("block < 0").select("bucket", "n", "n_train").collect()}
    offsets, at = {}, 0
    for j in sorted(sizes):
        offsets[j], at = at, at + sizes[j][0]
    types = sum(t for _, t in sizes.values()) + (train_docs > 0)
    scratch.write(blocks, "blocks")
    blocks = spark.read.schema(blocks.schema).parquet(scratch.path("blocks"))
    scratch.drop("whole")
    answers = words.filter("block >= 0").groupBy("block").agg(F.collect_list(F.struct("bucket", "ranks", "counts")).alias("answers"))
    told = blocks.join(answers, "block", "left").withColumn("answers", F.coalesce("answers", F.array().cast("array<struct<bucket:int,ranks:binary,counts:binary>>")))
    args = (offsets, pair_buckets, hot_count, train_docs)

    asks = told.select("block", "train", "sizes", "codes", "counts", "answers").mapInArrow(_ask_pairs(*args), PAIR_ASK[1])
    pairs = scratch.write(_dealt(asks, pair_buckets).mapInArrow(_merge_pairs(tokens, types), PAIR_ANSWER[1]), "pairs")
    del asks
    settle(spark)
    model = pairs.filter("block < 0")
    n_of = [int(x or 0) for x in model.agg(*[F.sum(F.col("n_of")[i]) for i in range(K + 1)]).first()]
    # contexts dealt over several buckets: at most HOT_MOST, as each has its HOT_MOST-th part of the tokens; 56 bytes each
    hot, hot_values = np.empty(0, np.uint64), np.empty((0, K + 1))
    for r in model.select("sums").toLocalIterator():
        x = _uz(r["sums"], np.float64).reshape(-1, K + 2)
        if len(x):
            hot, at = np.unique(np.concatenate([hot, x[:, 0].astype(np.uint64)]), return_inverse=True)
            both = np.concatenate([hot_values, x[:, 1:]])
            hot_values = np.stack([np.bincount(at, both[:, c], len(hot)) for c in range(K + 1)], 1)
    back = pairs.filter("block >= 0").groupBy("block").agg(F.collect_list(F.struct("bucket", "counts", "sums", "plain")).alias("pairs"))
    full = told.join(back, "block", "left").select("block", "doc_ids", "train", "sizes", "codes", "counts", "answers", "pairs")
    out = kept_whole(full.mapInArrow(_score(args, tokens, types, discounts(n_of), spark.sparkContext.broadcast((hot, hot_values))), SCORES[1]))
    scratch.drop()
    return out


def _dealt(asks: DataFrame, buckets: int) -> DataFrame:
    """Each bucket to a task of its own: by hash, several might meet in one."""
    return asks.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "block")
