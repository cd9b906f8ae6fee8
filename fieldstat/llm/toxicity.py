"""Toxicity: non-negative positive-unlabelled learning of a linear classifier."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL, Scratch, fold_of, kept_whole, settings, small_batches, worker_table
from .words import ROWS, KeyTable, folded, keys, split_words, spread

#: Leading bytes of longer words that count as features besides the whole word.
STEMS = (3, 4, 5, 6)
#: Marks that are cut off either end of a word.
EDGES = ".,;:!?\"'()[]{}<>"
#: Words a worker's table holds, about 40 bytes each.
MOST_WORDS = 500_000


def features_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, 64-bit feature) of every word without the marks at its ends, and of its stems."""
    bare = pc.ascii_trim(words.cast(pa.large_string()), characters=EDGES).cast(pa.large_binary())
    size = pc.binary_length(bare).to_numpy()
    owner, found = [np.nonzero(size)[0]], [folded(keys(bare))[size > 0]]
    for k in STEMS:
        longer = np.nonzero(size > k)[0]
        owner.append(longer)
        stem = keys(pc.binary_slice(bare.take(pa.array(longer)), 0, k))
        stem[:, 1] |= np.uint64(0x80 << 56)  # no word's name has this bit and so few bytes
        found.append(folded(stem))
    return np.concatenate(owner), np.concatenate(found)


@dataclass
class Model:
    words: np.ndarray  # sorted features
    weights: np.ndarray
    bias: float


class WordFeatures(KeyTable):
    """Word -> the numbers of its features among a sorted list of wanted ones, in one pool."""

    arrays = ("key", "uses", "start", "size")

    def __init__(self, wanted: np.ndarray, limit: int = MOST_WORDS):
        self.wanted = wanted
        super().__init__(limit)

    def _new(self, room: int) -> None:
        super()._new(room)
        self.start, self.size, self.pool = np.zeros(room, np.int64), np.zeros(room, np.int32), np.empty(0, np.int32)

    def make_room(self, more: int) -> bool:
        pool = self.pool
        out = super().make_room(more)
        if out:  # the kept words' numbers move together
            rows = np.arange(self.n)
            self.pool = pool[spread(self.start[rows], self.size[rows])]
            self.start[rows] = np.cumsum(self.size[rows]) - self.size[rows]
        return out

    def sets(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, number) of each wanted feature of each text, once, in order."""
        words, which, bounds = split_words(texts)
        key = keys(words)
        rows = self.find(key)
        if self.make_room(int((rows < 0).sum())):
            rows = self.find(key)
        new = np.nonzero(rows < 0)[0]
        if len(new):
            owner, f = features_of(words.take(pa.array(new)))
            at = np.minimum(np.searchsorted(self.wanted, f), max(0, len(self.wanted) - 1))
            hit = self.wanted[at] == f if len(self.wanted) else np.zeros(len(f), bool)
            owner, at = owner[hit], at[hit]
            order = np.argsort(owner, kind="stable")
            rows[new] = r = self.new_rows(key[new])
            self.size[r] = np.bincount(owner, minlength=len(new))
            self.start[r] = len(self.pool) + np.cumsum(self.size[r]) - self.size[r]
            self.pool = np.concatenate([self.pool, at[order].astype(np.int32)])
        self.uses[rows] += np.bincount(which, minlength=len(rows)).astype(np.float32)
        size = self.size[rows].astype(np.int64)
        told = np.nonzero(size[which])[0]  # words with a wanted feature
        text = np.searchsorted(bounds, told, "right") - 1
        n = size[which[told]]
        number = self.pool[spread(self.start[rows][which[told]], n)].astype(np.int64)
        both = np.unique(np.repeat(text, n) * np.int64(max(1, len(self.wanted))) + number)
        return both // max(1, len(self.wanted)), both % max(1, len(self.wanted))


def telling(n: np.ndarray, positives: int, other: np.ndarray, rows: int, least_rows: int, least_z: float, chance: float) -> np.ndarray:
    """Which features are more frequent among positives than chance explains.

    n, other: in how many of the ``positives`` and of the ``rows`` unlabelled documents each one is. The standard score of
    the difference in document frequency is at least ``least_z``, and more where as many features are tried
    that one would pass by chance with probability ``chance`` (Bonferroni).
    """
    if not positives or not rows or not len(n):
        return np.zeros(len(n), bool)
    both = (n + other + 1) / (positives + rows + 2)
    z = (n / positives - other / rows) / np.sqrt(both * (1 - both) * (1 / positives + 1 / rows))
    tried = n >= least_rows
    return tried & (z >= max(least_z, NormalDist().inv_cdf(1 - chance / max(1, tried.sum()))))


def train_nnpu(words: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 300, batch: int = 8192, rate: float = 0.05, decay: float = 3e-4, seed: int = 5) -> Model:
    """Minimise prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) with the logistic loss.

    Where a batch's estimate of the negative risk falls below 0 the step goes up its gradient instead, which
    keeps a flexible model from fitting the unlabelled rows. Steps are Adam's, with weight decay. A row is
    the numbers of its features among ``words``.
    """
    if not positive or not unlabelled:
        return Model(words[:0], np.zeros(0), float(np.log((prior + 1e-6) / (1 - prior + 1e-6))))
    xp, xu = positive, unlabelled
    d = len(words)
    w = np.zeros(d + 1)
    w[d] = np.log((prior + 1e-6) / (1 - prior + 1e-6))
    m, v, t = np.zeros(d + 1), np.zeros(d + 1), 0
    rng = np.random.Generator(np.random.PCG64(seed))
    batch = min(batch, len(xu))
    steps = len(xu) // batch

    def forward(rows):
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.concatenate(rows) if sizes.sum() else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(rows)), sizes)
        z = np.bincount(owner, w[flat], len(rows)) + w[d]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50))), z, flat, owner

    def back(g, flat, owner):
        out = np.bincount(flat, g[owner], d + 1)
        out[d] = g.sum()
        return out

    for _ in range(epochs):
        pick = rng.permutation(len(xu))
        for k in range(steps):
            bu = [xu[i] for i in pick[k * batch : (k + 1) * batch]]
            bp = [xp[i] for i in rng.integers(0, len(xp), batch)]
            pp, zp, fp, op = forward(bp)
            pu, zu, fu, ou = forward(bu)
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            g_negative = back(pu / len(bu), fu, ou) - prior * back(pp / len(bp), fp, op)
            if negative < 0:
                g = -g_negative
            else:
                g = prior * back((pp - 1) / len(bp), fp, op) + g_negative
            g[:d] += decay * w[:d]
            t += 1
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(words, w[:d], float(w[d]))


def _count_all(batches):
    """(feature, n) of a task: in how many texts each feature is, for a sample of texts."""
    total: dict[int, int] = {}
    for b in small_batches(batches, ROWS):
        words, which, bounds = split_words(b.column(0))
        owner, f = features_of(words)
        order = np.argsort(owner, kind="stable")
        f, size = f[order], np.bincount(owner, minlength=len(words))
        start = np.cumsum(size) - size
        text = np.repeat(np.repeat(np.arange(b.num_rows), np.diff(bounds)), size[which])
        names, number = np.unique(f[spread(start[which], size[which])], return_inverse=True)
        _, number = np.divmod(np.unique(text * np.int64(max(1, len(names))) + number), max(1, len(names)))
        for k, n in zip(names.tolist(), np.bincount(number, minlength=len(names)).tolist()):
            total[k] = total.get(k, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(total.keys(), np.uint64, len(total)).view(np.int64)), pa.array(list(total.values()), pa.int64())], ["feature", "n"])


def _count_wanted(wanted):
    def run(batches):
        """One row a task: how many texts, and in how many of them each wanted feature is."""
        names = wanted.value
        known = worker_table(("counts", zlib.crc32(names.tobytes())), lambda: WordFeatures(names))
        n, rows = np.zeros(len(names), np.int64), 0
        for b in small_batches(batches, ROWS):
            n += np.bincount(known.sets(b.column(0))[1], minlength=len(names))
            rows += b.num_rows
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], rows))], ["number", "n"])

    return run


def _rows(wanted):
    def run(batches):
        names = wanted.value
        known = worker_table(("rows", zlib.crc32(names.tobytes())), lambda: WordFeatures(names))
        for b in small_batches(batches, ROWS):
            text, number = known.sets(b.column(1))
            cut = np.searchsorted(text, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(number, pa.int32()))], ["positive", "features"])

    return run


def fit(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, prior: float | None = None,
    positives: int = 4000, unlabelled: int = 8000, most_bytes: int = 16_000_000, least_rows: int = 3, least_z: float = 5.0, chance: float = 0.05,
) -> Model:
    """Learn from rows outside the held-out fold. Confirmed toxic: labels.toxic = 1; the labels of other rows are not used as negatives.

    The class prior is the share of toxic rows among the labelled ones of these folds, unless given. Features
    are tried if ``least_rows`` sampled positives have them; in how many documents each of them is, is counted
    over all rows. All that :func:`telling` finds are used. The classifier is fitted on samples by hash of
    doc_id of about ``positives`` confirmed and ``unlabelled`` unlabelled rows, fewer where the positives' texts would
    come to more than ``most_bytes`` bytes. The driver receives the features tried, with counts, and the sampled
    rows' feature numbers, never texts. Null texts and ids are not learned from; a doc_id with several labels is toxic if one says so.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    learn = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (fold_of(F.col("doc_id"), folds) != held))
    marked = labels.select("doc_id", "toxic").filter(F.col("toxic").isNotNull() & (fold_of(F.col("doc_id"), folds) != held))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = (int(x or 0) for x in marked.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("int"))).first())
    if prior is None:
        prior = min(0.95, max(0.001, toxic / n)) if n else 0.01
    dice = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_000)) / 1_000_000
    drawn = marked.filter((F.col("toxic") == 1) & (dice < positives / max(1, toxic))).select("doc_id")  # about ``positives`` ids, each once
    yes = learn.join(F.broadcast(drawn), "doc_id", "left_semi")
    yes = scratch.write(yes.withColumn("dice", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_000)) / 1_000_000), "positives")
    size = yes.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    yes = yes.filter(F.col("dice") < most_bytes / max(1, size))
    tried = yes.select("text").mapInArrow(_count_all, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_rows)
    with settings(spark, SMALL):
        tried = tried.toPandas().sort_values("feature")  # at most most_bytes features in all, of which most are rare
    names = tried["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    names, among = names[order], tried["n"].to_numpy(np.int64)[order]
    counts = learn.select("text").mapInArrow(_count_wanted(spark.sparkContext.broadcast(names)), "number bigint, n bigint").groupBy("number").agg(F.sum("n").alias("n"))
    with settings(spark, SMALL):
        counts = dict(counts.toPandas().itertuples(index=False))
    total = int(counts.pop(-1, 0))
    other = np.zeros(len(names), np.int64)
    other[list(map(int, counts))] = list(map(int, counts.values()))
    words = names[telling(among, yes.count(), other, total, least_rows, least_z, chance)]
    any_ = learn.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) / 1_000_000 < unlabelled / max(1, total))
    rows = yes.select(F.lit(True).alias("positive"), "text").union(any_.select(F.lit(False), "text"))
    rows = rows.mapInArrow(_rows(spark.sparkContext.broadcast(words)), "positive boolean, features array<int>")
    p, u = [], []
    with settings(spark, SMALL):
        for r in sorted(rows.collect(), key=lambda r: (len(r["features"]), r["features"])):
            (p if r["positive"] else u).append(np.array(r["features"], np.int64))
    scratch.drop()
    return train_nnpu(words, p, u, prior)


def _score(model: Model):
    mark = zlib.crc32(model.words.tobytes() + model.weights.tobytes())

    def run(batches):
        known = worker_table(("score", mark), lambda: WordFeatures(model.words))
        for b in small_batches(batches, ROWS):
            text, number = known.sets(b.column(1))
            z = np.bincount(text, model.weights[number], b.num_rows) + model.bias
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], ["doc_id", "score"])

    return run


def rate(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs`` (doc_id bigint, text string), from the text alone.

    score: estimated probability of label 1; predicted: 1 if score >= 0.5, else 0. Whole texts are read. Null
    and empty texts have no words and get the score of the bias. Without positives or unlabelled rows to
    learn from, every text gets the class prior. A null doc_id stays null. Repeated rows get equal scores;
    other columns are not read; an empty table gives an empty table.
    """
    out = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_score(model), "doc_id bigint, score double")
    return kept_whole(out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
