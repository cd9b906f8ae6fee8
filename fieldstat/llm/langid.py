"""Language identification: averaged hashed subword embeddings, linear softmax, calibrated rejection."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, kept_whole, mix64, small_batches, without, words_of, worker_table
from .words import ROWS, KeyTable, keys, split_words

#: Subwords: runs of 2 to 5 bytes of a word between marks; 2**16 buckets of 16 numbers.
GRAMS, BUCKETS, DIM = (2, 3, 4, 5), 1 << 16, 16
#: Words a worker's table holds (about 100 bytes each); new ones are worked out so many at a time.
MOST_WORDS, PART = 400_000, 10_000


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every subword, for all words at once."""
    joined = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(joined))  # bytes up to the end of the word
    owners, buckets = [], []
    packed = joined.copy()
    for n in range(2, max(GRAMS) + 1):
        packed = packed[: len(joined) - n + 1] | (joined[n - 1 :] << np.uint64(8 * (n - 1)))
        if n in GRAMS:
            ok = left[: len(packed)] >= n
            owners.append(owner[: len(packed)][ok])
            buckets.append((mix64(packed[ok] + np.uint64(n)) >> np.uint64(48)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # embedding of each bucket, times the weights where that has fewer columns
    weights: np.ndarray  # columns of the table x languages; the unit matrix if the table has been multiplied
    bias: np.ndarray
    temperature: float
    threshold: float  # confidence below which a document is rejected


def _features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    _, b = word_grams(words)
    idx, n = np.unique(b, return_counts=True)
    return idx.astype(np.int32), (n / n.sum()).astype(np.float32)


def train(texts: list[str], langs: list[str], epochs: int = 4, rate: float = 0.5, seed: int = 7, lose: float = 0.001) -> Model:
    """Stochastic gradient descent, one document a step; a fifth of the rows is held back for calibration.

    Each training row is also seen as a random run of 5 to 20 of its words, so short texts are learned too.
    Calibration: the temperature with the least log loss on held-back rows and short runs; the rejection
    threshold is the confidence that only a share ``lose`` of the held-back rows rightly named falls below.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    names = sorted(set(langs))
    code = {x: i for i, x in enumerate(names)}
    c = max(1, len(names))
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, c), np.float32), np.zeros(c, np.float32)
    rows = [(words_of(t), code[y]) for t, y in zip(texts, langs)]
    rows = [r for r in rows if r[0]]

    def short(words):
        k = int(rng.integers(5, 21))
        i = int(rng.integers(0, max(1, len(words) - k + 1)))
        return words[i : i + k]

    order = rng.permutation(len(rows))
    held, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    data = [(*_features(x), y) for i in fit for x, y in ((rows[i][0], rows[i][1]), (short(rows[i][0]), rows[i][1]))]
    steps, total = 0, epochs * len(data)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            idx, share, y = data[k]
            e = emb[idx]
            hidden = share @ e
            z = hidden @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            lr = rate * (1 - steps / total)
            back = w @ p
            w -= lr * np.outer(hidden, p)
            bias -= lr * 0.01 * p
            emb[idx] = e - lr * 10 * share[:, None] * back
            steps += 1

    def logits(words):
        idx, share = _features(words)
        return share @ emb[idx] @ w + bias

    z = np.array([logits(x) for i in held for x in (rows[i][0], short(rows[i][0]))]).reshape(-1, c)
    y = np.array([rows[i][1] for i in held for _ in range(2)], np.int64)

    def soft(t):
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    if len(z):
        grid = np.geomspace(0.2, 5, 25)
        temperature = float(grid[np.argmin([-np.log(soft(t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid])])
        p = soft(temperature)
        right = p.max(1)[(p.argmax(1) == y)]
        threshold = float(min(0.5, np.quantile(right, lose))) if len(right) else 0.0
    else:
        temperature, threshold = 1.0, 0.0
    if c < DIM:
        emb, w = emb @ w, np.eye(c, dtype=np.float32)
    return Model(names, emb, w, bias, temperature, threshold)


def fit(docs: DataFrame, folds: int = 4, held: int = 2, per_lang: int = 600, most_rows: int = 30_000, most_bytes: int = 64_000_000) -> Model:
    """Learn from text and non-null lang of rows outside the held-out fold; every lang value there is learned.

    A sample of labelled rows by hash of doc_id: about ``per_lang`` rows a language, fewer where that makes more than
    ``most_rows`` rows or ``most_bytes`` bytes of text in all. A language that this leaves without a row gets one: that of the least hash among its rows of at most
    its even share of ``most_bytes``, or its shortest one if all are longer. The texts go to the driver, so these bound its memory.
    """
    spark = docs.sparkSession
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id"), folds) != held))
    size = F.octet_length("text").cast("bigint")
    counts = [tuple(r) for r in usable.groupBy("lang").agg(F.count("*"), F.sum(size)).collect()]  # one row a language
    if not counts:
        return Model([], np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, 1), np.float32), np.zeros(1, np.float32), 1.0, 0.0)
    per_lang = max(1, min(per_lang, most_rows // len(counts)))
    shares = [(lang, min(1.0, per_lang / n)) for lang, n, _ in counts]
    less = min(1.0, most_bytes / max(1.0, sum(share * size for (_, share), (_, _, size) in zip(shares, counts))))
    shares = spark.createDataFrame([(lang, share * less) for lang, share in shares], "lang string, share double")
    dice = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1_000_000
    rows = usable.join(F.broadcast(shares), "lang").filter(dice < F.col("share")).select("text", "lang").toPandas()
    lost = sorted({lang for lang, *_ in counts} - set(rows["lang"]))
    if lost:
        even = most_bytes // len(counts)
        first = F.struct(F.greatest(size, F.lit(even)), dice, F.xxhash64("text"), F.xxhash64("text", F.lit(1)))
        few = F.broadcast(spark.createDataFrame([(x,) for x in lost], "lang string"))
        more = usable.join(few, "lang").groupBy("lang").agg(F.min_by("text", first).alias("text"))  # one text a language leaves each task
        rows = pd.concat([rows, more.select("text", "lang").toPandas()])
    rows = rows.sort_values(["lang", "text"])  # the same model whatever order the rows came in
    return train(rows["text"].tolist(), rows["lang"].tolist())


class WordVectors(KeyTable):
    """Word -> the sum of its subwords' rows of the model's table, and their number."""

    arrays = ("key", "uses", "sums")

    def __init__(self, model: Model, limit: int = MOST_WORDS):
        self.model, self.width = model, model.table.shape[1]
        super().__init__(limit)

    def _new(self, room: int) -> None:
        super()._new(room)
        self.sums = np.zeros((room, self.width + 1), np.float32)

    def rows_of(self, words: pa.Array) -> np.ndarray:
        key = keys(words)
        rows = self.find(key)
        if self.make_room(int((rows < 0).sum())):
            rows = self.find(key)
        new = np.nonzero(rows < 0)[0]
        for i in range(0, len(new), PART):
            part = new[i : i + PART]
            rows[part] = self.new_rows(key[part])
            owner, bucket = word_grams(words.take(pa.array(part)).cast(pa.large_binary()).to_pylist())
            for c in range(self.width):
                self.sums[rows[part], c] = np.bincount(owner, self.model.table[bucket, c], len(part))
            self.sums[rows[part], -1] = np.bincount(owner, minlength=len(part))
        return rows


def _named(model: Model, known: WordVectors, texts: pa.Array):
    """(languages, scores, rejected) of texts."""
    n = len(texts)
    if not model.langs:
        return ["und"] * n, np.zeros(n), np.ones(n, bool)
    words, which, bounds = split_words(texts)
    rows = known.rows_of(words)
    known.uses[rows] += np.bincount(which, minlength=len(rows)).astype(np.float32)
    rows[pc.equal(words, "").to_numpy(zero_copy_only=False)] = -1  # among split words, not a word
    rows = rows[which]
    sums, owner = np.zeros((n, known.width + 1)), np.repeat(np.arange(n), np.diff(bounds))
    for i in range(0, len(rows), 50_000):  # what a text's words add up to, so many words at a time
        r, o = rows[i : i + 50_000], owner[i : i + 50_000]
        starts = np.nonzero(np.diff(o, prepend=-1))[0]
        sums[o[starts]] += np.add.reduceat(known.sums[r] * (r >= 0)[:, None], starts, 0, dtype=np.float64)
    lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False) & (sums[:, -1] > 0)
    z = (sums[:, :-1] / np.maximum(sums[:, -1:], 1) @ model.weights + model.bias) / model.temperature
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    score = np.where(lettered, p.max(1), 0.0)
    return [model.langs[k] if ok else "und" for k, ok in zip(best.tolist(), lettered.tolist())], score, ~lettered | (score < model.threshold)


def _predict(model: Model):
    mark = zlib.crc32(model.table.tobytes() + model.weights.tobytes())

    def run(batches):
        known = worker_table(("vectors", mark), lambda: WordVectors(model))
        for b in small_batches(batches, ROWS):
            langs, scores, rejected = _named(model, known, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "h", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, h, lang_pred, score, rejected) for every row of ``docs`` (doc_id bigint, text string), from the text alone.

    h: the text's xxhash64. Whole texts are read. Null texts and texts without a letter get ``und``, score 0,
    rejected; so does every text if no language was learned. Otherwise lang_pred is the likeliest learned
    language and score its calibrated probability; rejected says that it lies below the model's threshold.
    A null doc_id stays null. Repeated rows get equal answers; other columns are not read; an empty table gives
    an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text"), "text")
    return kept_whole(rows.mapInArrow(_predict(model), "doc_id bigint, h bigint, lang_pred string, score double, rejected boolean"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose text :func:`identify` doesn't reject."""
    return without(docs, identify(docs, model).filter("rejected"))
