import hashlib
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash

from fieldstat.llm import decontam, langid, lm, toxicity
from fieldstat.llm.common import Scratch
from fieldstat.llm.words import split_words

from .helpers import awkward, docs, low, mix, plain_language, prose, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(rows, items):
    win = {}
    for item, t in items:
        w = WORD.findall(low(t))
        for s in range(max(1, len(w) - 9) if w else 0):
            win.setdefault(tuple(w[s : s + 10]), set()).add(item)
    out = []
    for d, t in rows:
        w, hit, ids = WORD.findall(low(t)), set(), set()
        for k in {len(x) for x in win}:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in win:
                    hit |= set(range(s, s + k))
                    ids |= win[tuple(w[s : s + k])]
        names = ",".join(sorted(map(str, ids)))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


COLS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontamination_matches_brute_force(spark):
    passage = prose(70, 25)
    items = [(1, passage), (2, passage.upper()), (3, None), (4, ""), (5, "one two three"), (6, prose(71, 30)), (7, prose(72, 9)), (8, "absent words only here"), (10, passage), (10, prose(1, 40))]
    rows = awkward() + [(300, prose(73, 30) + " " + passage + " " + prose(74, 30)), (301, " ".join(passage.split()[3:13])), (302, " ".join(passage.split()[3:12])), (303, prose(72, 9) + "!"), (304, passage + " ... " + passage)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for clash in (False, True):
        assert table(decontam.decontaminate(docs(spark, rows, clash=clash), bench), *COLS) == brute_hits(rows, items)
    assert {r[2] for r in table(decontam.decontaminate(docs(spark), bench.limit(0)), *COLS)} == {0}
    assert decontam.decontaminate(docs(spark, []), bench).count() == 0


def test_contaminated_rows_that_repeat_keep_their_hits(spark):
    passage = prose(70, 25)
    text = prose(75, 20) + " " + passage
    items = [(1, passage), (5, "one two three")]
    rows = [(400, text)] * 2 + [(401, passage)] * 3 + [(402, text), (None, text), (None, text), (403, "one two three"), (403, "one two three"), (404, prose(76, 40))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = table(decontam.decontaminate(docs(spark, rows), bench), *COLS)
    assert got == brute_hits(rows, items) and sum(r[5] for r in got) == 10


def test_proximity(spark):
    d = docs(spark, [(1, "a b c d e"), (2, "a x x x x b"), (3, "b a"), (4, "a")])
    index = Scratch(spark, "prox").write(decontam.postings(decontam.keyed(d)), "index")
    q = spark.createDataFrame([(1, "a"), (1, "b"), (2, "zzz"), (3, "a")], "query_id bigint, term string")
    assert sorted({(r["query_id"], r["doc_id"]) for r in decontam.proximity_matches(index, q, 2).collect()}) == [(1, 1), (1, 3), (3, 1), (3, 2), (3, 3), (3, 4)]


def lang_rows():
    en = "the and of that with this from have there which would people"
    de = "der und nicht eine werden schule über straße müssen zwischen durch"
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        words = (en if i % 2 else de).split()
        rows.append((i, " ".join(rng.choice(words, 30)), "en" if i % 2 else "de"))
    return rows + [(500, None, "en"), (501, "", "de"), (502, "123 456 !!", None), (503, "the " * 20000, None), (None, "durch die straße", "de")]


def test_language_identification(spark):
    df = spark.createDataFrame(lang_rows(), "doc_id bigint, text string, lang string")
    model = langid.fit(df)
    out = {r["doc_id"]: r for r in langid.identify(df.withColumn("score", df["doc_id"]), model).collect()}
    assert all(out[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(120))
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 and out[i]["rejected"] for i in (500, 501, 502))
    assert out[503]["lang_pred"] == "en" and out[None]["lang_pred"] == "de" and 0 <= out[503]["score"] <= 1
    kept = langid.accepted(df, model)
    assert kept.columns == df.columns and kept.count() == df.count() - 3
    assert langid.identify(df.limit(0), model).count() == 0
    empty = langid.fit(df.limit(0))
    assert {r["lang_pred"] for r in langid.identify(df, empty).collect()} == {"und"}


def test_toxicity(spark):
    rows = [(i, prose(i, 60) + (" horrid vileword" if i % 4 == 0 else "")) for i in range(400)]
    df = docs(spark, rows + [(1000, None), (1001, ""), (1002, "horrid " * 30000)])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 400)] + [(3, 1, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(df, labels)
    out = {r["doc_id"]: r for r in toxicity.rate(df.withColumn("score", df["doc_id"]), model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.97
    assert out[1000]["score"] == out[1001]["score"] and 0 <= out[1000]["score"] < 0.5
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    assert toxicity.rate(df, toxicity.fit(df, labels.limit(0))).count() == 403
    assert toxicity.rate(df.limit(0), model).count() == 0


def model_scores(m, rows):
    return [1 / (1 + np.exp(-(m.bias + m.weights[r].sum()))) for r in rows]


def test_nnpu_risk_does_not_go_below_zero():
    rng = np.random.default_rng(1)
    pos = [np.sort(np.append(rng.choice(np.arange(1, 400), 20, False), 0)) for _ in range(60)]
    neg = [np.sort(rng.choice(np.arange(1, 400), 20, False)) for _ in range(540)]
    every = neg + pos
    n, other = (np.bincount(np.concatenate(x), minlength=400) for x in (pos, every))
    keep = np.nonzero(toxicity.telling(n, 60, other, 600, 3, 5.0, 0.05))[0]
    assert keep.tolist() == [0]
    pos, every = ([np.nonzero(np.isin(keep, r))[0] for r in x] for x in (pos, every))
    m = toxicity.train_nnpu(keep.astype(np.uint64), pos, every, 0.1)
    assert min(model_scores(m, pos)) > 0.5 > max(model_scores(m, every[:540]))


def test_toxicity_keeps_rare_words_beside_frequent_ones():
    """One word is in 90 % of toxic documents; the others have one of five rarer words alone."""
    rng = np.random.default_rng(2)
    one = lambda i: 0 if i % 10 else 1 + i // 10 % 5
    text = lambda *more: np.sort(np.append(rng.choice(np.arange(6, 420), 20, False), np.array(more, np.int64)))
    pos = [text(one(i)) for i in range(4000)]
    unl = [text(one(i)) if i < 880 else text() for i in range(8000)]
    n, other = (np.bincount(np.concatenate(x), minlength=420) for x in (pos, unl))
    keep = np.nonzero(toxicity.telling(n, 4000, other, 8000, 3, 5.0, 0.05))[0]
    assert set(range(6)) <= set(keep.tolist())
    pos, unl = ([np.nonzero(np.isin(keep, r))[0] for r in x] for x in (pos, unl))
    m = toxicity.train_nnpu(keep.astype(np.uint64), pos, unl, 0.11)
    assert min(model_scores(m, pos)) > 0.3 > 0.05 > max(model_scores(m, unl[880:]))


def plain_features(text):
    """64-bit features of a text's words and stems, on Python integers."""

    def name(w, stem=False):
        if len(w) > 15:
            lo, hi = struct.unpack("<QQ", xxhash.xxh3_128_digest(w))
            hi |= 0xFF << 56
        else:
            lo, hi = int.from_bytes(w[:8], "little"), int.from_bytes(w[8:], "little") | len(w) << 56 | (0x80 << 56 if stem else 0)
        return mix(lo ^ mix(hi))

    words = {w.strip(b".,;:!?\"'()[]{}<>") for w in (text or "").encode().lower().split()} - {b""}
    return {name(w) for w in words} | {name(w[:k], True) for w in words for k in (3, 4, 5, 6) if len(w) > k}


def test_toxicity_equals_a_plain_version(spark):
    rows = [(i, prose(i, 40) + (" Horrid! vileword" if i % 4 == 0 else "")) for i in range(300)]
    rows += [(5, prose(5, 40)), (1000, None), (1001, ""), (1002, "horrid, " * 3000 + "incomprehensibilities \"(vile)\" über"), (None, "horrid"), *awkward()]
    df = docs(spark, rows, clash=True)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)] + [(4, 1, 0), (None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(df, labels, least_z=3.0)
    learn = [(i, t) for i, t in rows if t is not None and not (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)]
    learn = [(i, t) for i, t in learn]
    pos = [plain_features(t) for i, t in learn if i is not None and i < 300 and i % 4 == 0 and i in range(300)]
    count = lambda sets: {f: sum(f in s for s in sets) for f in set().union(*sets)}
    n, other = count(pos), count([plain_features(t) for _, t in learn])
    names = sorted(f for f in n if n[f] >= 3)
    keep = toxicity.telling(np.array([n[f] for f in names]), len(pos), np.array([other[f] for f in names]), len(learn), 3, 3.0, 0.05)
    assert model.words.tolist() == [f for f, k in zip(names, keep) if k] and len(model.words) >= 2
    weight = dict(zip(model.words.tolist(), model.weights))
    got = sorted(((r["doc_id"], round(r["score"], 9), r["predicted"]) for r in toxicity.rate(df, model).collect()), key=repr)
    want = [(i, 1 / (1 + math.exp(-(model.bias + sum(weight.get(f, 0) for f in plain_features(t)))))) for i, t in rows]
    assert got == sorted(((i, round(float(s), 9), int(s >= 0.5)) for i, s in want), key=repr)


def test_languages_equal_a_plain_version(spark):
    rows = [*lang_rows(), *[(i, t, None) for i, t in awkward()], (600, "  \x0b Über-Straße,\tDER x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for c in ("h", "score", "k_id", "rejected"):
        df = df.withColumn(c, df["doc_id"])
    model = langid.fit(df)

    plain = lambda text: plain_language(model, text)
    want = sorted(((i, x[0], round(x[1], 4), x[2]) for i, t, _ in rows for x in [plain(t)]), key=repr)
    assert sorted(((r["doc_id"], r["lang_pred"], round(r["score"], 4), r["rejected"]) for r in langid.identify(df, model).collect()), key=repr) == want
    kept = langid.accepted(df, model)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(i or 0 for i, t, _ in rows if not plain(t)[2])


def test_no_language_is_lost_to_a_small_share(spark):
    """Bounds that leave far less than one row a language on average still leave one each, of bounded size."""
    from pyspark.sql import functions as F

    from fieldstat.llm import langid

    seen, plain = [], langid.train
    a, b, c = [i for i in range(5000, 5100) if zlib.crc32(str(i).encode()) % 4 != 2][:3]
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string"), F.when(F.col("id") % 10 == 1, F.repeat(F.lit(" long"), 2000)).otherwise("")).alias("text"), F.concat(F.lit("l"), F.floor(F.col("id") / 10).cast("string")).alias("lang"))
    same = spark.createDataFrame([(a, f"one id {i}", "same") for i in range(50)] + [(b, "x" * 100_000, "only long"), (c, "y" * 90_000, "only long")], "doc_id bigint, text string, lang string")
    rows = rows.union(same)
    langid.train = lambda texts, langs: seen.append((texts, langs))
    try:
        langid.fit(rows, most_rows=300)
        langid.fit(rows, most_bytes=30_000)
        langid.fit(rows.repartition(7), most_bytes=30_000)
    finally:
        langid.train = plain
    for texts, langs in seen:
        assert len(set(langs)) == 302 and len(langs) < 700
    assert seen[1] == seen[2]  # the same rows however they are dealt
    texts, langs = seen[1]
    assert sum(map(len, texts)) < 250_000 and sum(len(t) > 100 for t in texts) < 10  # of 3.2 million; languages without a drawn row give a short one
    assert dict(zip(langs, texts))["only long"][0] == "y"


def test_every_language_is_learned(spark):
    abc = "abcdefghijklmnopqrstuvwxyz"
    name = lambda k: (abc[k % 26] + abc[k // 26]) * 2
    rows = [(1000 * k + i, " ".join(name(k) + abc[(i * j) % 26] for j in range(20)), f"l{k:03d}") for k in range(300) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(df)
    assert len(model.langs) == 300
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.8 and len(set(got.values())) > 250
    assert len(langid.fit(df, most_bytes=20_000).langs) == 300  # however tight the bound, each language keeps a row



def brute_lm(rows):
    tok = lambda t: (t or "").encode().lower().split()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    from collections import Counter

    uni, pairs, docs_ = Counter(), Counter(), 0
    for d, t in rows:
        if not held(d):
            w = tok(t) + [1]
            uni.update(w)
            pairs.update(zip([0] + w, w))
            docs_ += 1
    n, v = sum(uni.values()), len(uni)
    c = dict(uni) | {0: docs_}
    n_of = Counter(pairs.values())
    d = lm.discounts([n_of[r] for r in range(1, lm.K + 2)])
    p_uni = lambda w: (uni.get(w, 0) + 1) / (n + v + 1)
    kept, seen = Counter(), Counter()
    for (h, w), r in pairs.items():
        kept[h] += d[r] * r if r <= lm.K else r
        seen[h] += p_uni(w)

    def p(h, w):
        if not c.get(h):
            return p_uni(w)
        whole = c[h] + (kept[h] >= c[h] * (1 - 1e-12))
        r = pairs.get((h, w), 0)
        return (d[r] * r if r <= lm.K else r) / whole if r else (1 - kept[h] / whole) / (1 - seen[h]) * p_uni(w)

    for h in list(c)[:20]:  # each context's probabilities sum to 1
        assert abs(sum(p(h, w) for w in uni) + p(h, "unknown") - 1) < 1e-9
    out = []
    for i, t in rows:
        w = tok(t) + [1]
        out.append((i, held(i), len(w), sum(uni.get(x, 0) > 0 for x in w), n, sum(math.log10(p_uni(x)) for x in w), sum(math.log10(p(h, x)) for h, x in zip([0] + w, w))))
    return sorted(out, key=repr)


def test_katz_scores_match_brute_force(spark, monkeypatch):
    want = brute_lm(awkward())
    for bucket, hot in ((lm.BUCKET, lm.HOT_COUNT), (700, 20)):
        monkeypatch.setattr(lm, "BUCKET", bucket)
        monkeypatch.setattr(lm, "HOT_COUNT", hot)
        got = table(lm.katz_scores(docs(spark, clash=True)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        assert len(got) == len(want)
        key = lambda r: (repr(r[0]), r[2], round(r[6], 6))
        for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
            assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 * abs(w[5]) and abs(g[6] - w[6]) < 1e-6 * abs(w[6])
    assert lm.katz_scores(docs(spark, [])).count() == 0


def test_planes_round_trip():
    for a in (np.arange(1000, dtype=np.uint64) ** 3, np.zeros(0, "<u4"), np.array([1.5, -2.0]), np.array([True, False])):
        assert (lm._uz(lm._z(a), a.dtype) == a).all()


def test_pair_counts_above_32_bits():
    """Two blocks that saw a pair 3 billion times each."""
    z = lm._z
    ask = lambda block: (0, block, z(np.array([7, 7], np.uint64)), z(np.array([8, 9], np.uint64)), z(np.array([3_000_000_000, 1], "<u4")), z(np.array([5, 5], "<u8")), z(np.array([True, True])))
    batch = lm._batch([ask(1), ask(2)], lm.PAIR_ASK[0])
    out = [r for b in lm._merge_pairs(10**10, 100)([batch]) for r in b.to_pylist()]
    assert [lm._uz(r["counts"], "<u8").tolist() for r in out] == [[6_000_000_000, 2]] * 3


def test_a_full_index_gives_the_same_hits(spark):
    rows, items = [*awkward(), (600, prose(900, 40))], spark.createDataFrame([(1, prose(900, 30)), (2, "one two three"), (3, None)], "item_id bigint, text string")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    a, b = (table(decontam.decontaminate(docs(spark, rows, clash=True), items, full_index=full), *cols) for full in (False, True))
    assert a == b and sum(r[-1] for r in a) == 4


def test_words_of_slices():
    """A batch that is cut out of another has its own words."""
    texts = [None, "", *[t for _, t in awkward()], " Über  ZWEI\tdrei "]
    for kind in (pa.string(), pa.large_string()):
        whole = pa.array(texts, kind)
        for at in range(0, len(texts), 5):
            part = whole.slice(at, 7).slice(1, 5)
            for lower in (True, False):
                words, which, bounds = split_words(part, lower)
                words = [w.encode() for w in words.to_pylist()]
                want = [(t or "").encode().lower().split() if lower else (t or "").encode().split() for t in part.to_pylist()]
                assert [[words[k] for k in which[i:j] if words[k]] for i, j in zip(bounds[:-1], bounds[1:])] == want and len(set(words)) == len(words)
