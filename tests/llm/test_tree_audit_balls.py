import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstat.llm import balls, divergence, queries, tree

from .helpers import awkward, docs, low, prose, table


# -- the hash tree


def plain_shard(key, spec):
    def weight(x):
        return sum(map(weight, x.values())) if isinstance(x, dict) else x

    path, node = "", spec
    while isinstance(node, dict):
        draws = []
        for name, below in node.items():
            u = (int(hashlib.md5(f"{path}/{name}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
            if weight(below):
                draws.append((-math.log(u) / weight(below), str(name)))
        name = min(draws)[1]
        path, node = f"{path}/{name}", {str(k): v for k, v in node.items()}[name]
    return path


def held(spark, tr, n=4000):
    key = tree.key_of(F.col("id"))
    got = spark.range(n).select("id", tree.drawn(key, tr).alias("at")).select("id", "at.*").collect()
    return {r["id"]: (r["region"], r["rack"], r["shard"]) for r in got}


def test_draws_equal_a_plain_descent_and_follow_weights(spark):
    tr = {"a": {"x": {0: 1, 1: 3}, "y": {2: 0, 5: 2}}, "b": {"x": {3: 4}, "empty": {9: 0}}}
    got = held(spark, tr)
    for i, (region, rack, shard) in got.items():
        assert plain_shard(str(i), tr) == f"/{region}/{rack}/{shard}"
    share = {s: sum(x[2] == s for x in got.values()) / len(got) for s in range(6)}
    for s, want in {0: 0.1, 1: 0.3, 2: 0, 3: 0.4, 5: 0.2}.items():
        assert abs(share[s] - want) < 0.03
    for bad in ({}, {"a": {"x": {0: 0}}}, {"a": {"x": {0: 1}, "y": {0: 1}}}, {"a": {"x": {0: -1}}}):
        with pytest.raises(ValueError):
            tree.drawn(F.lit("k"), bad)


def test_moves_are_confined_to_subtrees_whose_weights_change(spark):
    before = held(spark, tree.BASE)
    heavier = {r: {k: dict(s) for k, s in racks.items()} for r, racks in tree.BASE.items()}
    heavier["r1"]["k0"][4] = 2
    moved = {i: (before[i], x) for i, x in held(spark, heavier).items() if x != before[i]}
    assert moved
    for old, new in moved.values():
        assert new[:2] == ("r1", "k0") or old[0] != new[0] == "r1" or old[:1] == new[:1] == ("r1",) and new[1] == "k0"
        assert new[0] == "r1"  # nothing moves within or into the other region
    inside = [(old, new) for old, new in moved.values() if old[0] == "r1"]
    assert all(new[1] == "k0" for _, new in inside) and all(new[2] == 4 for old, new in inside if old[1] == "k0")
    tr = tree.BASE
    for n in (9, 10, 11):  # each further shard takes rows only into itself
        more = tree.grown(tr)
        assert more == tree.tree_of(n)
        a, b = held(spark, tr), held(spark, more)
        new = {i for i in a if a[i] != b[i]}
        assert {b[i][2] for i in new} == {n - 1} and abs(len(new) / len(a) - 1 / n) < 0.03
        tr = more
    with pytest.raises(ValueError):
        tree.tree_of(7)


def test_shard_rows(spark):
    for clash in (False, True):
        rows = awkward() + [(7, prose(30, 20))] * 500  # a row with a large share of the table
        got = [r.asDict() for r in tree.shard_rows(docs(spark, rows, clash=clash)).collect()]
        raw = sorted(((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows))
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]) for r in got) == raw
        by = {}
        for r in got:
            key = "" if r["doc_id"] is None else str(r["doc_id"])
            assert f"/{r['region']}/{r['rack']}/{r['shard']}" == plain_shard(key, tree.BASE) and r["law"] == "key"
            assert r["grown_shard"] == int(plain_shard(key, tree.tree_of(9)).split("/")[3]) and r["grown_shard"] in (r["shard"], 8)
            by.setdefault(r["shard"], []).append((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]))
        for own in by.values():
            own.sort()
            assert [x[0] for x in own] == list(range(len(own))) and [x[1:] for x in own] == sorted(x[1:] for x in own)
    assert tree.shard_rows(docs(spark, [])).count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    df = docs(spark, clash=True)
    for files in (1, 3):
        tree.write_shards(df, f"{tmp_path}/{files}", files=files)
        back = spark.read.parquet(f"{tmp_path}/{files}")
        assert table(back, "doc_id", "text") == table(df, "doc_id", "text")
        assert all(plain_shard("" if r["doc_id"] is None else str(r["doc_id"]), tree.BASE) == f"/{r['region']}/{r['rack']}/{r['shard']}" for r in back.collect())


# -- the audit


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows, least_docs=3, top=200):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(TERM.findall(low(t)), s) for t, x, s in rows if x == lang]
        seen, n = {}, {}
        for words, s in own:
            for w in set(words):
                seen[w] = seen.get(w, 0) + 1
            for w in words:
                n[s, w] = n.get((s, w), 0) + 1
        kept = sorted(w for w, k in seen.items() if k >= least_docs)
        sources = sorted({s for _, s in own})
        v = len(kept)
        total = {w: sum(n.get((s, w), 0) for s in sources) for w in kept}

        def ps(counts):
            d = sum(counts) + v
            return [1 + 10**9 * (c + 1) // d for c in counts]

        p = {s: ps([n.get((s, w), 0) for w in kept]) for s in sources}
        q = ps([total[w] for w in kept])
        for s in sources:
            pairs = [(sum((a - b) ** 2 // b for a, b in zip(p[s], p[o])), o) for o in sources if o != s]
            terms = [((a - b) ** 2 // b, w) for a, b, w in zip(p[s], q, kept) if n.get((s, w), 0) and a > b]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, w, f, k) for k, (f, w) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out, key=repr)


def sourced(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    if clash:
        for c in ("n", "docs", "term", "vec", "m", "v", "d", "p0", "value", "rank", "item", "part"):
            df = df.withColumn(c, F.lit("x"))
    return df


def mixed(seed=1):
    rng = random.Random(seed)
    rows = [(t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "", None, "ü"])) for _, t in awkward()]
    words = [f"w{'x' * i}" for i in range(60)] + ["Éa", "éa", "ÉA", "漢字", "don't", "A1B"]
    for _ in range(150):
        rows.append((" ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randrange(40))), "en", rng.choice("aaaaaabcdefg")))
    return rows + [("only here once", "fr", "a"), (None, "fr", "b"), ("alone alone alone", "it", "a")] + [("same row, same row", "en", "h")] * 40


def test_audit_equals_brute_force(spark):
    rows = mixed()
    want = plain_audit(rows)
    assert {x[2] for x in want} == {"pair", "term"} and ("fr", "a", "pair", "b", 0, 1) in want
    for clash in (False, True):
        got = table(divergence.audit(sourced(spark, rows, clash)), "lang", "source", "part", "item", "value", "rank")
        assert got == want
    got = table(divergence.audit(sourced(spark, rows), least_docs=1, top=3), "lang", "source", "part", "item", "value", "rank")
    assert got == plain_audit(rows, 1, 3)
    assert divergence.audit(sourced(spark, [])).count() == 0
    assert divergence.audit(sourced(spark, [(None, None, None)])).count() == 0


def test_audit_without_broadcasts_and_with_small_tables(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(divergence, "HELD", 40)
    rows = mixed(2)
    assert table(divergence.audit(sourced(spark, rows)), "lang", "source", "part", "item", "value", "rank") == plain_audit(rows)


def test_probabilities_are_exact_for_large_counts(spark):
    rows = [(c, d) for c, d in [(0, 1), (2, 3), (10**13, 3 * 10**13 + 1), (2**62, 2**62 + 1), (0, 2**62), (7, 10**10)]]
    got = spark.createDataFrame(rows, "c bigint, d bigint").select(divergence._p(F.col("c"), F.col("d"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (c + 1) // d for c, d in rows]


def test_equal_vectors_are_one_row(spark):
    from fieldstat.llm.common import Scratch

    rows = [(" ".join(f"t{'y' * k}" for k in range(50)), "en", s) for s in "aabbc"]
    scratch = Scratch(spark, "test")
    terms = divergence.term_vectors(sourced(spark, rows), scratch)
    assert terms.count() == 50 and terms.groupBy("lang", "vec").count().collect()[0]["count"] == 50
    scratch.drop()


# -- ball k-means


def plain_kmeans(rows, clusters=40, rounds=5, dims=64):
    """rows: (vec_id, components); plain Lloyd in whole numbers."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    centres = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for k in range(len(centres)):
            members = [v for (_, v), c in zip(kept, own) if c == k]
            if members:
                centres[k] = [sum(x) // len(members) for x in zip(*members)]
    last = [near(v) for _, v in kept]
    whole, by = sum(d for d, _ in last), {}
    for d, k in last:
        by[k] = by.get(k, 0) + d
    return sorted(((i, k, d, by[k], whole, hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, last)), key=repr)


COLS = "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"


def vectors(spark, rows, clash=False, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").repartition(3)
    if clash:
        for c in ("v", "cluster", "distance", "key", "n", "s"):
            df = df.withColumn(c, F.lit(1))
    return df


def some_vectors(seed, n=150, dims=64, scale=0.2):
    rng = np.random.default_rng(seed)
    at = rng.standard_normal((6, dims))
    v = (at[rng.integers(0, 6, n)] + rng.standard_normal((n, dims)) * scale).astype(np.float32).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    bad = [(900, None), (901, []), (902, v[0].tolist()[:-1]), (903, [*v[0].tolist(), 1.0]), (904, [None, *v[0].tolist()[1:]]), (905, [math.nan, *v[0].tolist()[1:]]), (906, [math.inf, *v[0].tolist()[1:]]), (907, [-math.inf, *v[0].tolist()[1:]])]
    return rows + bad + [(None, v[1].tolist()), (None, v[2].tolist()), (5, v[5].tolist()), (6, v[7].tolist())] + [(500 + i, v[9].tolist()) for i in range(60)]


def test_ball_kmeans_equals_plain_lloyd(spark):
    rows = some_vectors(1)
    want = plain_kmeans(rows)
    for clash in (False, True):
        assert table(balls.ball_kmeans(vectors(spark, rows, clash)), *COLS) == want
    few = rows[:7]
    assert table(balls.ball_kmeans(vectors(spark, few)), *COLS) == plain_kmeans(few)
    for none in ([], [(1, None), (2, [1.0])]):
        out = balls.ball_kmeans(vectors(spark, none))
        assert out.count() == 0 and out.columns == list(COLS)


def test_ties_and_large_components(spark):
    grid = [(i, [float(x), float(y), 0.0]) for i, (x, y) in enumerate((x, y) for x in range(9) for y in range(9))]
    grid = [(i, [x / 256 for x in v]) for i, v in grid]
    got = table(balls.ball_kmeans(vectors(spark, grid, kind="double"), clusters=12, rounds=4, dims=3), *COLS)
    assert got == plain_kmeans(grid, 12, 4, 3)
    large = [(i, [x * 2**22 for x in v]) for i, v in grid]
    got = table(balls.ball_kmeans(vectors(spark, large, kind="double"), clusters=12, rounds=4, dims=3), *COLS)
    assert got == plain_kmeans(large, 12, 4, 3)
    with pytest.raises(Exception, match="no exact distance"):
        balls.ball_kmeans(vectors(spark, [(1, [1e30, 0.0, 0.0])], kind="double"), clusters=2, dims=3).count()


def test_members_meet_only_the_centroids_near_their_ball(monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.integers(-300, 300, (40, 64))
    v = centres[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, (3000, 64))
    own = balls.nearest(v, np.zeros(len(v), int), balls.Balls(centres))[0]
    own[:500] = rng.integers(0, 40, 500)  # an earlier state: some are far from their centroid
    far = np.full(40, -1, object)
    for i, d in zip(own, balls._squares(v, centres[own])):
        far[i] = max(far[i], balls._root(int(d)))
    met, plain = [], balls._table
    monkeypatch.setattr(balls, "_table", lambda a, c: (met.append(len(a) * len(c)), plain(a, c))[1])
    got = balls.nearest(v, own, balls.neighbours(centres, far))
    pruned = sum(met)
    want = balls.nearest(v, own, balls.Balls(centres))
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    assert pruned < 500 * 40 + 1  # the 2,500 stable members meet none


def test_queries_of_the_round_are_registered():
    assert {"op11_hash_tree_sharding", "op12_divergence_audit", "op13_ball_kmeans"} <= set(queries.QUERIES) & set(queries.ORACLE)
