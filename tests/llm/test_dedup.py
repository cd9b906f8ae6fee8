import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstat.llm import exact, minhash, spans
from fieldstat.llm.exact import exact_duplicates
from fieldstat.llm.graph import components
from fieldstat.llm.common import Scratch

from .helpers import SPACE, awkward, docs, prose, shingles, table


def brute_near(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def test_near_duplicates_match_brute_force(spark):
    for clash in (False, True):
        got = table(minhash.near_duplicates(docs(spark, clash=clash)), "doc_id", "n_shingles", "component_id")
        assert got == brute_near(awkward())


def test_sets_that_share_a_short_name_are_told_apart(spark):
    """With 3 bits of a node's name nearly every node is shared by different sets."""
    rows = awkward() + [(100 + i, prose(60 + i, 40)) for i in range(20)]
    got = table(minhash.near_duplicates(docs(spark, rows), bits=3), "doc_id", "n_shingles", "component_id")
    assert got == brute_near(rows)


def test_near_duplicates_lose_no_link_in_a_large_family(spark):
    """A family whose members mostly miss the threshold with each other: blocks of several chunks must find every link."""
    rng = random.Random(5)
    base, rows = prose(9, 150).split(), []
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice((1, 2, 3, 4, 5))):
            w[rng.randrange(len(w))] = f"edit{rng.random()}"
        rows.append((1000 + i, " ".join(w)))
    for chunk in (100, 16):
        got = table(minhash.near_duplicates(docs(spark, rows), chunk=chunk), "doc_id", "n_shingles", "component_id")
        assert got == brute_near(rows)


def test_near_duplicates_match_brute_force_at_0_8(spark):
    rng = random.Random(6)
    rows = awkward()
    for f in range(12):
        base = prose(300 + f, 120).split()
        for i in range(6):
            w = list(base)
            for k in range(rng.choice((0, 1, 2, 3))):
                w[10 + 35 * k + rng.randrange(20)] = f"edit{rng.random()}"
            rows.append((2000 + 10 * f + i, " ".join(w)))
    want = brute_near(rows, 80)
    assert want != brute_near(rows)
    assert table(minhash.near_duplicates(docs(spark, rows), percent=80), "doc_id", "n_shingles", "component_id") == want


def test_rows_without_an_id_are_kept_once_a_component(spark):
    base, lone = prose(400, 120), prose(401, 120)
    edit = lambda t, k: t.replace(t.split()[40], f"changed{k}", 1)
    rows = [(1, base), (None, edit(base, 1)), (None, base + " "), (None, lone), (None, edit(lone, 1)), (None, edit(lone, 2)), (None, prose(402, 50)), (None, None), (None, ""), (2, None)]
    found = minhash.near_duplicates(docs(spark, rows))
    assert table(found, "doc_id", "n_shingles", "component_id") == brute_near(rows)
    kept = table(found.filter("kept"), "doc_id", "n_shingles")
    assert kept == sorted([(1, 116), (None, 116), (None, 46), (None, 0), (None, 0), (2, 0)], key=repr)


def test_near_duplicates_of_nothing(spark):
    out = minhash.near_duplicates(docs(spark, []))
    assert out.count() == 0 and "kept" in out.columns


def test_signature_agrees_with_similarity():
    a, b = minhash.shingle_set(prose(1, 400), minhash.WordHash()), minhash.shingle_set(prose(1, 400) + " " + prose(2, 100), minhash.WordHash())
    true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - true) < 0.12


def test_components_of_random_graphs(spark, monkeypatch):
    """Against a plain union-find; with hubs that are broadcast, and settled only when every edge leads to a least node."""
    from fieldstat.llm import graph

    monkeypatch.setattr(graph, "HUB", 3)
    monkeypatch.setattr(graph, "HUB_SHARE", 100)
    rng = np.random.default_rng(3)
    for n, m, hub in ((40, 30, 0), (300, 280, 60), (200, 900, 0)):
        edges = rng.integers(-n, n, (m, 2)).tolist() + [[7, int(x)] for x in rng.integers(-n, n, hub)] + [[2**63 - 1, -(2**63)]]
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a != b:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
        got = dict(table(graph.components(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark, "t"), "c"), "node", "comp"))
        assert got == {x: find(x) for x in list(parent)}


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 70)] + [(100, 100 + i) for i in range(1, 50)] + [(5, 5)]
    got = dict(table(components(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark, "t"), "c"), "node", "comp"))
    assert all(got[i] == 1 for i in range(1, 71)) and all(got[100 + i] == 100 for i in range(50))


def brute_exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), d is None, d))
    out = []
    for d, t in rows:
        n = SPACE.sub("", t or "")
        size, _, keep = min(groups[n], key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))
        out.append((d, keep, len(groups[n]), d == keep and len(t or "") == -size, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


COLS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_duplicates_match_brute_force(spark):
    for clash in (False, True):
        assert table(exact_duplicates(docs(spark, clash=clash)), *COLS) == brute_exact(awkward())
    assert exact_duplicates(docs(spark, [])).count() == 0


def test_full_bytes_part_texts_whose_digests_collide(spark):
    weak = lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)
    assert table(exact_duplicates(docs(spark), digest=weak), *COLS) == brute_exact(awkward())


def test_hits_are_read_at_their_place(spark, tmp_path):
    """From files each record's place is file and row; texts behind equal digests are looked up there."""
    docs(spark, clash=True).write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    assert exact.located(df) is not None and exact.located(spark.createDataFrame([(1, "a")], "doc_id bigint, text string")) is None
    assert table(exact_duplicates(df), *COLS) == brute_exact(awkward())
    weak = lambda t: F.substring(exact.sha256(t), 1, 1)
    assert table(exact_duplicates(df, digest=weak), *COLS) == brute_exact(awkward())
    row = exact.located(df).filter("doc_id = 14").first()
    again = exact.located(df).filter((F.col("file") == row["file"]) & (F.col("row") == row["row"])).collect()
    assert [r["doc_id"] for r in again] == [14]


def test_only_files_with_hits_are_opened(spark, tmp_path, monkeypatch):
    """Files without a repeated text are spoilt once the records are written: hits are still opened, by the path their place names."""
    parts = [[(1, "a b"), (2, "c")], [(3, "ab"), (4, "d")], [(5, "e")]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/d/part={i}")
    df = exact.located(spark.read.schema("doc_id bigint, text string, part int").parquet(f"{tmp_path}/d"))
    files = spark.createDataFrame([tuple(r) for r in exact.paths_of(df).collect()], "file bigint, path string")
    assert files.count() == 3
    places = spark.createDataFrame([(r["doc_id"], r["file"], r["row"]) for r in df.collect()], "doc_id bigint, at_file bigint, at_row bigint")
    for f in (tmp_path / "d" / "part=2").glob("*.parquet"):
        f.write_bytes(b"spoilt" * 100)
    hits = places.filter("doc_id IN (1, 3)")
    assert sorted((r["doc_id"], r["text"]) for r in exact.opened(df, hits, files).collect()) == [(1, "a b"), (3, "ab")]
    assert exact.opened(df, hits.limit(0), files).count() == 0
    assert exact.opened(df, spark.createDataFrame([(9, None, 0), (8, 5, 0)], places.schema), files).count() == 0
    monkeypatch.setattr(exact, "NAMED_FILES", 1)
    with pytest.raises(Exception, match="(?i)parquet"):  # too many to name: all are looked through
        exact.opened(df, hits, files).collect()


def test_ids_at_the_ends_of_their_range(spark):
    """The least and the largest id beside null ids of the same text."""
    rows = [(-(2**63), prose(1, 60)), (None, prose(1, 60)), (2**63 - 1, prose(2, 60)), (None, prose(2, 60)), (2**63 - 1, None), (None, None)]
    assert table(exact_duplicates(docs(spark, rows)), *COLS) == brute_exact(rows)
    got = sorted(((r["doc_id"], r["n_removed"]) for r in spans.remove_repeats(docs(spark, rows)).collect()), key=repr)
    n = {t: len(spans.sentences(t)) for _, t in rows}
    assert sorted(got, key=repr) == sorted([(i, n[t] if i is None and t else 0) for i, t in rows], key=repr)


def test_stream_goes_on_where_it_stopped(spark):
    scratch = Scratch(spark, "resume")
    rec = spark.createDataFrame([("a", (5, ~1, "f")), ("b", (3, ~2, "f"))], "digest string, record struct<chars:bigint,order:bigint,place:string>")
    for part in (rec, spark.createDataFrame([("a", (9, ~7, "g"))], rec.schema)):
        part.write.mode("append").parquet(scratch.path("r"))
        exact.run_stream(spark, scratch.path("r"), rec.schema, scratch.path("s"))
    assert table(exact.read_state(spark, scratch.path("s")), "digest", "keep_id", "place", "group_size") == [("a", 7, "g", 2), ("b", 2, "f", 1)]


def brute_spans(rows, every=False):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first, out = {}, []
    occurrences = []
    for i in order:
        parts = spans.sentences(rows[i][1])
        low = [" ".join(p.lower().split()) for p in parts]
        n = [len(p.split()) for p in parts]
        found = set()
        for s in range(len(parts)):
            e = next((e for e in range(s + 2, len(parts) + 1) if sum(n[s:e]) >= 20), None)
            b = next((b for b in range(s - 1, -1, -1) if sum(n[b : s + 1]) >= 20), None)
            found |= {(s, e)} if e else set()
            found |= {(b, s + 1)} if b is not None else set()
            if every:
                found |= {(s, e) for e in range(s + 2, len(parts) + 1) if sum(n[s:e]) >= 20}
        occurrences.append((i, parts, low, sorted(found)))
    for i, _, low, found in occurrences:
        for s, e in found:
            first.setdefault(tuple(low[s:e]), (rows[i][0], s))
    for i, parts, low, found in occurrences:
        gone = {k for s, e in found if first[tuple(low[s:e])] != (rows[i][0], s) for k in range(s, e)}
        out.append((rows[i][0], len(parts), sorted(gone), None if rows[i][1] is None else "".join(p for k, p in enumerate(parts) if k not in gone)))
    return sorted(out, key=repr)


def test_span_removal_matches_brute_force(spark):
    passage = prose(50, 60)
    rows = awkward() + [(200 + i, prose(60 + i, 80) + " " + passage + " " + prose(90 + i, 40)) for i in range(5)]
    for clash in (False, True):
        got = table(spans.remove_repeats(docs(spark, rows, clash=clash)), "doc_id", "n_sentences", "removed", "text")
        assert got == brute_spans(rows)
    kept = {r[0]: r[3] for r in got}
    assert passage.split()[20] in kept[200] and all(passage[200:300] not in kept[200 + i] for i in range(1, 5))
    assert spans.remove_repeats(docs(spark, [])).count() == 0


def test_shortest_spans_remove_what_every_run_would(spark):
    """Runs of at least 2 sentences and 20 words, of any length: the shortest ones from and up to each sentence cover the same."""
    rng = random.Random(5)
    stock = [prose(300 + i, 3 + i % 9, 99) + "." for i in range(40)]
    rows = [(i, " ".join(rng.choice(stock) for _ in range(rng.randrange(25)))) for i in range(60)]
    for i in range(0, 60, 7):  # runs that repeat
        rows.append((100 + i, " ".join(stock[:5]) + " " + (rows[i][1] or "") + " " + " ".join(stock[3:9])))
    got = table(spans.remove_repeats(docs(spark, rows)), "doc_id", "n_sentences", "removed", "text")
    assert got == brute_spans(rows) == brute_spans(rows, every=True) and sum(len(r[2]) for r in got) > 50


def test_sentences_join_to_the_text():
    for _, t in awkward():
        assert "".join(spans.sentences(t)) == (t or "")


def test_spans_that_share_the_first_half_of_their_name_are_told_apart(spark, monkeypatch):
    key, more, first, last = spans.runs(spans.sentences(prose(1, 90) + " " + prose(1, 90)), 2, 20)
    names = {}
    for k, m, f, e in zip(key.tolist(), more.tolist(), first.tolist(), last.tolist()):
        text = " ".join("".join(spans.sentences(prose(1, 90) + " " + prose(1, 90))[f : e + 1]).split())
        assert names.setdefault((k, m), text) == text
    assert 1 < len(names) < len(key) and len(set(more.tolist())) == len(names)
