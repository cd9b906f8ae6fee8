import re
import zlib

import numpy as np

import corpus_pipeline as cp
from fieldstat.llm import langid, queries
from fieldstat.llm.tokens import default_tokenizer

from .helpers import SPACE, awkward, docs, low, plain_language, prose, shingles, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_pipeline(rows, model, items):
    """The rows that each stage but the last leaves, by plain loops; ids are unique but for repeated rows."""
    lang = [(i, t) for i, t in rows if not plain_language(model, t)[2]]
    groups = {}
    for i, t in lang:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0, i, t))
    exact = [min(g, key=lambda x: x[:3])[3:] for g in groups.values()]
    sets = [shingles(t) for _, t in exact]
    comp = list(range(len(exact)))
    for a in range(len(exact)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = comp[a], comp[b]
                comp = [y if c == x else c for c in comp]
    best = {}
    for (i, _), c in zip(exact, comp):
        best[c] = min(best.get(c, (True, 0)), (i is None, i or 0))
    near = [(i, t) for (i, t), c in zip(exact, comp) if best[c] == (i is None, i or 0)]
    windows = set()
    for _, t in items:
        w = WORD.findall(low(t))
        windows |= {tuple(w[s : s + 10]) for s in range(max(1, len(w) - 9))} if w else set()
    words = [WORD.findall(low(t)) for _, t in near]
    hit = [any(tuple(w[s : s + k]) in windows for k in {len(x) for x in windows} for s in range(len(w) - k + 1)) for w in words]
    return lang, exact, near, [r for r, h in zip(near, hit) if not h]


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    base = prose(800, 120).split()
    rows = awkward() + [(600, prose(601, 40) + " " + prose(500, 30)), (700, prose(701, 90)), (701, prose(702, 90) + " one two three")]
    for i in range(8):
        w = list(base)
        for at in range(0, 30 * (i % 4), 30):
            w[at] = f"edit{i}"
        rows.append((900 + i, " ".join(w)))
    items = [(1, prose(500, 30)), (2, "One, two... THREE"), (3, None), (4, "")]
    for clash in (False, True):
        folder = f"{tmp_path}/{clash}"
        docs(spark, rows, clash=clash).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        want = plain_pipeline(rows, langid.fit(now), items)
        assert len({len(x) for x in want}) == 4
        for (name, stage), left in zip(cp.STAGES, want):
            stage(spark, now, folder).write.parquet(f"{folder}/{name}")
            columns, now = now.columns, spark.read.parquet(f"{folder}/{name}")
            assert now.columns == columns and table(now, "doc_id", "text") == sorted(left, key=repr), name
    tokens, pieces = Tokenizer.from_file(default_tokenizer()), []
    for i, t in want[-1]:
        ids = np.array([*tokens.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        pieces += [(i, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    out = cp.run(spark, folder).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=repr) == sorted(pieces, key=repr)
    ends = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0) and r["offset"] + r["length"] <= 4096
        ends[r["sequence_id"]] = r["offset"] + r["length"]


def test_pipeline_of_empty_tables(spark, tmp_path):
    docs(spark, [], clash=True).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and out.columns == empty.columns
    assert cp.run(spark, str(tmp_path)).count() == 0
    some = docs(spark, [(1, prose(1, 50)), (None, None)])
    assert cp.clean(spark, some, str(tmp_path)).count() == 2  # no benchmark: nothing goes


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    passage = prose(500, 30)
    rows = awkward() + [(600, prose(601, 40) + " " + passage), (700, prose(701, 90)), (701, prose(702, 90))]
    df = docs(spark, rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in cp.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == df.columns
        left.append({r["doc_id"] for r in now.select("doc_id").collect()})
    lang, exact, near, clean = left
    assert not {4, 5, 6} & lang and {1, 2, 7, 8, 600, 700} <= lang
    assert {1, 7} & exact == set() and 2 in exact and {20 + i for i in range(1, 12)} & exact == set()
    assert 3 not in near and {40 + i for i in range(1, 12)} & near == set() and 40 in near
    assert 600 not in clean and {700, 701, 11, 12} <= clean
    ids = {r["doc_id"] for r in cp.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert ids == clean
    rerun = now.filter("doc_id = 11").count()
    assert rerun == 1  # a repeated row stays once


def test_near_stage_drops_copies_of_similarity_0_8(spark, tmp_path):
    """Two scattered edits in 120 words: 106 of 126 shingles are shared, 0.84."""
    base, rows = prose(800, 120).split(), [(900, prose(800, 120)), (950, prose(801, 120))]
    for i in range(1, 6):
        w = list(base)
        w[30], w[80] = f"one{i}", f"two{i}"
        rows.append((900 + i, " ".join(w)))
    assert {r["doc_id"] for r in cp.near(spark, docs(spark, rows), str(tmp_path)).collect()} == {900, 950}


def test_registered():
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.ORACLE) == {"op5_warc_round_trip", "op7_exact_dedup", "op8_benchmark_decontamination", "op11_hash_tree_sharding", "op12_divergence_audit", "op13_ball_kmeans"}
