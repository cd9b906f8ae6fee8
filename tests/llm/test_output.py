import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from pyspark.sql import functions as F

from fieldstat.llm import shards, warc
from fieldstat.llm.common import Scratch
from fieldstat.llm.packing import OpenBins, pack
from fieldstat.llm.tokens import WordIds, WordTable, default_tokenizer

from .helpers import awkward, docs, prose, table


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_word_ids_equal_whole_text_ids():
    odd = ["<|endoftext|>x <|ENDOFTEXT|> a\x01b \x01 \x1c c İstanbul ΣΑΣ Σ. it's don't, 3.5 x.,! ab12 क़ é Å ŉ ſ É!!    x", "a" * 5000 + " b", "abcdefghijklmno abcdefghijklmnop abcdefgh\x00 abcdefgh a\x00 a Straße,", " lead trail "]
    odd += [chr(c) + " x" + chr(c) + "y" + chr(c) + "." for c in range(1, 0x250)]
    texts = [t for _, t in awkward()] + odd
    for limit in (10**6, 100):
        known = WordIds(default_tokenizer(), limit)
        for some in (texts, texts[::-1], texts[::3], []):
            ids, bounds = known.encode(pa.array(some, pa.string()))
            assert [ids[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:])] == ids_of(some)
            part = pa.array([None, *some, "z"], pa.string()).slice(1, len(some))
            assert known.encode(part)[0].tolist() == ids.tolist()


def test_word_table_keeps_the_words_used_most():
    t = WordTable(100)
    key = np.stack([np.arange(80, dtype=np.uint64), np.arange(80, dtype=np.uint64) % np.uint64(3)], 1)
    rows = t.add(key, np.arange(160, dtype=np.uint32), np.full(80, 2, np.int32))
    t.uses[rows[60:]] += 5
    assert not t.make_room(20) and t.make_room(40)
    found = t.find(key)
    assert (found[60:] >= 0).all() and (found >= 0).sum() == 40
    assert t.ids(found[60:]).tolist() == list(range(120, 160))


def test_packing(spark):
    rows = awkward()
    got = [r.asDict() for r in pack(docs(spark, clash=True)).collect()]
    want = []
    for (d, _), ids in zip(rows, ids_of([t for _, t in rows])):
        ids = [*ids, 1]
        want += [(d, k, i, len(ids[i : i + 4096]), zlib.crc32(np.array(ids[i : i + 4096], "<u4").tobytes())) for k, i in enumerate(range(0, len(ids), 4096))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)
    seqs = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == seqs.get(r["sequence_id"], 0)
        seqs[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(seqs.values()) <= 4096
    assert len(seqs) <= -(-sum(r["length"] for r in got) // 4096) + 2
    assert pack(docs(spark, [])).count() == 0


def test_packing_equals_a_plain_simulation(spark):
    """Pieces in the order of their hashes; each to the open sequence with the least room that does, the latest of equals."""
    rows = [(i, prose(i, 1 + 37 * i % 400)) for i in range(150)]
    got = pack(docs(spark, rows), length=300, most_open=4).withColumn("o", F.xxhash64("doc_id", "piece", F.lit(3))).orderBy("o", "doc_id", "piece").collect()
    opened, n, places, want = [], 0, {}, []  # opened: [room, sequence], latest last
    for r in got:
        fits = [b for b in opened if b[0] >= r["length"]]
        if fits:
            least = min(b[0] for b in fits)
            b = [b for b in fits if b[0] == least][-1]
            opened.remove(b)
        else:
            b, n = [300, n], n + 1
            if r["length"] < 300 and len(opened) == 4:
                fullest = min(x[0] for x in opened)
                opened.remove([x for x in opened if x[0] == fullest][-1])
        want.append((b[1], 300 - b[0]))
        b = [b[0] - r["length"], b[1]]
        if b[0]:
            opened.append(b)
    assert [(r["sequence_id"], r["offset"]) for r in got] == want


def test_open_bins_take_the_best_fit_and_close_the_fullest():
    b = OpenBins(10, 2)
    assert [b.put(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    b = OpenBins(10, 2)
    assert [b.put(n) for n in (6, 8, 5, 2, 5)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 5)]  # the one with 8 closed
    b = OpenBins(10, 1)
    assert [b.put(n) for n in (6, 10, 4)] == [(0, 0), (1, 0), (0, 6)]  # a full piece closes no open sequence


def pages(spark):
    same = "<html>" + prose(1, 200) + "</html>"
    rows = [(3, "http://a/3", same), (1, "http://a/1", same), (2, None, None), (5, "http://a b/5", ""), (7, "http://é/7", "é" * 50), (8, "u", prose(2, 20000)), (None, "u", same), (9, "u", "x\r\n\r\ny\x00WARC/1.1"), (9, "u", "x\r\n\r\ny\x00WARC/1.1")]
    rows += [(100 + i, f"http://b/{i}", prose(100 + i, 50)) for i in range(30)]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)


def test_archives_round_trip(spark):
    rows, df = pages(spark)
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    for least in (0, 1000):
        want = []
        for i, _, html in rows:
            p = (html or "").encode()
            again = len(p) >= least and i != first[html or ""]
            want.append((i, len(p), warc.digest32(p), "revisit" if again else "response", first[html or ""] if again else None))
        got = table(warc.round_trip(df.withColumn("k", df["page_id"]), least), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        assert got == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archives_that_are_not_listed_are_not_read(spark, tmp_path):
    """What a failed try left in the folder stays unread; a listed archive with other records is an error."""
    rows, df = pages(spark)
    scratch, folder = Scratch(spark, "warc-test"), f"file://{tmp_path}/out"
    manifest = warc.write_archives(df, folder, scratch)
    names = sorted((tmp_path / "out").glob("*.warc.zst"))
    (tmp_path / "out" / "part-000000-9999.warc.zst").write_bytes(names[0].read_bytes())
    assert warc.read_listed(manifest, folder).count() == len(rows) < warc.read_archives(spark, folder).count()
    raw = names[0].read_bytes()
    names[0].write_bytes(raw[: list(warc.frames(raw, "f"))[-1][0]])
    with pytest.raises(Exception, match="were written"):
        warc.read_listed(manifest, folder).count()
    low = spark.createDataFrame([(-(2**63), "u", "x"), (None, "u", "x"), (5, "u", "x")], "page_id bigint, url string, html string")
    assert table(warc.round_trip(low), "page_id", "record_type", "refers_to") == sorted([(-(2**63), "response", None), (None, "revisit", -(2**63)), (5, "revisit", -(2**63))], key=repr)


def test_archive_layout_and_damage(spark, tmp_path):
    _, df = pages(spark)
    scratch = Scratch(spark, "warc-test")
    folder = f"file://{tmp_path}/out"
    warc.write_archives(df, folder, scratch)
    name = sorted((tmp_path / "out").glob("*.warc.zst"))[0]
    raw = name.read_bytes()
    assert struct.unpack("<I", raw[:4])[0] == warc.DICT_MAGIC and list((tmp_path / "out").glob("_*")) == []
    found = list(warc.frames(raw, "f"))
    assert all(d.startswith(b"WARC/1.1\r\n") for _, d in found)
    with pytest.raises(warc.ArchiveError):
        list(warc.frames(raw[:-3], "f"))
    with pytest.raises(warc.ArchiveError):
        list(warc.frames(raw[: found[0][0]] + b"junk" + raw[found[0][0] :], "f"))
    broken = bytearray(raw)
    broken[found[-1][0] + 40] ^= 0xFF
    with pytest.raises(warc.ArchiveError):
        [warc.parse(d, "r") for _, d in warc.frames(bytes(broken), "f")]
    one = warc.record(1, "u", b"payload")
    assert warc.parse(one, "r")[0] == 1
    for bad in (one.replace(b"payload", b"pay"), one.replace(b"WARC/1.1", b"HTTP/1.1"), one[:-1], one.replace(b"payload", b"PAYLOAD")):
        with pytest.raises(warc.ArchiveError):
            warc.parse(bad, "r")
    plain = zstandard.ZstdCompressor().compress(one)  # without a dictionary
    assert [d for _, d in warc.frames(plain * 2, "f")] == [one, one]


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 255, 1000, 4097):
        a = shards.feistel(np.arange(n), n, 7)
        assert sorted(a.tolist()) == list(range(n))
    assert (shards.feistel(np.arange(1000), 1000, 7) != shards.feistel(np.arange(1000), 1000, 8)).mean() > 0.9
    assert abs(np.corrcoef(np.arange(1000), shards.feistel(np.arange(1000), 1000, 7))[0, 1]) < 0.15


def test_shards_hold_every_token_in_order_of_slot(spark, tmp_path):
    rows = awkward()
    folder = f"file://{tmp_path}/s"
    index = shards.write_shards(docs(spark, clash=True), folder, Scratch(spark, "shards-test"), length=64, shard=50).collect()
    back = list(shards.read_from(folder))
    assert [s for s, _ in back] == list(range(len(index))) and len(back) == len({r["slot"] for r in index})
    want = sorted(x for ids in ids_of([t for _, t in rows]) for x in [*ids, 1])
    assert sorted(x for _, ids in back for x in ids.tolist()) == want
    resumed = list(shards.read_from(folder, 77))
    assert resumed[0][0] == 77 and all((a[1] == b[1]).all() for a, b in zip(resumed, back[77:]))
    sizes = {p.stat().st_size for p in sorted((tmp_path / "s").glob("*.bin"))[:-1]}
    assert len(sizes) == 1


def plain_slot(i, n, key):
    """The keyed Feistel network on Python integers, walked until inside 0..n-1."""
    m64 = 2**64 - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m64
        return x ^ (x >> 31)

    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    while True:
        left, right = i >> half, i & ((1 << half) - 1)
        for k in range(1, shards.ROUNDS + 1):
            left, right = right, left ^ (mix((right + mix((k * 0x9E3779B97F4A7C15 + key) & m64)) & m64) & ((1 << half) - 1))
        i = left << half | right
        if i < n:
            return i


def test_every_slot_holds_the_ids_and_documents_of_a_plain_version(spark, tmp_path):
    docs(spark, clash=True).write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")  # files fix what a partition holds
    parts = {}
    for r in df.withColumn("p", F.spark_partition_id()).collect():
        parts.setdefault(r["p"], []).append((r["doc_id"], r["text"]))
    sequences = []
    for p in sorted(parts):
        flat = [(x, d) for (d, _), ids in zip(parts[p], ids_of([t for _, t in parts[p]])) for x in [*ids, 1]]
        ends, at = [], 0
        for (d, _), ids in zip(parts[p], ids_of([t for _, t in parts[p]])):
            ends.append((at, at + len(ids) + 1, d))
            at += len(ids) + 1
        for i in range(0, len(flat), 64):
            sequences.append(([x for x, _ in flat[i : i + 64]], [d for a, b, d in ends if a < i + 64 and b > i]))
    want = {plain_slot(i, len(sequences), 99): s for i, s in enumerate(sequences)}
    folder = f"file://{tmp_path}/s"
    index = shards.write_shards(df, folder, Scratch(spark, "shards-test"), key=99, length=64, shard=50).collect()
    assert {r["slot"]: r["doc_ids"] for r in index} == {k: d for k, (_, d) in want.items()}
    assert {k: ids.tolist() for k, ids in shards.read_from(folder)} == {k: ids for k, (ids, _) in want.items()}
    back = {r["slot"]: (r["n_tokens"], r["ids_crc32"], r["shard"]) for r in shards.read_shards(spark, folder).collect()}
    assert back == {k: (len(ids), zlib.crc32(np.array(ids, "<u2").tobytes()), k // 50) for k, (ids, _) in want.items()}


def test_a_task_writes_a_range_of_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "TASKS", 3)
    folder = f"file://{tmp_path}/s"
    index = shards.write_shards(docs(spark), folder, Scratch(spark, "shards-test"), length=64, shard=50)
    back = [s for s, _ in shards.read_from(folder)]
    assert back == list(range(index.count())) and len(list((tmp_path / "s").glob("*.bin"))) == -(-len(back) // 50) > 20


def test_materialise(spark):
    out = shards.materialise(docs(spark), length=128, shard=20)
    r = out.collect()
    assert sorted(x["slot"] for x in r) == list(range(len(r))) and all(x["shard"] == x["slot"] // 20 for x in r)
    assert {d for x in r for d in x["doc_ids"]} == {d for d, _ in awkward()}
    assert shards.materialise(docs(spark, [])).count() == 0
