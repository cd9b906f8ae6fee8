"""MinHash near-deduplication by min-max hashing, with exact confirmation on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHash, kept_whole, mix64, small_batches, words_of, worker_table
from .graph import components

WIDTH, PERMS, BANDS, ROWS = 5, 96, 32, 6
_rng = np.random.Generator(np.random.PCG64(20240229))
MULT = _rng.integers(0, 2**63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, PERMS, dtype=np.uint64) * np.uint64(2)
POWERS = _rng.integers(0, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_MULT = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of WIDTH words; fewer words make one run; no word, none."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(WIDTH, n)
    s = h[: n - k + 1] * POWERS[0]
    for j in range(1, k):
        s = s + h[j : n - k + 1 + j] * POWERS[j]
    return np.unique(mix64(s + np.uint64(k)))


def signature(s: np.ndarray) -> np.ndarray:
    """PERMS minima, then PERMS maxima: each permutation is evaluated once and gives two values."""
    low, high = np.full(PERMS, 2**64 - 1, np.uint64), np.zeros(PERMS, np.uint64)
    for i in range(0, len(s), 512):
        v = s[i : i + 512, None] * MULT + ADD
        low, high = np.minimum(low, v.min(0)), np.maximum(high, v.max(0))
    return np.concatenate([low, high])


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    v = mix64(sig).reshape(ROWS, BANDS).T
    return mix64((v * BAND_MULT).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def node_of(s: np.ndarray, bits: int = 64) -> tuple[int | None, int | None]:
    """A name of a shingle set in two halves, node and check: equal sets, and only they, share it. Of node ``bits`` bits are used."""
    if not len(s):
        return None, None
    node, check = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), ">i8").tolist()
    return node >> (64 - bits), check


def _sign(bits: int):
    def run(batches):
        hashes = worker_table("hashes", WordHash)
        for b in small_batches(batches):
            rows = []
            for doc_id, text, h in zip(*(c.to_pylist() for c in b.columns)):
                s = shingle_set(text, hashes)
                rows.append((doc_id, h, len(s), *node_of(s, bits), band_keys(signature(s)).view(np.int64).tolist() if len(s) else None))
            types = (*[pa.int64()] * 5, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["doc_id", "h", "n_shingles", "node", "check", "bands"])

    return run


def _sets(bits: int):
    def run(batches):
        hashes = worker_table("hashes", WordHash)
        for b in small_batches(batches):
            sets = [shingle_set(t, hashes) for t in b.column(0).to_pylist()]
            names = [node_of(s, bits) for s in sets]
            cols = [*[pa.array([n[i] for n in names], pa.int64()) for i in (0, 1)], pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["node", "check", "hashes"])

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    i = np.searchsorted(b, a)
    return int((b[np.minimum(i, len(b) - 1)] == a).sum())


def linked(both: int, a: int, b: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def _confirm_star(percent: int):
    def run(batches):
        """Rows come sorted by (leader, salt, role): the leader's set first, then its members'."""
        key, lead = None, None
        for b in batches:
            out = []
            for leader, salt, role, node, raw in zip(*(c.to_pylist() for c in b.columns)):
                s = np.frombuffer(raw, np.uint64)
                if role == 0:
                    key, lead = (leader, salt), s
                elif key == (leader, salt) and linked(_common(lead, s), len(lead), len(s), percent):
                    out.append((leader, node))
            yield _edges(out)

    return run


def _edges(pairs) -> pa.RecordBatch:
    u, v = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def block_links(nodes, comps, sides, sets, percent: int):
    """Confirmed links across components within one block, but for those that earlier links of the block imply.

    sides: 0 for the first chunk, 1 for the second; a block of one chunk with itself has only side 0.
    """
    m = len(nodes)
    sizes = np.array([len(s) for s in sets])
    two = max(sides) == 1
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    shared = counts[inverse] > 1
    column = np.cumsum(counts > 1) - 1
    row, col = owner[shared], column[inverse[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((m, m), np.float32)
    width = 4096
    for start in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, [start, start + width])
        x = np.zeros((m, width), np.float32)
        x[row[i:j], col[i:j] - start] = 1
        both += x @ x.T
    both = both.astype(np.int64)
    fits = np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1)
    if two:
        s = np.array(sides)
        fits &= s[:, None] != s[None, :]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for a, b in zip(*np.nonzero(fits)):
        x, y = find(comps[a]), find(comps[b])
        if x != y:
            parent[x] = y
            out.append((nodes[a], nodes[b]))
    return out


def _confirm_blocks(percent: int):
    def run(batches):
        """Rows come sorted by (bucket, i, j): all rows of a block stand together."""
        key, rows = None, []
        for b in batches:
            out = []
            for bucket, i, j, node, comp, side, raw in zip(*(c.to_pylist() for c in b.columns)):
                if key != (bucket, i, j):
                    if len(rows) > 1:
                        out += block_links(*zip(*rows), percent)
                    key, rows = (bucket, i, j), []
                rows.append((node, comp, side, np.frombuffer(raw, np.uint64)))
            if out:
                yield _edges(out)
        yield _edges(block_links(*zip(*rows), percent) if len(rows) > 1 else [])

    return run


#: Distinct ids above which the lookup of candidate texts shuffles instead of broadcasting (8 bytes an id).
BROADCAST_IDS = 500_000


def near_duplicates(docs: DataFrame, percent: int = 85, chunk: int = 100, bits: int = 64) -> DataFrame:
    """(doc_id, h, n_shingles, node, component_id, kept) for every row of ``docs`` (doc_id bigint, text string).

    h: the text's xxhash64; node: the shingle set's. Words: A-Z lower-cased, runs of ``[^\\x20\\x09-\\x0D]``. A document's set holds the hashes of its distinct
    5-word shingles; one of fewer words has its whole sequence as one shingle; null, empty or blank texts have
    an empty set (n_shingles 0) and stand alone. Documents are linked where
    100 * intersection >= percent * union, and component_id is the smallest doc_id reachable by links.
    Equal sets are one node, so exact copies cost one row each; sets that share a node's ``bits`` bits but not its other 64 are told apart. Rows that share a doc_id share a component
    only if their texts link; a null doc_id is never a component's name unless all its ids are null.
    kept: the row has its component's id; where all ids are null, it has the text of the least h.
    Other columns, whatever their names, are not read. An empty table gives an empty table.

    1. One pass hashes each text: each of 96 permutations is evaluated once and leaves its minimum and its
       maximum, 192 values in 32 bands of 6. A pair shares no band with probability 3e-7 at a similarity of 0.85, and 6e-5 at 0.8.
    2. In each band's bucket every node is compared with the least node of the bucket, on full sets.
    3. Where a bucket still has nodes of several components, the pairs across them are compared on full sets, in
       blocks of two chunks of about ``chunk`` nodes, within tasks. Buckets of the same nodes are compared once; buckets joined by
       shared nodes are compared as one group where that sends fewer sets, else each by itself, so a chain of
       loosely related buckets never becomes one large group. Only links that join components leave a task.
       So no link between nodes that share a bucket is lost.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    signed = scratch.write(docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(_sign(bits), "doc_id bigint, h bigint, n_shingles bigint, node bigint, check bigint, bands array<bigint>"), "signed")
    clash = signed.filter("node is not null").groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).filter("a <> b")
    clash = scratch.write(clash.select(F.col("node").alias("c_node")), "clash")
    clear = clash.isEmpty()

    def named_apart(rows: DataFrame) -> DataFrame:
        """Nodes that different sets share get a name from both halves."""
        if clear:
            return rows
        both = rows.join(clash, F.col("node") == F.col("c_node"), "left")
        return both.withColumn("node", F.when(F.col("c_node").isNotNull(), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("c_node")

    if not clear:
        signed = scratch.write(named_apart(signed), "signed-apart")
    names = signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("h").alias("first_h"))

    # 2. buckets of several nodes; bands of equal sets are equal, so a node is one row in a bucket
    rows = signed.filter("node is not null").select("node", F.explode("bands").alias("key")).distinct()
    leaders = rows.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1").drop("n")
    buckets = scratch.write(rows.join(leaders, "key"), "buckets")
    star = scratch.write(buckets.filter("node <> leader").select("leader", "node").distinct(), "star")
    wanted = star.select("leader").union(star.select("node")).toDF("node").distinct()
    ids = scratch.write(names.join(wanted, "node").select("first_id").distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi").select("text")
    sets = named_apart(texts.mapInArrow(_sets(bits), "node bigint, check bigint, hashes binary").filter("node is not null"))
    sets = scratch.write(sets.select("node", "hashes").dropDuplicates(["node"]), "sets")

    sizes = star.groupBy("leader").agg(F.ceil(F.count("*") / chunk).cast("int").alias("salts"))
    members = star.join(sizes, "leader").withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int"))
    heads = sizes.select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("leader").alias("node"))
    both = heads.union(members.select("leader", "salt", F.lit(1), "node")).join(sets, "node").select("leader", "salt", "role", "node", "hashes")
    parts = _parts(spark)
    confirmed = scratch.write(both.repartition(parts, "leader", "salt").sortWithinPartitions("leader", "salt", "role").mapInArrow(_confirm_star(percent), "u bigint, v bigint"), "confirmed")

    # 3. buckets with several components: where comparing a family of buckets at once costs less, the family is the group
    joined = components(confirmed, scratch, "joined")
    placed = scratch.write(buckets.select("key", "leader", "node").join(joined, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "placed")
    same = [F.count("*").alias("n"), F.min("node").alias("x"), F.max("node").alias("y"), F.bit_xor(F.xxhash64("node")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("t")]
    open_ = placed.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), *same).filter("a <> b")
    open_ = scratch.write(open_.groupBy("n", "x", "y", "s", "t").agg(F.min("key").alias("key")).select("key", "n"), "open")
    inside = scratch.write(placed.join(open_, "key").select("key", "n", "leader", "node", "comp"), "inside")
    family = components(inside.select("leader", "node").distinct().toDF("u", "v"), scratch, "family").withColumnRenamed("comp", "family")
    inside = scratch.write(inside.join(family, "node"), "inside-family")
    cost = lambda n: n * F.ceil(n / chunk)  # noqa: E731  sets sent when a group of n is compared in blocks
    whole = inside.select("family", "node", "comp").distinct()
    sizes = whole.groupBy("family").agg(F.count("*").alias("m"))
    apart = inside.groupBy("family", "key").agg(F.first("n").alias("n")).groupBy("family").agg(F.sum(cost(F.col("n"))).alias("apart"))
    choice = scratch.write(sizes.join(apart, "family").select("family", "m", (cost(F.col("m")) <= F.col("apart")).alias("at_once")), "choice")
    at_once = whole.join(choice.filter("at_once"), "family").select(F.lit(True).alias("at_once"), F.col("family").alias("key"), F.col("m").alias("n"), "node", "comp")
    apart = inside.join(choice.filter("NOT at_once").select("family"), "family", "left_semi").select(F.lit(False), "key", "n", "node", "comp")
    dealt = at_once.union(apart).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")).withColumn("c", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    # blocks (i, j), i <= j: a chunk meets itself once and each other chunk once
    blocks = dealt.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = blocks.select(F.xxhash64("at_once", "key").alias("key"), F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), "node", "comp", F.when(F.col("c") > F.col("d"), 1).otherwise(0).alias("side"))
    blocks = blocks.join(sets, "node").select("key", "i", "j", "node", "comp", "side", "hashes")
    late = blocks.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_confirm_blocks(percent), "u bigint, v bigint")
    late = scratch.write(late, "late")
    final = components(joined.toDF("u", "v").union(late), scratch, "final")

    # the smallest doc_id of each component, then one lookup by node
    named = names.join(final, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("first_id").alias("component_id"), F.min("first_h").alias("least_h"))
    named = named.join(least, "comp").select("node", "component_id", "least_h")
    out = signed.select("doc_id", "h", "n_shingles", "node").join(named, "node", "left")
    # a component without any id keeps the text of the least hash
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("doc_id").isNotNull() | F.col("node").isNull() | (F.col("h") == F.col("least_h")))
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = kept_whole(out.select("doc_id", "h", "n_shingles", "node", "component_id", kept.alias("kept")))
    scratch.drop()
    return out


def _parts(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
