"""Token ids in training order: a keyed Feistel permutation gives every sequence its slot in fixed-stride shards."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, kept_whole, mix64, small_batches
from .tokens import default_tokenizer, shared_ids
from .words import ROWS

LENGTH, END, PAD = 2048, 1, 0
#: Sequences of a shard (16 MB of 2-byte ids at 2048 tokens).
SHARD = 4096
#: A task writes a range of shards: one up to TASKS shards, then more, but at most RANGE (1 GB).
TASKS, RANGE = 20_000, 64
MAGIC = b"FSTK0001"
#: Magic, bytes of an id, tokens of a sequence, shard number, first slot, sequences here, sequences of a full shard, all sequences, key.
HEADER = "<8sIIQQQQQQ"
HEADER_BYTES = struct.calcsize(HEADER)
ROUNDS = 6
_SEQ = "part bigint, k bigint, n_tokens bigint, ids binary, doc_ids array<bigint>"


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1: a balanced Feistel network on the next even power of two, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % 2**64))

    def once(x):
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        return (left << shift) | right

    out = once(np.asarray(index, np.uint64))
    while True:  # the network is a bijection, so walking from inside comes back inside
        over = out >= np.uint64(n)
        if not over.any():
            return out.astype(np.int64)
        out[over] = once(out[over])


def _sequences(path: str, length: int, dtype: str):
    def run(batches):
        known, part, k = shared_ids(path), TaskContext.get().partitionId(), 0
        # tokens not yet out, and the documents they are of with the place behind each one's last token
        ids, owners, ends = np.empty(0, dtype), [], np.empty(0, np.int64)

        def out(n):
            """The first ``n`` tokens as sequences; the rest is kept."""
            nonlocal ids, owners, ends, k
            starts = np.arange(0, n, length)
            stops = np.minimum(starts + length, n)
            row = np.full(len(starts) * length, PAD, dtype)
            row[:n] = ids[:n]
            first, last = np.searchsorted(ends, starts, "right").tolist(), np.searchsorted(ends, stops - 1, "right").tolist()
            raw, stride = row.tobytes(), length * row.itemsize
            m = len(starts)
            cols = [[part] * m, range(k, k + m), (stops - starts).tolist(), [raw[i * stride : (i + 1) * stride] for i in range(m)], [owners[x : y + 1] for x, y in zip(first, last)]]
            done = int(np.searchsorted(ends, n, "right"))
            ids, owners, ends, k = ids[n:], owners[done:], ends[done:] - n, k + m
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["part", "k", "n_tokens", "ids", "doc_ids"])

        for b in small_batches(batches, ROWS):
            new, bounds = known.encode(b.column(1))
            ends = np.concatenate([ends, len(ids) + bounds[1:] + np.arange(1, len(bounds))])
            owners += b.column(0).to_pylist()
            ids = np.concatenate([ids, np.insert(new.astype(dtype), bounds[1:], END)])
            whole = len(ids) // length * length
            if whole:
                yield out(whole)
        if len(ids):
            yield out(len(ids))

    return run


def _slot(n: int, key: int):
    @F.pandas_udf("bigint")
    def slot(number: pd.Series) -> pd.Series:
        return pd.Series(feistel(number.to_numpy(np.int64), n, key))

    return slot(F.col("first") + F.col("k"))


def _write(folder: str, n: int, key: int, shard: int, length: int, size: int):
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        now, sink, temp, due = None, None, None, 0

        def close():
            if sink is not None:
                sink.close()
                if due != min(n, (now + 1) * shard):
                    raise ValueError(f"shard {now} is not whole")
                fs.move(temp, f"{root}/shard-{now:08d}.bin")  # whole or not at all; a task run again writes the same bytes

        for b in batches:
            for number, slot, m, ids in zip(*(b.column(i).to_pylist() for i in range(4))):
                if number != now:
                    close()
                    now, due, temp = number, number * shard, f"{root}/_{uuid.uuid4().hex}"
                    sink = fs.open_output_stream(temp)
                    sink.write(struct.pack(HEADER, MAGIC, size, length, now, now * shard, min(shard, n - now * shard), shard, n, key % 2**64))
                if slot != due:
                    raise ValueError(f"slot {due} is missing or repeated")
                sink.write(struct.pack("<I", m) + ids)
                due += 1
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("slot"), b.column("doc_ids")], ["slot", "doc_ids"])
        close()

    return run


def write_shards(docs: DataFrame, folder: str, scratch: Scratch, key: int = 20240501, length: int = LENGTH, shard: int = SHARD, tokenizer: str | None = None) -> DataFrame:
    """Write the token ids of all ``docs`` to shards in ``folder``; (slot, doc_ids) of every sequence.

    Each task joins its documents' ids, an end id after each, and cuts them into sequences of ``length``
    tokens; its last one is padded. Sequences are written down once, so their numbers are settled before
    slots are drawn. Ranges of whole shards go to range partitions, each written in order of slot.
    """
    from tokenizers import Tokenizer

    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    dtype = "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_sequences(path, length, dtype), _SEQ)
    rows = scratch.write(rows, "sequences")
    counts = [(r["part"], r["count"]) for r in rows.groupBy("part").count().collect()]  # one row, 16 bytes, for each input partition
    counts.sort()
    n = sum(c for _, c in counts)
    firsts = [(p, int(at)) for (p, _), at in zip(counts, np.append(0, np.cumsum([c for _, c in counts])))]
    firsts = F.broadcast(spark.createDataFrame(firsts, "part bigint, first bigint"))
    placed = rows.join(firsts, "part").withColumn("slot", _slot(n, key)).withColumn("shard", F.floor(F.col("slot") / shard))
    placed = placed.select("shard", "slot", "n_tokens", "ids", "doc_ids")
    # a shard is a range of slots, a task's shards are a range too
    shards = -(-n // shard)
    each = min(RANGE, max(1, shards // TASKS))
    placed = placed.repartitionById(max(1, -(-shards // each)), F.floor(F.col("shard") / each).cast("int")).sortWithinPartitions("slot")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    return scratch.write(placed.mapInArrow(_write(folder, n, key, shard, length, np.dtype(dtype).itemsize), "slot bigint, doc_ids array<bigint>"), "index")


def _check_header(raw: bytes, path: str):
    if len(raw) < HEADER_BYTES or raw[:8] != MAGIC:
        raise ValueError(f"{path}: not a shard")
    return struct.unpack(HEADER, raw[: HEADER_BYTES])


def read_from(folder: str, slot: int = 0):
    """(slot, ids) of every sequence from ``slot`` on, in training order: a reader resumes at any slot by one seek."""
    fs, root = pafs.FileSystem.from_uri(folder)
    names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".bin"))
    if not names:
        return
    with fs.open_input_file(names[0]) as f:
        _, size, length, _, _, _, shard, n, _ = _check_header(f.read(HEADER_BYTES), names[0])
    stride, dtype = 4 + size * length, "<u2" if size == 2 else "<u4"
    while slot < n:
        with fs.open_input_file(f"{root}/shard-{slot // shard:08d}.bin") as f:
            count = _check_header(f.read(HEADER_BYTES), f"shard {slot // shard}")[5]
            f.seek(HEADER_BYTES + (slot % shard) * stride)
            for _ in range(slot % shard, count):
                raw = f.read(stride)
                yield slot, np.frombuffer(raw, dtype, struct.unpack_from("<I", raw)[0], 4)
                slot += 1


def _read(batches):
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            raw = content.as_buffer()
            _, size, length, number, first, count, _, _, _ = _check_header(raw[: HEADER_BYTES].to_pybytes(), path)
            stride = 4 + size * length
            if len(raw) != HEADER_BYTES + count * stride:
                raise ValueError(f"{path}: {len(raw)} bytes for {count} sequences")
            view, rows = memoryview(raw), []
            for i in range(count):
                at = HEADER_BYTES + i * stride
                m = struct.unpack_from("<I", view, at)[0]
                rows.append((first + i, number, m, zlib.crc32(view[at + 4 : at + 4 + m * size])))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["slot", "shard", "n_tokens", "ids_crc32"])


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(slot, shard, n_tokens, ids_crc32) of every sequence of a folder of shards, each file checked whole."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "content")
    return files.mapInArrow(_read, "slot bigint, shard bigint, n_tokens bigint, ids_crc32 bigint")


def materialise(docs: DataFrame, key: int = 20240501, length: int = LENGTH, shard: int = SHARD, tokenizer: str | None = None) -> DataFrame:
    """(slot, shard, n_tokens, ids_crc32, doc_ids): every sequence of the shards written from ``docs``, as read back.

    docs: doc_id bigint, text string (null and empty: only the end id; a null doc_id is null in doc_ids).
    ids_crc32: of the ids as stored, padding apart. doc_ids: the documents that have tokens in the sequence, in order; a long document is in
    several. Repeated rows are written each. Other columns are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    index = write_shards(docs, scratch.path("shards"), scratch, key, length, shard, tokenizer)
    scratch.drop("sequences")
    if index.isEmpty():
        out = spark.createDataFrame([], "slot bigint, shard bigint, n_tokens bigint, ids_crc32 bigint, doc_ids array<bigint>")
    else:
        out = kept_whole(read_shards(spark, scratch.path("shards")).join(index, "slot"))
    scratch.drop()
    return out
