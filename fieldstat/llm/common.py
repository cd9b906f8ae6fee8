"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z alone, whatever the locale does to other letters."""
    return F.translate(c, UPPER, UPPER.lower())


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids fall in no fold (-1)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a fresh temporary one only where it is unset and all runs in one JVM (local tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fieldstat-")
        spark.sparkContext.setCheckpointDir(base)
    return base


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Texts are sent to Python so many at a time: a batch is held whole by Spark and by Python.
SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048"}


class Scratch:
    """A folder of intermediate tables under :func:`shared_dir`, dropped by name once no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        with settings(self.spark, SMALL):
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in [self.path(n) for n in names] or [self.root]:
            p = jvm.org.apache.hadoop.fs.Path(p)
            p.getFileSystem(conf).delete(p, True)


def settle(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results have been written: it does so once the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def kept_whole(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint; its files go when the DataFrame is no longer referenced."""
    shared_dir(df.sparkSession)
    with settings(df.sparkSession, SMALL):
        return df.checkpoint()


#: Keys of dropped rows above which the anti join shuffles instead of broadcasting (about 40 bytes each).
BROADCAST_KEYS = 300_000


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id, null or not, and xxhash64 of the text are in ``bad`` (doc_id, h); all columns stay.

    Repeated rows go together. Columns of ``docs`` may have any names.
    """
    bad = kept_whole(bad.select(F.col("doc_id").alias("k_id"), F.col("h").alias("k_h")).distinct())
    few = bad.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(bad) if few else bad, docs["doc_id"].eqNullSafe(bad["k_id"]) & (F.xxhash64(docs["text"]) == bad["k_h"]), "left_anti")


_TABLE: dict = {}


def worker_table(kind, make):
    """A Python worker's table of words, kept from task to task; a task of another kind drops it first.

    Workers outlive tasks and serve all operators, so each holds one table at a time.
    """
    if kind not in _TABLE:
        _TABLE.clear()
        give_back()
        _TABLE[kind] = make()
    return _TABLE[kind]


def give_back() -> None:
    """Return freed memory to the system: a worker between tasks would keep it from its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


class WordHash(dict):
    """Bytes of a word -> 64-bit hash, computed once for each distinct word of a worker.

    The table is emptied at ``limit`` words, which bounds memory and changes no result.
    """

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then the runs of ``[^\\x20\\x09-\\x0D]``, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on whole arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def small_batches(batches, rows: int = 256, chars: int = 4_000_000):
    """Cut Arrow batches so that one piece holds at most ``rows`` rows and about ``chars`` of text (one row at least)."""
    for b in batches:
        sizes = np.zeros(b.num_rows, dtype=np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type):
                n = pc.binary_length(c).to_numpy(zero_copy_only=False)
                sizes += np.nan_to_num(n.astype(float)).astype(np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (i - start >= rows or total + n > chars):
                yield b.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < b.num_rows:
            yield b.slice(start)
        del b
    give_back()


def safe(name: str) -> str:
    return re.sub(r"\W", "_", name)
