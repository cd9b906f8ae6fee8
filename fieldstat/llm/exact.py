"""Exact deduplication as a stateful stream: disk-backed keyed state, no expiry, full bytes checked on hits."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, Scratch, kept_whole, settings

ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # all stores of an executor share this much memory, however many partitions of state it holds
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    # else each partition's store sets several MB of disk aside, whatever it holds
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Digests of repeated texts above which their lookup shuffles instead of broadcasting (about 100 bytes each).
BROADCAST_DIGESTS = 200_000
#: Records of such texts above which their places are shuffled instead of broadcast (about 120 bytes each).
BROADCAST_HITS = 200_000
#: Files up to which a lookup names those to open; where its rows lie in more, files are told apart by the join alone.
NAMED_FILES = 2000


def normalised(text: Column) -> Column:
    """Null counts as empty; spaces, tabs and line breaks are deleted."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def run_stream(spark: SparkSession, records: str, schema, state: str, options: dict[str, str] | None = None) -> None:
    """Feed the record files not yet seen to the keyed state in ``state``, and stop.

    The state of a digest is the best record so far (longest original text, then smallest id, with the place
    it came from) and the number of records. A digest's records of one task are combined before the shuffle,
    so a digest that a third of the input shares moves one row a task. Files and offsets are logged beside
    the state: after a failure or with more files the same call goes on where it stopped.
    """
    rows = spark.readStream.schema(schema).options(**(options or {})).parquet(records)
    held = rows.groupBy("digest").agg(F.max("record").alias("best"), F.count("*").alias("n"))
    with settings(spark, ROCKS):
        q = held.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """digest, keep_id, keep_chars, place, group_size: the state store's content."""
    with settings(spark, ROCKS):
        held = spark.read.format("statestore").load(state)
    best, n = (c for c in held.schema["value"].dataType.names)
    held = held.select(F.col("key")["digest"].alias("digest"), F.col("value")[best].alias("best"), F.col("value")[n].alias("group_size"))
    # place: file and row of the best record's content; null where the table is not one of files
    return held.select("digest", F.bitwise_not("best.order").alias("keep_id"), F.col("best.chars").alias("keep_chars"), F.col("best.place").alias("place"), "group_size")


def located(docs: DataFrame) -> DataFrame | None:
    """doc_id, text, path, file (a hash of the path) and row of every row, where ``docs`` is read from files; else None."""
    if "_metadata" in docs.columns:
        return None
    try:
        path = F.col("_metadata.file_path")
        return docs.select("doc_id", "text", path.alias("path"), F.xxhash64(path).alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return None


def paths_of(docs: DataFrame) -> DataFrame:
    """(file, path) of the files of located ``docs``: what a place's file, a short number in the state, is called. Reads no text."""
    return docs.select("file", "path").distinct()


def opened(docs: DataFrame, places: DataFrame, files: DataFrame) -> DataFrame:
    """``places`` (at_file, at_row and other columns) with text, the content at each place.

    docs: located; files: as :func:`paths_of`. Only the files that the places lie in are opened, where they are NAMED_FILES at most: Spark
    leaves the others out when it lists files, by their path. Places without a file, or that ``docs`` hasn't, are not returned.
    """
    named = [r["path"] for r in files.join(places.select(F.col("at_file").alias("file")).distinct(), "file", "left_semi").select("path").limit(NAMED_FILES + 1).collect()]
    if len(named) <= NAMED_FILES:
        docs = docs.filter(F.col("path").isin(named) if named else F.lit(False))
    few = places.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS
    there = (F.col("file") == F.col("at_file")) & (F.col("row") == F.col("at_row"))
    return docs.select("file", "row", "text").join(F.broadcast(places) if few else places, there).select(*places.columns, "text")


def collided(docs: DataFrame, light: DataFrame, repeated: DataFrame, digest, files: DataFrame | None = None) -> DataFrame:
    """Digests that name several different texts: the bytes behind every record of a repeated digest are compared in full.

    docs: doc_id, text, and if they are located path, file, row; light: the records, with the place (file, row) of each; files: as
    :func:`paths_of`. The texts are opened by place, so only they are normalised; where records have no place, by digest. Grouping by
    (digest, text) compares the bytes of each hit with those of its group, first within a task, so a text copied any number of times
    leaves a task once.
    """
    few = repeated.count() <= BROADCAST_DIGESTS
    hits = light.join(F.broadcast(repeated) if few else repeated, "digest", "left_semi")
    hits = hits.select("digest", F.col("record.place.file").alias("at_file"), F.col("record.place.row").alias("at_row"))
    t = normalised(F.col("text")).alias("t")
    if files is not None and hits.filter("at_file IS NULL OR at_row IS NULL").isEmpty():
        texts = opened(docs, hits, files).select("digest", t)
    else:
        texts = docs.select(t).withColumn("digest", digest(F.col("t"))).join(F.broadcast(repeated) if few else repeated, "digest", "left_semi")
    return texts.groupBy("digest", "t").count().groupBy("digest").count().filter("count > 1").select("digest")


def exact_duplicates(docs: DataFrame, digest=sha256) -> DataFrame:
    """(doc_id, h, keep_id, group_size, kept, text_sha256) for every row of ``docs`` (doc_id bigint, text string).

    h: the text's xxhash64. Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``; null counts as
    empty. Of equal texts the row with the most code points in its original text, then the smallest doc_id,
    stays; a null doc_id loses to any other. Repeated rows (same doc_id, same text) all name that doc_id and
    all count in group_size. A record's place is the file and row of its content, where ``docs`` is read from files; a table
    beside the state holds the files' paths. Hits are opened there, and compared byte by byte. Extra columns are not read. An empty table gives an empty table.

    Where two different texts share a digest, the texts themselves become the key for that digest.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    text = normalised(F.col("text"))
    chars = F.length(F.coalesce("text", F.lit(""))).cast("long")
    placed = located(docs)
    docs = docs.select("doc_id", "text", F.lit(None).cast("bigint").alias("file"), F.lit(None).cast("bigint").alias("row")) if placed is None else placed
    record = F.struct(chars.alias("chars"), F.bitwise_not("doc_id").alias("order"), F.struct("file", "row").alias("place"))
    light = scratch.write(docs.select("doc_id", F.xxhash64("text").alias("h"), digest(text).alias("digest"), sha256(text).alias("text_sha256"), record.alias("record")), "records")
    if light.isEmpty():
        scratch.drop()
        return light.selectExpr("doc_id", "h", "doc_id AS keep_id", "0L AS group_size", "true AS kept", "text_sha256").limit(0)
    files = None if placed is None else scratch.write(paths_of(placed), "files")
    run_stream(spark, scratch.path("records"), light.schema, scratch.path("state"))
    state = scratch.write(read_state(spark, scratch.path("state")), "held")
    clash = scratch.write(collided(docs, light, state.filter("group_size > 1").select("digest"), digest, files), "clash")
    state = state.drop("place")
    out = light.join(state, "digest")
    if not clash.isEmpty():  # the digest is extended by the text for these
        out = out.join(clash, "digest", "left_anti")
        inner = docs.select("doc_id", F.xxhash64("text").alias("h"), chars.alias("chars"), text.alias("t"), digest(text).alias("digest"), sha256(text).alias("text_sha256")).join(clash, "digest", "left_semi")
        best = inner.groupBy("t").agg(F.max(F.struct("chars", F.bitwise_not("doc_id").alias("order"))).alias("best"), F.count("*").alias("group_size"))
        inner = inner.withColumn("record", F.struct("chars", F.bitwise_not("doc_id").alias("order"), F.struct(F.lit(None).cast("bigint").alias("file"), F.lit(None).cast("bigint").alias("row")).alias("place"))).join(best, "t")
        inner = inner.select("digest", "doc_id", "h", "text_sha256", "record", F.bitwise_not("best.order").alias("keep_id"), F.col("best.chars").alias("keep_chars"), "group_size")
        out = out.unionByName(inner)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("record.chars") == F.col("keep_chars"))
    out = kept_whole(out.select("doc_id", "h", "keep_id", "group_size", stays.alias("kept"), "text_sha256"))
    scratch.drop()
    return out
