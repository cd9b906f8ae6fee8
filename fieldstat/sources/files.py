"""Readers and writers of the trial tables' file formats."""

from __future__ import annotations

import io
import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tables(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Tab-separated with a header; a schema saves the pass that infers one."""
    r = spark.read.option("sep", "\t").option("header", True)
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)


def with_path_keys(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Adds a column for each name: the first group of its pattern in the row's file path."""
    return df.select("*", *[F.regexp_extract(F.col("_metadata.file_path"), p, 1).alias(k) for k, p in keys.items()])


def read_matrix_text(spark: SparkSession, path: str, rows: list[str]) -> DataFrame:
    """(pos, one column for each text line) of a white-space matrix with one line for each name in ``rows``."""
    lines = spark.read.text(path, wholetext=True).select(F.split(F.trim("value"), r"\n").alias("l"))
    arrays = [F.transform(F.split(F.trim(F.col("l")[i]), r"\s+"), lambda v: v.cast("double")).alias(n) for i, n in enumerate(rows)]
    zipped = lines.select(*arrays).select(F.posexplode(F.arrays_zip(*rows)).alias("pos", "v"))
    return zipped.select("pos", *[F.col("v")[n].alias(n) for n in rows])


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, y): the rows of every ``.npy`` array, each file decoded where it is read."""

    def run(batches):
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a.reshape(len(a), -1 if a.size else 0).astype(float) if a.ndim else a.reshape(1, 1)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(a)), pa.array(np.arange(len(a))), pa.array(a.tolist(), pa.list_(pa.float64()))], ["path", "row", "y"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, row bigint, y array<double>")


def write_each(df: DataFrame, folder: str, keys: list[str], y: str, encode, ending: str) -> DataFrame:
    """One file for each row, named by the row's keys, its bytes ``encode`` of the array y; (path, n) of the files, n the array's length.

    folder: a URI that the executors share. A file is written beside its place and moved there, so it is whole or not there at all, and a
    task run again writes the same bytes. Keys must tell rows apart.
    """
    name = F.concat_ws("_", *[F.concat(F.lit(f"{k}-"), F.regexp_replace(F.coalesce(F.col(k).cast("string"), F.lit("null")), r"[^\w.-]", "_")) for k in keys])

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for b in batches:
            done = []
            for n, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                temp = f"{root}/_{uuid.uuid4().hex}"
                with fs.open_output_stream(temp) as f:
                    f.write(encode(values))
                fs.move(temp, f"{root}/{n}{ending}")
                done.append((f"{root}/{n}{ending}", len(values or [])))
            paths, sizes = zip(*done) if done else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "n"])

    return df.select(name.alias("name"), F.col(y).cast("array<double>")).mapInArrow(run, "path string, n bigint")


def write_npy(df: DataFrame, folder: str, keys: list[str], y: str = "y") -> DataFrame:
    """One ``.npy`` file for each row, as :func:`write_each`; a null array is an empty file of no numbers."""

    def encode(values):
        out = io.BytesIO()
        np.save(out, np.array(values or [], float), allow_pickle=False)
        return out.getvalue()

    return write_each(df, folder, keys, y, encode, ".npy")


class _Plain(pickle.Unpickler):
    """Reads numbers, text, containers and numpy arrays; anything else in a file is an error, never run."""

    ALLOWED = {("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "scalar"), ("numpy._core.numeric", "_frombuffer"), ("numpy.core.numeric", "_frombuffer"), ("_codecs", "encode")}

    def find_class(self, module, name):
        if (module, name) not in self.ALLOWED:
            raise pickle.UnpicklingError(f"{module}.{name} is not read from files")
        return super().find_class(module, name)


def read_pickled(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, row, y): the arrays of pickled dictionaries of arrays (name is their key), or of single arrays (name is null)."""

    def run(batches):
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = _Plain(io.BytesIO(content)).load()
                for name, a in found.items() if isinstance(found, dict) else [(None, found)]:
                    a = np.asarray(a, float)
                    a = a.reshape(len(a), -1 if a.size else 0) if a.ndim else a.reshape(1, 1)
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(a), pa.string()), pa.array([None if name is None else str(name)] * len(a), pa.string()), pa.array(np.arange(len(a))), pa.array(a.tolist(), pa.list_(pa.float64()))], ["path", "name", "row", "y"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, name string, row bigint, y array<double>")


def write_runs(df: DataFrame, path: str) -> None:
    """Result maps, one folder for each run: a run is read alone, and written again alone."""
    df.write.mode("overwrite").partitionBy("run").parquet(path)


def append_results(df: DataFrame, path: str) -> None:
    """Add rows to a log of results; readers see each append whole."""
    df.write.mode("append").parquet(path)


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    df.select(column).write.mode("overwrite").text(path)


def existing_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path) of the files that match, from a listing alone."""
    return spark.read.format("binaryFile").load(pattern).select("path")
