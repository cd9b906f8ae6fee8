import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstat.sources import files
from fieldstat.streaming.running import append_log, running_moments


def test_text_sources(spark, tmp_path):
    for s in ("s01", "s02"):
        (tmp_path / s).mkdir()
        (tmp_path / s / "run-3_events.tsv").write_text("onset\ttrial_type\n1.5\tvocal\n2.5\tnonvocal\n")
    df = files.read_tsv(spark, f"{tmp_path}/*/*_events.tsv", "onset double, trial_type string")
    keyed = files.with_path_keys(df, {"subject": r"/(s\d+)/", "run": r"run-(\d+)_"})
    assert sorted((r["subject"], r["run"], r["onset"]) for r in keyed.collect()) == [("s01", "3", 1.5), ("s01", "3", 2.5), ("s02", "3", 1.5), ("s02", "3", 2.5)]
    assert dict(files.read_tsv(spark, f"{tmp_path}/s01").dtypes)["onset"] == "double"
    (tmp_path / "sensors.txt").write_text("10 20 30\n0.1  0.2 0.3\n")
    m = files.read_matrix_text(spark, f"{tmp_path}/sensors.txt", ["theta", "radius"]).orderBy("pos").collect()
    assert [(r["theta"], r["radius"]) for r in m] == [(10, 0.1), (20, 0.2), (30, 0.3)]
    assert files.existing_files(spark, f"{tmp_path}/s0*/*.tsv").count() == 2


def test_arrays_and_sinks(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(12.0).reshape(2, 2, 3))
    rows = files.read_npy(spark, str(tmp_path)).orderBy("row").collect()
    assert [r["y"] for r in rows] == [[0, 1, 2, 3, 4, 5], [6, 7, 8, 9, 10, 11]]
    df = spark.range(6).select((F.col("id") % 2).alias("run"), "id")
    files.write_runs(df, f"{tmp_path}/runs")
    assert spark.read.parquet(f"{tmp_path}/runs").filter("run = 1").count() == 3
    files.append_results(df, f"{tmp_path}/log")
    files.append_results(df, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 12
    files.write_lines(spark.createDataFrame([("a b",)], "line string"), f"{tmp_path}/text")
    assert spark.read.text(f"{tmp_path}/text").first()[0] == "a b"


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, v double").parquet(f"{tmp_path}/in")
    q = running_moments(stream, ["k"], "v").writeStream.format("memory").queryName("moments").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("moments").collect()) == [("a", 2, 2.0, 1.0), ("b", 1, 5.0, 0.0)]
    append_log(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    one = running_moments(spark.createDataFrame([("a", 1.0)], "k string, v double"), ["k"], "v", ddof=1).first()
    assert one["var"] is None


def test_arrays_are_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([("a/b", 1, [1.0, 2.5]), ("c", 2, [3.0, -1.0]), (None, 3, None)], "term string, run int, y array<double>")
    out = {r["path"].rsplit("/", 1)[1]: r["n"] for r in files.write_npy(df, f"file://{tmp_path}/maps", ["term", "run"]).collect()}
    assert out == {"term-a_b_run-1.npy": 2, "term-c_run-2.npy": 2, "term-null_run-3.npy": 0}
    assert np.load(f"{tmp_path}/maps/term-c_run-2.npy").tolist() == [3.0, -1.0] and len(list((tmp_path / "maps").iterdir())) == 3
    back = files.read_npy(spark, f"{tmp_path}/maps").collect()
    assert sorted(r["y"][0] for r in back) == [-1.0, 1.0, 2.5, 3.0]


def test_pickled_arrays_are_read_and_nothing_is_run(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.pkl").write_bytes(pickle.dumps({"x": np.arange(6.0).reshape(3, 2), "n": 4}))
    (tmp_path / "p" / "b.pkl").write_bytes(pickle.dumps([1, 2.5]))
    got = sorted(((r["name"], r["row"], r["y"]) for r in files.read_pickled(spark, f"{tmp_path}/p").collect()), key=repr)
    assert got == sorted([("x", 0, [0.0, 1.0]), ("x", 1, [2.0, 3.0]), ("x", 2, [4.0, 5.0]), ("n", 0, [4.0]), (None, 0, [1.0]), (None, 1, [2.5])], key=repr)
    (tmp_path / "p" / "c.pkl").write_bytes(pickle.dumps(print))
    with pytest.raises(Exception, match="is not read from files"):
        files.read_pickled(spark, f"{tmp_path}/p").count()
