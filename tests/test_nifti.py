"""Volumes are read, masked, resampled and written without an imaging library; headers are laid out here by the format's description."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstat.operators.clusters import grid_edges
from fieldstat.sources import nifti

AFFINE = np.array([[-2.0, 0, 0, 10], [0, 3, 0, -5], [0, 0, 4, 7], [0, 0, 0, 1]])


def volume(a, affine=AFFINE, end="<", slope=1.0, inter=0.0, sform=1, extra=b""):
    """Bytes of a volume whose axes are x, y, z and perhaps t."""
    code = {"u1": 2, "i2": 4, "i4": 8, "f4": 16, "f8": 64}[a.dtype.str[1:]]
    h = bytearray(352)
    h[0:4] = struct.pack(end + "i", 348)
    h[40:56] = struct.pack(end + "8h", a.ndim, *a.shape, *[1] * (7 - a.ndim))
    h[70:74] = struct.pack(end + "2h", code, a.dtype.itemsize * 8)
    h[76:108] = struct.pack(end + "8f", 1, 2, 3, 4, 1, 1, 1, 1)
    h[108:120] = struct.pack(end + "3f", 352 + len(extra), slope, inter)
    h[252:256] = struct.pack(end + "2h", 0, sform)
    h[280:328] = struct.pack(end + "12f", *affine[:3].ravel())
    h[344:348] = b"n+1\0"
    return bytes(h) + extra + a.astype(a.dtype.newbyteorder(end)).tobytes("F")


def test_volumes_of_all_kinds_are_read(spark, tmp_path):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 200, (3, 4, 5)).astype("u1")
    b = rng.normal(size=(3, 4, 5, 2))
    b[0, 0, 0, 0] = np.nan
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.nii").write_bytes(volume(a, end=">", slope=0.5, inter=-1.0, extra=b"\0" * 48))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(volume(b)))
    (tmp_path / "c.nii").write_bytes(volume(b.astype("f4"), slope=0.0))
    (tmp_path / "notes.txt").write_text("no volume")
    whole = nifti.read_volumes(spark, str(tmp_path))
    slabs = nifti.read_volumes(spark, str(tmp_path), part=200)
    assert slabs.rdd.getNumPartitions() > 3
    for df in (whole, slabs):
        got = {(r["path"].rsplit("/", 1)[1], r["t"]): r["y"] for r in nifti.maps(df).collect()}
        assert set(got) == {("a.nii", 0), ("b.nii.gz", 0), ("b.nii.gz", 1), ("c.nii", 0), ("c.nii", 1)}
        assert np.array_equal(got["a.nii", 0], a.ravel() * 0.5 - 1)
        for t in (0, 1):
            assert np.array_equal(got["b.nii.gz", t], b[..., t].ravel(), equal_nan=True)
            assert np.array_equal(got["c.nii", t], b[..., t].ravel().astype("f4").astype(float), equal_nan=True)
    one = nifti.read_volumes(spark, f"file://{tmp_path}/c.nii")
    assert one.count() == 120 and one.agg(F.max("feature")).first()[0] == 59
    shape, affine = nifti.volume_grid(f"{tmp_path}/deep/a.nii")
    assert shape == (3, 4, 5) and np.array_equal(affine, AFFINE)


def test_headers_without_an_affine_and_broken_files(spark, tmp_path):
    a = np.zeros((2, 2, 2), "i2")
    assert np.array_equal(nifti.parse(volume(a, sform=0)).affine, np.diag([2.0, 3, 4, 1]))
    h = bytearray(volume(a, sform=0))
    h[252:254] = struct.pack("<h", 1)
    h[256:280] = struct.pack("<6f", 0, 0, np.sqrt(0.5), 1, 2, 3)  # a quarter turn around z
    assert np.allclose(nifti.parse(bytes(h)).affine, [[0, -3, 0, 1], [2, 0, 0, 2], [0, 0, 4, 3], [0, 0, 0, 1]], atol=1e-6)
    for bad, words in ((b"short", "not a single-file"), (volume(a)[:-1], "ends before"), (volume(a)[:70] + b"\x80\0" + volume(a)[72:], "number type")):
        folder = tmp_path / words.split()[0]
        folder.mkdir()
        (folder / "x.nii").write_bytes(bad)
        with pytest.raises(Exception, match=words):
            nifti.read_volumes(spark, str(folder)).collect()
    (tmp_path / "none").mkdir()
    assert nifti.read_volumes(spark, f"{tmp_path}/none").count() == 0


def test_maps_make_a_round_trip_through_a_mask(spark, tmp_path):
    rng = np.random.default_rng(2)
    shape = (3, 2, 4)
    y = rng.normal(size=(3, 24))
    df = spark.createDataFrame([("t/1", i, y[i].tolist()) for i in range(3)] + [("null", 0, None)], "term string, run int, y array<double>")
    for compress in (True, False):
        out = nifti.write_volumes(df, f"file://{tmp_path}/out{compress}", ["term", "run"], shape, AFFINE, compress=compress).collect()
        assert sorted(r["n"] for r in out) == [0, 24, 24, 24]
        cells = nifti.read_volumes(spark, f"{tmp_path}/out{compress}")
        mask = spark.createDataFrame([(f, v) for f, v in enumerate([0.0, 1.0, float("nan"), 2.0] * 6)], "feature int, value double")
        got = {r["path"].rsplit("/", 1)[1].split(".")[0]: r["y"] for r in nifti.maps(nifti.in_mask(cells, mask)).collect()}
        on = np.arange(24) % 2 == 1
        assert all(np.array_equal(got[f"term-t_1_run-{i}"], y[i][on]) for i in range(3)) and np.isnan(got["term-null_run-0"]).all()
        assert nifti.volume_grid(out[0]["path"])[0] == shape and np.array_equal(nifti.volume_grid(out[0]["path"])[1], AFFINE)
    with pytest.raises(Exception, match="numbers for a grid"):
        nifti.write_volumes(df.filter("run = 1"), f"file://{tmp_path}/bad", ["run"], (2, 2, 2), AFFINE).collect()
    # numbers of features fit the lattice's edges: a step along the last axis is a step of one
    assert {(r["src"], r["dst"]) for r in grid_edges(spark, shape).collect()} >= {(0, 1), (0, 4), (0, 8)}


def plain(a, affine, shape, to, nearest):
    out, back = np.zeros(shape), np.linalg.inv(affine) @ to
    for at in np.ndindex(*shape):
        w = (back @ [*at, 1])[:3].round(9)
        if nearest:
            v = np.floor(w + 0.5).astype(int)
            out[at] = a[tuple(v)] if ((v >= 0) & (v < a.shape)).all() else 0
            continue
        for c in np.ndindex(2, 2, 2):
            v = np.floor(w).astype(int) + c
            if ((v >= 0) & (v < a.shape)).all():
                out[at] += a[tuple(v)] * np.prod(np.where(np.array(c) == 1, w - np.floor(w), 1 - (w - np.floor(w))))
    return out


def test_resampling_equals_a_plain_version(spark, tmp_path):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(5, 4, 6))
    cells = spark.createDataFrame([("p", 0, i, float(v)) for i, v in enumerate(a.ravel())], "path string, t int, feature int, value double")
    shape, to = nifti.fitting_grid(a.shape, AFFINE, (4, 4, 4))
    assert shape == (3, 4, 6) and np.array_equal(to[:3, 3], [2, -5, 7])
    tilted = to.copy()
    tilted[:3, :3] = to[:3, :3] @ [[0.8, -0.6, 0], [0.6, 0.8, 0], [0, 0, 1]]
    for target in (to, tilted):
        for nearest in (False, True):
            got = nifti.resample(cells, a.shape, AFFINE, shape, target, nearest).orderBy("feature").toPandas()
            assert np.allclose(got.value.to_numpy().reshape(shape), plain(a, AFFINE, shape, target, nearest), atol=1e-9)
    same = nifti.resample(cells, a.shape, AFFINE, a.shape, AFFINE).orderBy("feature").toPandas()
    assert np.allclose(same.value, a.ravel())
    assert nifti.resample(cells.limit(0), a.shape, AFFINE, shape, to).count() == 0
