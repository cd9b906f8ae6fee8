"""Volumes in single-file NIfTI-1: a data source planned by slabs, masks, resampling to another grid, and a writer.

Features are numbered as in the rest of the library: the last axis changes fastest, so ``grid_edges(shape)`` fits.
"""

from __future__ import annotations

import gzip
import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import write_each

#: The format's codes of number types.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
#: Length of the header, and of header and empty extension.
HEADER, DATA = 348, 352
#: Bytes of files that one partition reads; larger plain files are cut into slabs.
PART = 64 << 20
#: Voxels decoded at a time.
STEP = 1 << 20


@dataclass
class Header:
    shape: tuple[int, int, int]
    times: int
    dtype: np.dtype
    offset: int
    slope: float
    inter: float
    affine: np.ndarray


def parse(b: bytes, path: str = "") -> Header:
    """The header of a single-file volume; anything else is an error that names the file."""
    if len(b) < HEADER or b[344:347] != b"n+1":
        raise ValueError(f"not a single-file NIfTI-1 volume: {path}")
    end = "<" if struct.unpack_from("<i", b)[0] == HEADER else ">"
    get = lambda kind, at: struct.unpack_from(end + kind, b, at)
    dim, (code,) = get("8h", 40), get("h", 70)
    if code not in TYPES:
        raise ValueError(f"number type {code} is not read: {path}")
    if not 1 <= dim[0] <= 7 or any(d < 0 for d in dim[1 : dim[0] + 1]):
        raise ValueError(f"dimensions {dim}: {path}")
    sizes = [int(d) for d in dim[1 : dim[0] + 1]] + [1] * (7 - dim[0])
    pixdim, (offset, slope, inter) = get("8f", 76), get("3f", 108)
    affine = np.diag([*pixdim[1:4], 1.0])
    if get("h", 254)[0] > 0:
        affine[:3] = np.reshape(get("12f", 280), (3, 4))
    elif get("h", 252)[0] > 0:
        x, y, z = get("3f", 256)
        w = np.sqrt(max(0.0, 1 - x * x - y * y - z * z))
        turn = np.eye(3) * (2 * w * w - 1) + 2 * np.outer((x, y, z), (x, y, z)) + 2 * w * np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
        affine[:3, :3] = turn * (pixdim[1], pixdim[2], pixdim[3] * (-1 if pixdim[0] < 0 else 1))
        affine[:3, 3] = get("3f", 268)
    scale = slope if slope and np.isfinite(slope) else 1.0
    shift = inter if slope and np.isfinite(slope) else 0.0
    return Header(tuple(sizes[:3]), int(np.prod(sizes[3:])), np.dtype(end + TYPES[code]), int(offset) or DATA, scale, shift, affine)


def encode(y: np.ndarray, shape: tuple[int, int, int], affine: np.ndarray, compress: bool = True) -> bytes:
    """One map as a volume of 64-bit numbers; the same map gives the same bytes."""
    h, a = bytearray(DATA), np.asarray(affine, float)
    struct.pack_into("<i", h, 0, HEADER)
    struct.pack_into("<8h", h, 40, 3, *shape, 1, 1, 1, 1)
    struct.pack_into("<2h", h, 70, 64, 64)
    struct.pack_into("<8f", h, 76, 1.0, *np.sqrt((a[:3, :3] ** 2).sum(0)), 1.0, 1.0, 1.0, 1.0)
    struct.pack_into("<2f", h, 108, DATA, 1.0)
    struct.pack_into("<h", h, 254, 1)
    struct.pack_into("<12f", h, 280, *a[:3].ravel())
    h[344:348] = b"n+1\0"
    out = bytes(h) + np.asarray(y, "<f8").reshape(shape).tobytes("F")
    return gzip.compress(out, mtime=0) if compress else out


def _opened(uri: str):
    """The file's bytes, decompressed while they are read where the name ends in .gz."""
    fs, at = pafs.FileSystem.from_uri(uri)
    f = fs.open_input_file(at)
    return gzip.GzipFile(fileobj=f) if uri.endswith(".gz") else f


class _Files(InputPartition):
    """(uri, k, n): the k-th of n equal runs of planes of each file."""

    def __init__(self, parts: list[tuple[str, int, int]]):
        self.parts = parts


class _Reader(DataSourceReader):
    def __init__(self, path: str, part: int):
        self.path, self.part = path, part

    def partitions(self):
        """From names and sizes alone: headers are read by the tasks."""
        root = re.sub(r"^file:/+", "file:///", self.path if re.match(r"^\w+:/", self.path) else f"file://{self.path}")
        fs, at = pafs.FileSystem.from_uri(root)
        info = fs.get_file_info(at)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
        before = root[: len(root) - len(at)] if root.endswith(at) else "file://"
        out, some, size = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            if f.type != pafs.FileType.File or not f.path.endswith((".nii", ".nii.gz")) or f.base_name.startswith("_"):
                continue
            n = 1 if f.path.endswith(".gz") else max(1, -(-f.size // self.part))
            if n > 1:
                out += [_Files([(before + f.path, k, n)]) for k in range(n)]
                continue
            if some and size + f.size > self.part:
                out.append(_Files(some))
                some, size = [], 0
            some, size = [*some, (before + f.path, 0, 1)], size + f.size
        return [*out, _Files(some)] if some or not out else out

    def read(self, partition):
        for uri, k, n in partition.parts:
            with _opened(uri) as f:
                h = parse(f.read(HEADER), uri)
                x, y, z = h.shape
                plane, planes = x * y, z * h.times
                first, last = planes * k // n, planes * (k + 1) // n
                f.seek(h.offset + first * plane * h.dtype.itemsize)
                place = (np.arange(x) * y + np.arange(y)[:, None]).ravel() * z
                step = max(1, STEP // max(plane, 1))
                for start in range(first, last, step):
                    count = min(step, last - start)
                    b = f.read(count * plane * h.dtype.itemsize)
                    if len(b) != count * plane * h.dtype.itemsize:
                        raise ValueError(f"the file ends before its last voxel: {uri}")
                    value = np.frombuffer(b, h.dtype).astype(float) * h.slope + h.inter
                    at = np.repeat(np.arange(start, start + count), plane)
                    feature = np.tile(place, count) + at % max(z, 1)
                    columns = [pa.array([uri] * len(value), pa.string()), pa.array((at // max(z, 1)).astype(np.int32)), pa.array(feature.astype(np.int32)), pa.array(value)]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "t", "feature", "value"])


class VolumeSource(DataSource):
    """``spark.read.format("nifti").load(folder)``: path, t, feature, value of every voxel of every .nii and .nii.gz file.

    Plain files above ``part`` bytes are cut into slabs that several tasks read; compressed ones can't be. t is 0 in files of one map.
    """

    @classmethod
    def name(cls):
        return "nifti"

    def schema(self):
        return "path string, t int, feature int, value double"

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("part", PART)))


def read_volumes(spark: SparkSession, path: str, part: int = PART) -> DataFrame:
    """(path, t, feature, value) of the volumes under ``path``, a folder or file that the executors share; NaN stays NaN."""
    spark.dataSource.register(VolumeSource)
    return spark.read.format("nifti").option("part", part).load(path)


def volume_grid(path: str) -> tuple[tuple[int, int, int], np.ndarray]:
    """Shape and affine of one file, from its header."""
    with _opened(path if re.match(r"^\w+:/", path) else f"file://{path}") as f:
        h = parse(f.read(HEADER), path)
    return h.shape, h.affine


def in_mask(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells whose feature the mask's volume marks by a number other than 0; null and NaN mark nothing."""
    on = mask.filter("value <> 0 AND NOT isnan(value)").select("feature").distinct()
    return cells.join(on, "feature", "left_semi").select(cells.columns)


def maps(cells: DataFrame) -> DataFrame:
    """(path, t, y): each map's values in order of feature, as one row; after a mask they are the masked vector."""
    pairs = F.array_sort(F.collect_list(F.struct("feature", "value")))
    return cells.groupBy("path", "t").agg(F.transform(pairs, lambda v: v["value"]).alias("y"))


def fitting_grid(shape: tuple[int, int, int], affine: np.ndarray, voxel: tuple[float, float, float]) -> tuple[tuple[int, int, int], np.ndarray]:
    """Shape and affine of the straight grid of such voxels that begins at the least corner of the given one and covers it."""
    corners = np.array([(i, j, k, 1) for i in (0, shape[0] - 1) for j in (0, shape[1] - 1) for k in (0, shape[2] - 1)], float) @ np.asarray(affine, float).T
    low, high = corners[:, :3].min(0), corners[:, :3].max(0)
    out = np.diag([*voxel, 1.0])
    out[:3, 3] = low
    return tuple(int(np.ceil((h - a) / v - 1e-6)) + 1 for a, h, v in zip(low, high, voxel)), out


def resample(cells: DataFrame, shape: tuple[int, int, int], affine: np.ndarray, to_shape: tuple[int, int, int], to_affine: np.ndarray, nearest: bool = False) -> DataFrame:
    """(path, t, feature, value) on another grid: the mean of the eight voxels around each place by their nearness, or the nearest one.

    Places outside the old grid are 0, and voxels beyond its edge count as 0, as do those that ``cells`` lacks. Which voxel goes to which
    place, and by how much, depends on the grids alone: each cell is joined to its places, and a place adds up what it gets.
    """
    spark, back = cells.sparkSession, np.linalg.inv(np.asarray(affine, float)) @ np.asarray(to_affine, float)
    n = int(np.prod(to_shape))
    at = [F.floor(F.col("id") / (to_shape[1] * to_shape[2])), F.floor(F.col("id") / to_shape[2]) % to_shape[1], F.col("id") % to_shape[2]]
    # rounded, so that places on a voxel fall on it in spite of the division
    where = [F.round(sum(float(m) * a for m, a in zip(row, at)) + float(row[3]), 9) for row in back[:3]]
    places = spark.range(n).select(F.col("id").cast("int").alias("place"), *[w.alias(f"w{i}") for i, w in enumerate(where)])
    if nearest:
        near = places.select("place", *[F.floor(F.col(f"w{i}") + 0.5).alias(f"v{i}") for i in range(3)], F.lit(1.0).alias("share"))
    else:
        corners = F.explode(F.array(*[F.struct(*[F.lit(c >> i & 1).alias(f"c{i}") for i in range(3)]) for c in range(8)]))
        near = places.select("*", corners.alias("c"))
        rest = [F.col(f"w{i}") - F.floor(F.col(f"w{i}")) for i in range(3)]
        part = [F.when(F.col(f"c.c{i}") == 1, r).otherwise(1 - r) for i, r in enumerate(rest)]
        near = near.select("place", *[(F.floor(F.col(f"w{i}")) + F.col(f"c.c{i}")).alias(f"v{i}") for i in range(3)], (part[0] * part[1] * part[2]).alias("share"))
    for i in range(3):
        near = near.filter((F.col(f"v{i}") >= 0) & (F.col(f"v{i}") < shape[i]))
    feature = ((F.col("v0") * shape[1] + F.col("v1")) * shape[2] + F.col("v2")).cast("int")
    near = near.filter("share > 0").select(feature.alias("feature"), "place", "share")
    got = cells.join(near, "feature").groupBy("path", "t", "place").agg(F.sum(F.col("share") * F.col("value")).alias("value"))
    whole = cells.select("path", "t").distinct().join(places.select("place"))
    return whole.join(got, ["path", "t", "place"], "left").select("path", "t", F.col("place").alias("feature"), F.coalesce("value", F.lit(0.0)).alias("value"))


def write_volumes(df: DataFrame, folder: str, keys: list[str], shape: tuple[int, int, int], affine: np.ndarray, y: str = "y", compress: bool = True) -> DataFrame:
    """One volume for each row, named by the row's keys; (path, n) of the files. A null map is all NaN, one of another length an error."""
    n, affine = int(np.prod(shape)), np.asarray(affine, float)

    def one(values):
        if values is not None and len(values) != n:
            raise ValueError(f"{len(values)} numbers for a grid of {n}")
        return encode(np.full(n, np.nan) if values is None else np.array(values, float), shape, affine, compress)

    return write_each(df, folder, keys, y, one, ".nii.gz" if compress else ".nii")
