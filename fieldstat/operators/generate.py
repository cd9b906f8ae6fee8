"""Synthetic trials with a signal hidden in some features; every random number is a hash, so tables repeat anywhere."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import normal_quantile


def normal(seed: int, *keys: str | Column) -> Column:
    """A standard normal number for each value of the keys."""
    k = F.concat_ws("-", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in keys])
    u = (F.conv(F.substring(F.md5(k), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)
    return normal_quantile(u)


def centre_pattern(shape: tuple[int, int], fraction: int, total: int = 100) -> np.ndarray:
    """``fraction`` signal cells in a rectangle as square as its divisors allow, in the middle of the field; the rest of
    ``total`` in blobs of 2 x 2 at the places of a 5 x 5 lattice but its centre, in order of rows. The last blob is a
    column of the cells that are left."""
    tall = max(d for d in range(1, math.isqrt(fraction) + 1) if fraction % d == 0)
    sides = np.array([tall, fraction // tall])
    cell = np.indices(shape)
    off = cell - (np.array(shape) // 2 - sides // 2)[:, None, None]
    middle = ((off >= 0) & (off < sides[:, None, None])).all(0)
    # place on the lattice, its rank, and how many cells the places before it leave
    (y, x), (dy, dx) = np.divmod(cell - 10, 20)
    rank = 5 * y + x - (5 * y + x > 12)
    left = total - fraction - 4 * rank
    place = (y >= 0) & (y < 5) & (x >= 0) & (x < 5) & ((y != 2) | (x != 2))
    blob = place & np.where(left >= 4, (dy < 2) & (dx < 2), (dx == 0) & (dy < left))
    return (middle | blob).astype(float)


def pattern_frame(spark: SparkSession, field: np.ndarray) -> DataFrame:
    """(feature, i, j, signal) of a 2-d field."""
    rows = [(i * field.shape[1] + j, i, j, float(field[i, j])) for i in range(field.shape[0]) for j in range(field.shape[1])]
    return spark.createDataFrame(rows, "feature int, i int, j int, signal double")


def block_pattern(shape: tuple[int, int], x: int, y: int, block: np.ndarray) -> np.ndarray:
    """A field with one block at row x, column y, cut off at the field's edge; a place outside means 0, 0."""
    if x > shape[0] or y > shape[1]:
        x = y = 0
    out = np.zeros(shape)
    part = block[: shape[0] - x, : shape[1] - y]
    out[x : x + part.shape[0], y : y + part.shape[1]] = part
    return out


def scattered_pattern(shape: tuple[int, int], rows: list[int], cols: list[int], block: np.ndarray) -> np.ndarray:
    """The block repeated at every (row, column) of a lattice."""
    out = np.zeros(shape)
    for y in rows:
        for x in cols:
            part = out[y : y + block.shape[0], x : x + block.shape[1]]
            part[:] = block[: part.shape[0], : part.shape[1]]
    return out


def random_points(spark: SparkSession, share: float, shape: tuple[int, int], seed: int = 1) -> DataFrame:
    """(feature): about share of the field, drawn with replacement."""
    n = int(shape[0] * shape[1] * share)
    at = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string"))), 1, 12), 16, 10).cast("bigint") % (shape[0] * shape[1])
    return spark.range(n).select(at.cast("int").alias("feature")).distinct()


def trials(spark: SparkSession, subjects: int, observations: int, pattern: DataFrame, slope: float, slope_noise: bool = False, continuous: bool = False, items: float = 0.0, subject_noise: float = 0.0, field_noise: float = 1.0, seed: int = 1, mod_cont: bool = True, over: DataFrame | None = None) -> DataFrame:
    """(row_id, subj, item, beh, cont, y): a balanced -0.5/0.5 condition, y an array over pattern (feature, signal).

    An odd number of observations is rounded down. Each item belongs to one condition. Subjects and items
    shift the intercepts (items and subject_noise scale them); with ``slope_noise`` subjects shift slopes
    too, and then the slope of beh x cont is slope squared, else slope. mod_cont: False leaves cont out of the table, though with
    ``continuous`` it shapes the values. over: rows (id, subj, item) of a given design instead of ``subjects`` times ``observations``.
    """
    n = observations // 2 * 2
    made = spark.range(subjects * n).select("id", (F.col("id") / n).cast("int").alias("subj"), (F.col("id") % n).cast("int").alias("item"))
    rows = made if over is None else over.select("id", "subj", "item")
    rows = rows.withColumn("beh", F.when(F.col("item") % 2 == 0, -0.5).otherwise(0.5)).withColumn("cont", normal(seed, F.lit("cont"), "id"))

    def noise(kind, key, scale, k):
        return normal(seed, F.lit(f"{kind}{k}"), key) * scale

    intercept = [noise("s", "subj", subject_noise, k) + noise("i", "item", items, k) for k in (0, 2, 4)]
    shift = [noise("s", "subj", subject_noise, k) if slope_noise else F.lit(0.0) for k in (1, 3, 5)]
    signal = F.col("beh") * (slope + shift[0]) + intercept[0]
    if continuous:
        both = slope * slope if slope_noise else slope
        signal = signal + F.col("cont") * (slope + shift[1]) + intercept[1] + F.col("beh") * F.col("cont") * (both + shift[2]) + intercept[2]
    rows = rows.withColumn("signal_size", signal)
    fields = F.array_sort(F.collect_list(F.struct("feature", "signal")))
    rows = rows.crossJoin(F.broadcast(pattern.agg(fields.alias("f"))))
    y = F.transform("f", lambda v: v["signal"] * F.col("signal_size") + normal(seed, F.lit("y"), "id", v["feature"]) * field_noise)
    return rows.select(F.col("id").alias("row_id"), "subj", "item", "beh", *(["cont"] if mod_cont else []), y.alias("y"))


def planted(frame: DataFrame, pattern: DataFrame, slope: float, condition: str = "beh") -> DataFrame:
    """Given trials (y, an array over features) with slope * condition * signal added to each cell of ``pattern`` (feature, signal)."""
    fields = F.array_sort(F.collect_list(F.struct("feature", "signal")))
    rows = frame.crossJoin(F.broadcast(pattern.agg(F.transform(fields, lambda v: v["signal"]).alias("_f"))))
    return rows.withColumn("y", F.zip_with("y", "_f", lambda v, s: v + s * slope * F.col(condition))).drop("_f")


def field_summary(frame: DataFrame, pattern: DataFrame) -> DataFrame:
    """(ave, sigma, high, low) over cells where the pattern has signal; population deviation."""
    on = pattern.filter("signal <> 0").select("feature")
    x = frame.select(F.posexplode("y").alias("feature", "x")).join(F.broadcast(on), "feature", "left_semi")
    return x.agg(F.avg("x").alias("ave"), F.stddev_pop("x").alias("sigma"), F.max("x").alias("high"), F.min("x").alias("low"))


#: Patterns that are placed at x, y.
PLACED = {
    "small": """
0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0
0 0 0 1 1 0 0 1 1 0 0 1 0 0 0 1
0 0 0 1 1 0 0 1 1 0 0 1 1 0 0 1
0 0 0 0 1 0 0 0 0 0 0 0 0 0 0 0
0 1 1 0 0 0 0 0 0 0 0 0 0 0 0 0
0 1 1 0 0 1 1 0 0 0 0 0 0 0 0 0
0 1 1 0 1 1 1 0 0 0 0 0 0 0 0 0
0 0 0 0 1 1 0 0 0 0 0 0 0 0 0 0
0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0
0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0
0 0 0 0 0 0 0 0 0 0 0 0 0 -1 0 0
0 0 0 0 0 0 0 0 0 0 0 0 -1 -1 -1 0
-1 0 0 -1 -1 0 0 -1 -1 0 0 -1 -1 -1 -1 -1
-1 0 0 0 -1 0 0 -1 -1 0 0 0 -1 -1 -1 0
0 0 0 0 0 0 0 0 0 0 0 0 0 -1 0 0
""",
    "vbig": """
1 1 1 1 1 1 0 0 0 0 0 1 1 1 1 0
1 1 1 1 1 1 0 0 0 0 0 1 1 1 1 0
1 1 1 1 1 1 0 0 0 0 0 1 1 1 1 0
1 1 1 1 1 1 0 0 0 0 0 1 1 1 1 0
1 1 1 1 1 1 0 0 0 0 0 1 1 1 1 0
1 1 1 1 1 1 0 0 0 0 0 0 0 0 0 0
0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0
0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0
0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0
0 0 0 0 0 0 0 0 0 0 -1 -1 -1 -1 -1 -1
0 -1 -1 -1 -1 0 0 0 0 0 -1 -1 -1 -1 -1 -1
0 -1 -1 -1 -1 0 0 0 0 0 -1 -1 -1 -1 -1 -1
0 -1 -1 -1 -1 0 0 0 0 0 -1 -1 -1 -1 -1 -1
0 -1 -1 -1 -1 0 0 0 0 0 -1 -1 -1 -1 -1 -1
0 -1 -1 -1 -1 0 0 0 0 0 -1 -1 -1 -1 -1 -1
""",
    "ten": """
0 1 1 0
0 1 1 1
0 1 1 1
0 1 1 0
""",
    "hundo": """
0 1 1 1 1 1 0 0 0 0 0 1 1 1 1 0
0 1 1 1 1 1 0 0 0 0 0 1 1 1 1 0
0 1 1 1 1 1 0 0 0 0 0 1 1 1 1 0
0 1 1 1 1 1 0 0 0 0 0 1 1 1 1 0
0 1 1 1 1 1 0 0 0 0 0 1 1 1 1 0
0 1 1 1 1 1 0 0 0 0 0 0 0 0 0 0
0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0
0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0
0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0
0 0 0 0 0 0 0 0 0 0 -1 -1 -1 -1 -1 0
0 -1 -1 -1 -1 0 0 0 0 0 -1 -1 -1 -1 -1 0
0 -1 -1 -1 -1 0 0 0 0 0 -1 -1 -1 -1 -1 0
0 -1 -1 -1 -1 0 0 0 0 0 -1 -1 -1 -1 -1 0
0 -1 -1 -1 -1 0 0 0 0 0 -1 -1 -1 -1 -1 0
0 -1 -1 -1 -1 0 0 0 0 0 -1 -1 -1 -1 -1 0
""",
    "big": """
0 0 1 0 0 0 0 0 0 0 0 0 0 0 0 0
0 1 1 1 0 0 0 0 0 0 0 0 1 1 0 0
1 1 1 1 1 0 0 0 0 0 0 0 1 1 0 0
0 1 1 1 0 0 0 0 0 0 0 0 0 0 0 0
0 0 1 0 0 0 0 0 0 0 0 0 0 0 0 0
0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0
0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0
0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0
0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0
0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0
0 0 0 0 0 0 0 0 0 0 0 0 0 -1 0 0
0 0 0 0 0 0 0 0 0 0 0 0 -1 -1 -1 0
0 0 -1 -1 0 0 0 0 0 0 0 -1 -1 -1 -1 -1
0 0 -1 -1 0 0 0 0 0 0 0 0 -1 -1 -1 0
0 0 0 0 0 0 0 0 0 0 0 0 0 -1 0 0
""",
}
#: Rows, columns and block size of the patterns that have their own place (rows are y, columns x; in a central one x is the row).
CENTRAL = {"central01": (49, 47, 5, 2), "central": (45, 45, 10, 10), "central10": (37, 30, 25, 40)}
LATTICE = {
    "split01": ([47], [40, 60], 5, 1), "split": ([40, 60], [40, 60], 5, 5), "split10": ([30, 60], [15, 60], 10, 25),
    "dispersed01": ([10, 30, 50, 70, 90], [40, 60], 1, 1), "dispersed": ([10, 30, 50, 70, 90], [10, 30, 50, 70, 90], 2, 2), "dispersed10": ([6, 26, 46, 66, 86], [6, 26, 46, 66, 86], 5, 8),
}


def graded_pattern(steps: int = 6, block: tuple[int, int] = (3, 2), gap: int = 2) -> np.ndarray:
    """Blocks side by side: their strength rises from 1 / steps to 1, and below them falls to -1."""
    strength = np.arange(1, steps + 1) / steps
    tile = np.zeros((block[0] + gap, block[1] + gap))
    tile[: block[0], : block[1]] = 1
    return np.kron(np.array([strength, -strength]), tile)


def named_pattern(name: str = "big", shape: tuple[int, int] = (100, 100), x: int = 0, y: int = 0) -> np.ndarray:
    """A field with a named pattern; an unknown name means big. ``final`` is this library's own :func:`graded_pattern`."""
    if name in CENTRAL:
        r, c, h, w = CENTRAL[name]
        return block_pattern(shape, r, c, np.ones((h, w)))
    if name in LATTICE:
        rows, cols, h, w = LATTICE[name]
        return scattered_pattern(shape, rows, cols, np.ones((h, w)))
    if name == "final":
        return block_pattern(shape, x, y, graded_pattern())
    block = np.array([line.split() for line in PLACED.get(name, PLACED["big"]).split("\n") if line], float)
    return block_pattern(shape, x, y, block)
