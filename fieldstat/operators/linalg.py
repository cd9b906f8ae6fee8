"""Blocked products and the decomposition of tall, wide matrices through a small Gram matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components with less of the variance than this are numerically nothing.
LEAST_SHARE = 1e-12


def summed(parts: DataFrame, key: str, value: str, fan: int = 64) -> DataFrame:
    """(key, value): arrays of equal length added up by key; parts of a key meet by ``fan``s first, so no task gets those of all tasks."""

    def add(by: list[str]):
        def run(t: pa.Table) -> pa.Table:
            m = t.column(value).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).sum(0)
            return pa.table({**{k: t.column(k).slice(0, 1) for k in by}, value: pa.array([m.tolist()], pa.list_(pa.float64()))})

        return run

    kind = dict(parts.dtypes)[key]
    dealt = parts.withColumn("_fan", F.spark_partition_id() % fan)
    dealt = dealt.groupBy(key, "_fan").applyInArrow(add([key, "_fan"]), f"{key} {kind}, _fan int, {value} array<double>")
    return dealt.groupBy(key).applyInArrow(add([key]), f"{key} {kind}, {value} array<double>")


def _gram_rows(long: DataFrame, names: list, row: str, col: str, value: str) -> DataFrame:
    """(i, g): rows of the Gram matrix of ``names``: each task adds up the products of its columns, and hands on one matrix."""
    n = len(names)
    at = long.sparkSession.createDataFrame([(x, i) for i, x in enumerate(names)], f"{row} {dict(long.dtypes)[row]}, _i int")
    packed = long.join(F.broadcast(at), row).groupBy(col).agg(F.collect_list("_i").alias("i"), F.collect_list(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).alias("v"))

    def run(batches):
        total = np.zeros((n, n))
        for b in batches:
            i, v = b.column(0), b.column(1)
            x = np.zeros((b.num_rows, n))
            np.add.at(x, (np.repeat(np.arange(b.num_rows), np.diff(i.offsets.to_numpy())), i.flatten().to_numpy()), v.flatten().to_numpy())
            total += x.T @ x
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "g"])

    return summed(packed.select("i", "v").mapInArrow(run, "i int, g array<double>"), "i", "g")


def gram(long: DataFrame, row: str, col: str, value: str, most_rows: int = 4000) -> DataFrame:
    """(a, b, g): products of every two rows summed over columns; rows are few (groups times terms), columns any number. A null value counts as 0."""
    names = [r[0] for r in long.select(row).distinct().orderBy(row).limit(most_rows + 1).collect()]
    if len(names) > most_rows:
        raise ValueError(f"more than {most_rows} rows; transpose the matrix, or take top_components")
    g = _gram_rows(long, names, row, col, value)
    at = F.broadcast(long.sparkSession.createDataFrame([(x, i) for i, x in enumerate(names)], f"a {dict(long.dtypes)[row]}, i int"))
    other = at.withColumnsRenamed({"a": "b", "i": "j"})
    return g.join(at, "i").select("a", F.posexplode("g").alias("j", "g")).join(other, "j").select("a", "b", "g")


def decompose(g: np.ndarray, least: float = LEAST_SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(U, s, share) from a Gram matrix, largest first, null components dropped."""
    w, u = np.linalg.eigh(g)
    w, u = np.maximum(w[::-1], 0), u[:, ::-1]
    share = w / w.sum() if w.sum() > 0 else w
    keep = share > least
    return u[:, keep], np.sqrt(w[keep]), share[keep]


def signed(v: np.ndarray) -> np.ndarray:
    """Rows with their largest entry (by size) positive; gives the signs to multiply with."""
    at = np.abs(v).argmax(1)
    return np.where(v[np.arange(len(v)), at] < 0, -1.0, 1.0)


def svd_components(long: DataFrame, row: str = "row", col: str = "feature", value: str = "x", most_rows: int = 4000) -> DataFrame:
    """(comp, s, share, feature, v): right singular vectors of the matrix of (row, col, value), signs fixed.

    The Gram matrix is summed where the columns are; only it (at most most_rows squared) is decomposed on the
    driver, and the vectors are computed back over the columns. Matrices of many rows: :func:`top_components`.
    """
    names = [r[0] for r in long.select(row).distinct().orderBy(row).limit(most_rows + 1).collect()]
    if len(names) > most_rows:
        raise ValueError(f"more than {most_rows} rows; transpose the matrix")
    at = {n: i for i, n in enumerate(names)}
    found = _gram_rows(long, names, row, col, value).orderBy("i").toArrow()
    g = found.column("g").combine_chunks().flatten().to_numpy().reshape(len(names), -1) if len(found) else np.zeros((len(names), len(names)))
    u, s, share = decompose(g)
    spark = long.sparkSession
    weights = spark.createDataFrame([(n, c, float(u[i, c] / s[c])) for n, i in at.items() for c in range(len(s))], f"{row} {dict(long.dtypes)[row]}, comp int, w double")
    sizes = spark.createDataFrame([(c, float(s[c]), float(share[c])) for c in range(len(s))], "comp int, s double, share double")
    v = long.join(weights, row).groupBy("comp", col).agg(F.sum(F.col("w") * F.col(value)).alias("v"))
    sign = v.groupBy("comp").agg(F.signum(F.max_by("v", F.abs("v"))).alias("sign"))
    return v.join(F.broadcast(sign), "comp").join(F.broadcast(sizes), "comp").select("comp", "s", "share", F.col(col).alias("feature"), (F.col("v") * F.col("sign")).alias("v"))


#: Bytes of the vectors that are iterated on (columns x (components + spare)); they go to every task.
MOST_VECTORS = 256 << 20
#: Columns whose sums travel together.
STRIP = 1024


def top_components(rows: DataFrame, components: int, y: str = "y", spare: int = 10, rounds: int = 30, tol: float = 1e-12, seed: int = 1) -> DataFrame:
    """(comp, s, share, feature, v): the largest singular values of rows of any number, and their right singular vectors, signs fixed.

    rows: one array of equal length a row; null and NaN numbers count as 0. share: of the sum of all squares. Block iteration from a random
    start: with V of components + spare columns, one scan gives A'(AV), added up by strips of columns; its orthogonal factor is the next
    V, and V'A'AV has the values. Neither a row nor a product of two rows or columns leaves a task. It ends once the values stand still;
    where V has as many columns as the array, two scans are exact.
    """
    spark = rows.sparkSession
    n = rows.agg(F.max(F.size(y))).first()[0] or 0
    schema = "comp int, s double, share double, feature int, v double"
    if n <= 0:
        return spark.createDataFrame([], schema)
    k = min(components + spare, n)
    if n * k * 8 > MOST_VECTORS:
        raise ValueError(f"{n} columns by {k} vectors are more than {MOST_VECTORS} bytes")

    def scan(v):
        shared = spark.sparkContext.broadcast(v)

        def run(batches):
            v, total, squares = shared.value, np.zeros((n, k)), 0.0
            for b in batches:
                a = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)
                if len(a) != n * (b.num_rows - b.column(0).null_count):
                    raise ValueError("arrays of different lengths")
                a = np.nan_to_num(a.reshape(-1, n))
                total += a.T @ (a @ v)
                squares += float((a * a).sum())
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(0, n, STRIP)], pa.int32()), pa.array([[squares], *[total[i : i + STRIP].ravel().tolist() for i in range(0, n, STRIP)]], pa.list_(pa.float64()))], ["i", "m"])

        found = summed(rows.select(y).mapInArrow(run, "i int, m array<double>"), "i", "m").orderBy("i").toArrow().to_pydict()
        shared.unpersist()
        return np.concatenate([np.asarray(m) for m in found["m"][1:]]).reshape(n, k), found["m"][0][0]

    v = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((n, k)))[0]
    before = None
    for _ in range(max(rounds, 2)):
        z, squares = scan(v)
        w, u = np.linalg.eigh((lambda g: (g + g.T) / 2)(v.T @ z))
        w, vectors = np.maximum(w[::-1], 0), v @ u[:, ::-1]
        if before is not None and np.abs(w - before)[:components].max() <= tol * max(w[0], 1e-300):
            break
        before, v = w, np.linalg.qr(z)[0]
    keep = [c for c in range(min(components, k)) if w[c] > LEAST_SHARE * max(squares, 1e-300)]
    vectors = vectors[:, keep].T
    vectors = vectors * signed(vectors)[:, None] if keep else vectors
    comp = np.repeat(np.array(keep, np.int32), n)
    out = pa.table({"comp": comp, "s": np.sqrt(w)[comp], "share": (w / max(squares, 1e-300))[comp], "feature": np.tile(np.arange(n, dtype=np.int32), len(keep)), "v": vectors.ravel()})
    return spark.createDataFrame(out, schema) if keep else spark.createDataFrame([], schema)


def backproject(components: DataFrame, fits: DataFrame) -> DataFrame:
    """(term, feature, beta, t): component fits (comp, term, beta, t) spread over features; t weighted by s, beta not."""
    both = components.join(fits, "comp")
    return both.groupBy("term", "feature").agg(F.sum(F.col("beta") * F.col("v")).alias("beta"), F.sum(F.col("t") * F.col("s") * F.col("v")).alias("t"))


def term_summaries(components: DataFrame, fits: DataFrame) -> DataFrame:
    """(term, beta, t): component fits weighted by each component's share of the singular values."""
    s = components.select("comp", "s").distinct()
    total = s.agg(F.sum("s").alias("all"))
    both = fits.join(s, "comp").crossJoin(F.broadcast(total))
    w = F.col("s") / F.col("all")
    return both.groupBy("term").agg(F.sum(F.col("beta") * w).alias("beta"), F.sum(F.col("t") * w).alias("t"))


def residual_errors(rss: DataFrame, mm: float | Column, n: int, rank: int | Column = 1) -> DataFrame:
    """Adds sterr to rows with rss, the residuals' sum of squares: sqrt of m'm times sqrt of rss / (n - rank), m the term's column of n numbers."""
    mm = F.lit(mm) if isinstance(mm, (int, float)) else mm
    return rss.withColumn("sterr", F.sqrt(mm) * F.sqrt(F.col("rss") / (n - rank)))


def blockwise_product(left: DataFrame, right: np.ndarray, y: str = "y", block: int = 1 << 16) -> DataFrame:
    """Adds ``product`` = y times a small matrix (features by components), batch by batch."""
    names = [f.name for f in left.schema.fields]

    def run(batches):
        for b in batches:
            i = names.index(y)
            m = np.array(b.column(i).to_pylist(), float).reshape(b.num_rows, -1)
            if b.num_rows and m.shape[1] != right.shape[0]:
                raise ValueError("the matrices are not aligned")
            out = np.concatenate([m[j : j + block] @ right for j in range(0, len(m), block)]) if b.num_rows else np.zeros((0, right.shape[1]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out.tolist(), pa.list_(pa.float64()))], [*names, "product"])

    from pyspark.sql.types import ArrayType, DoubleType, StructType

    return left.mapInArrow(run, StructType(list(left.schema.fields)).add("product", ArrayType(DoubleType())))
