"""All permuted correlations in one scan: permuting the data of a group is permuting its design the other way."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def permuted_designs(frame: DataFrame, perms: DataFrame, terms: list[str]) -> DataFrame:
    """(row_id, a): for each source row the design values it meets, run after run, ``terms`` within a run."""
    design = frame.select("row_id", F.array(*[F.col(t).cast("double") for t in terms]).alias("d"))
    met = perms.select("run", "row_id", "src_row_id").join(design, "row_id")
    runs = F.array_sort(F.collect_list(F.struct("run", "d")))
    return met.groupBy(F.col("src_row_id").alias("row_id")).agg(F.flatten(F.transform(runs, lambda r: r["d"])).alias("a"))


#: Bytes of sums that a task keeps before it hands them on.
HELD = 64 << 20


def matrix(column: pa.Array, n: int) -> np.ndarray:
    """An Arrow column of ``n`` lists of equal length as rows; null numbers are NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(n, -1)


def cross_products(rows: DataFrame, left: str = "a", right: str = "y") -> DataFrame:
    """(grp, k, j, s) of rows (grp, left, right), both arrays: sums over rows of left[k] * right[j], with k or j = -1 for ones and k = -2 for squares.

    Each batch becomes one small matrix product for each group in it, added to that group's sum, which leaves the task at its end or
    when its sums take HELD bytes; those are added up by key: a group of any size is never gathered.
    """

    def out(held, kind):
        for g, (s, yy, aa) in held.items():
            p, q = len(aa), len(yy)
            k, j = np.meshgrid(np.arange(-1, p), np.arange(-1, q), indexing="ij")
            k, j = np.concatenate([k.ravel(), np.full(q, -2), np.arange(p)]), np.concatenate([j.ravel(), np.arange(q), np.full(p, -2)])
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(k), kind), pa.array(k, pa.int32()), pa.array(j, pa.int32()), pa.array(np.concatenate([s.ravel(), yy, aa]))], ["grp", "k", "j", "s"])

    def run(batches):
        held, size, kind = {}, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            grp, kind = b.column(0).dictionary_encode(), b.schema.field(0).type
            code, names = grp.indices.to_numpy(zero_copy_only=False), grp.dictionary.to_pylist()
            a, y = matrix(b.column(1), b.num_rows), matrix(b.column(2), b.num_rows)
            for i, g in enumerate(names):
                at = code == i
                x, z = np.c_[np.ones(at.sum()), a[at]], np.c_[np.ones(at.sum()), y[at]]
                new = [x.T @ z, (y[at] ** 2).sum(0), (a[at] ** 2).sum(0)]
                if g in held:
                    for s, m in zip(held[g], new):
                        s += m
                else:
                    held[g] = new
                    size += sum(m.nbytes for m in new)
            if size > HELD:
                yield from out(held, kind)
                held, size = {}, 0
        yield from out(held, kind)

    kind = dict(rows.dtypes)["grp"]
    return rows.select("grp", left, right).mapInArrow(run, f"grp {kind}, k int, j int, s double").groupBy("grp", "k", "j").agg(F.sum("s").alias("s"))


def permuted_correlations(frame: DataFrame, perms: DataFrame, terms: list[str], use_norm: bool = True, runs: list[int] | None = None) -> DataFrame:
    """(run, grp, term, feature, r), run 0 as observed; r null where a side does not vary. runs: those in ``perms``, if not 0, 1, ..."""
    rows = frame.select("row_id", "grp", "y").join(permuted_designs(frame, perms, terms), "row_id")
    s = cross_products(rows)
    n = s.filter("k = -1 and j = -1").select("grp", F.col("s").alias("n"))
    xs = s.filter("k = -1 and j >= 0").select("grp", "j", F.col("s").alias("sx")).join(s.filter("k = -2").select("grp", "j", F.col("s").alias("sxx")), ["grp", "j"])
    as_ = s.filter("k >= 0 and j = -1").select("grp", "k", F.col("s").alias("sa")).join(s.filter("j = -2").select("grp", "k", F.col("s").alias("saa")), ["grp", "k"])
    both = s.filter("k >= 0 and j >= 0").join(n, "grp").join(xs, ["grp", "j"]).join(as_, ["grp", "k"])
    vx, va = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("saa") - F.col("sa") * F.col("sa") / F.col("n")
    cov = F.col("s") - F.col("sx") * F.col("sa") / F.col("n")
    least = 1e-12 * F.greatest(F.col("sxx"), F.lit(1e-300))
    r = cov / F.sqrt(vx * va) if use_norm else cov / F.sqrt(va)
    t = len(terms)
    name = F.element_at(F.array(*[F.lit(x) for x in terms]), (F.col("k") % t + 1).cast("int"))
    place = F.floor(F.col("k") / t).cast("int")
    run = place if runs is None else F.element_at(F.array(*[F.lit(k) for k in sorted(runs)]), place + 1)
    return both.select(run.alias("run"), "grp", name.alias("term"), F.col("j").alias("feature"), F.when((F.col("n") > 1) & (vx > least) & (va > 1e-12), r).alias("r"))


def permutation_test(rows: DataFrame, side: str, runs: int, seed: int = 1) -> DataFrame:
    """(run, feature, t, df, z): pooled two-sample t and its one-sided normal deviate, run 0 as observed.

    rows: row_id, y and ``side``, 1 for the first sample and 0 for the second; runs deal rows to the samples
    anew. One scan serves all runs: with an indicator as design, the sums give both samples' means and spread.
    """
    from .frames import one_sided_z
    from .resample import permutations

    whole = rows.withColumn("grp", F.lit(0))
    design = permuted_designs(whole, permutations(whole, runs, seed), [side])
    s = cross_products(whole.select("row_id", "grp", "y").join(design, "row_id"))
    one = lambda cond, *names: s.filter(cond).select(*names)
    n = one("k = -1 and j = -1", F.col("s").alias("n"))
    x = one("k = -1 and j >= 0", "j", F.col("s").alias("sx")).join(one("k = -2", "j", F.col("s").alias("sxx")), "j")
    a = one("k >= 0 and j = -1", "k", F.col("s").alias("na"))
    both = one("k >= 0 and j >= 0", "k", "j", "s").join(x, "j").join(a, "k").crossJoin(F.broadcast(n)).withColumn("nb", F.col("n") - F.col("na"))
    rest = F.col("sx") - F.col("s")
    within = F.col("sxx") - F.col("s") * F.col("s") / F.col("na") - rest * rest / F.col("nb")
    t = (F.col("s") / F.col("na") - rest / F.col("nb")) / F.sqrt(within / (F.col("n") - 2) * (1 / F.col("na") + 1 / F.col("nb")))
    out = both.select(F.col("k").alias("run"), F.col("j").alias("feature"), F.when(within > 0, t).alias("t"), (F.col("n") - 2).cast("int").alias("df"))
    return out.withColumn("z", one_sided_z(F.col("t"), F.col("df")))
