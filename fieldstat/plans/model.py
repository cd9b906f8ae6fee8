"""The whole analysis: correlate, stabilise, decompose, fit mixed models on components, spread back, correct.

The runs of a part share two kinds of scans. The first sums cross products of every run's permuted design with the features; the
second sums each component's cross products by level of the random terms, with a window of the loadings in each task (LOADINGS bytes; a
part whose loadings are larger takes several such scans). Between and after them only arrays of one run (subjects x terms x features) are
in one place. Parts of runs are kept, and added to by later calls; with a ledger they are written, and a killed call resumes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formula import INTERCEPT, Formula, design, parse
from ..functions.levels import Structure
from ..functions.lmm import fit_one_factor
from ..operators import inference, linalg, resample
from ..operators.clusters import Graph, enhance, exact_enhancement, stepped_enhancement
from ..operators.permuted import HELD, matrix, permuted_correlations
from ..sources.ledger import RunLedger

#: Loadings sent to the tasks at once, in bytes; more runs are fitted in several passes.
LOADINGS = 64 << 20
#: Bytes of all correlations, as an array of doubles, up to which they are broadcast to the tasks of bootstrap runs.
GATHERED = 256 << 20
#: Tasks that the runs of a part are dealt to.
MOST_TASKS = 64
#: Levels of a random term's grouping column beside the subjects.
MOST_LEVELS = 8_000
#: A run's maps, by term and feature; feature -1: what the term's component fits add up to; feature -2: the sum of the singular values.
PART = "run int, outer_id int, inner_id int, term string, feature int, beta double, t double, mask boolean, rss double"


def t_two_sided(t: np.ndarray, df: int) -> np.ndarray:
    """Two-tailed p of Student's t for whole degrees of freedom, by the finite series."""
    th = np.arctan(np.abs(t) / math.sqrt(df))
    c2, term, total = np.cos(th) ** 2, np.ones_like(th), np.ones_like(th)
    for k in range(1, (df - 3) // 2 + 1 if df % 2 else (df - 2) // 2 + 1):
        term = term * c2 * (2 * k / (2 * k + 1) if df % 2 else (2 * k - 1) / (2 * k))
        total = total + term
    if df % 2:
        inside = 2 / math.pi * (th + (np.sin(th) * np.cos(th) * total if df > 1 else 0))
    else:
        inside = np.sin(th) * total
    return np.clip(1 - inside, 0, 1)


class FieldModel:
    """Mass-univariate mixed-effects analysis of trials nested in subjects.

    frame: row_id, grp, y (array of features) and the predictors. formula: fixed effects and random terms, such as
    ``val ~ beh + (beh|subj)`` or ``val ~ beh + (1|subj) + (1|item)``. The group of the first random term is grp, whatever its name; terms of
    another group read that column of frame (a null counts as a level of its own), and may cross the subjects. Options: svd_terms (columns of
    the design to correlate; all but the intercept), use_ranks, use_norm, z_transform, feat_thresh,
    feat_nboot, tfce (with shape or edges, E, H, and dt for the stepped kind used with edges), tfce_svd,
    double_z (take Fisher's z twice in bootstraps, as older analyses did), mask (features to keep).

    Runs are added to those of earlier calls. What a permutation is depends on its number and the seed alone, so 60 and 40 more are the same
    as 100, and so are bootstraps that are balanced in blocks. ledger: a folder that all executors share; parts of ``batch`` runs are committed there one by one, a model made anew with
    the same data and options goes on with them, and ``resume`` computes what an interrupted call left out.
    """

    def __init__(self, frame: DataFrame, formula: str, *, factors=None, svd_terms=None, use_ranks=False, use_norm=True, z_transform=True, feat_thresh=0.05, feat_nboot=1000, tfce=False, tfce_svd=False, shape=None, edges=None, dt=0.01, E=2 / 3, H=2.0, double_z=False, mask=None, resid_formula=None, seed=1, ledger=None, batch=50):  # noqa: N803
        self.formula: Formula = parse(formula)
        if not self.formula.random:
            raise ValueError("the model needs a random term")
        self.spark, self.options = frame.sparkSession, dict(feat_thresh=feat_thresh, feat_nboot=feat_nboot, z_transform=z_transform, tfce=tfce, tfce_svd=tfce_svd, dt=dt, E=E, H=H, seed=seed, double_z=double_z)
        self.use_norm, self.shape, self.batch = use_norm, shape, batch
        fixed = design(frame, self.formula.fixed, factors)
        random = [design(frame, list(r.terms), factors) for r in self.formula.random]
        self.x_names, self.z_names = list(fixed), [list(z) for z in random]
        cols = {f"x{i}": c for i, c in enumerate(fixed.values())} | {f"z{k}_{i}": c for k, z in enumerate(random) for i, c in enumerate(z.values())}
        self.terms = svd_terms or [n for n in self.x_names if n != INTERCEPT]
        # grouping columns beside the subjects, as numbers of their sorted levels; of each random term 0 for the subjects, else its place here and 1
        self.others = list(dict.fromkeys(r.group for r in self.formula.random if r.group != self.formula.random[0].group))
        self.grouping = [0 if r.group not in self.others else 1 + self.others.index(r.group) for r in self.formula.random]
        self.levels = []
        for i, name in enumerate(self.others):
            level = F.coalesce(F.col(name).cast("string"), F.lit(""))
            self.levels.append([r[0] for r in frame.select(level.alias("l")).distinct().orderBy("l").limit(MOST_LEVELS + 1).collect()])
            if len(self.levels[-1]) > MOST_LEVELS:
                raise ValueError(f"{name} has more than {MOST_LEVELS} levels")
            cols[f"c{i}"] = (F.array_position(F.array(*[F.lit(x) for x in self.levels[-1]]), level) - 1).cast("double")
        y = F.col("y")
        if mask is not None:
            keep = F.array(*[F.lit(int(i)) for i in np.nonzero(np.ravel(mask))[0]])
            self.kept = np.nonzero(np.ravel(mask))[0]
            y = F.transform(keep, lambda i: F.get(F.col("y"), i))
        data = frame.select("row_id", "grp", y.alias("y"), *[c.alias(k) for k, c in cols.items()])
        if resid_formula is not None:
            data = self._residuals(data, design(frame, parse(resid_formula).fixed, factors), frame)
        if use_ranks:
            data = self._ranked(data, [c for c in cols if not c.startswith("c")])
        self.data = data.persist()
        self.features = self.data.select(F.size("y")).first()[0]
        if mask is None:
            self.kept = np.arange(self.features)
        self.groups = [r[0] for r in self.data.select("grp").distinct().orderBy("grp").collect()]
        self.graph = Graph.of(edges, int(np.prod(shape)) if shape else self.features) if edges is not None else Graph.grid(tuple(shape)) if shape else None
        if tfce and self.graph is None:
            raise ValueError("enhancement needs a shape or edges")
        self.stepped = edges is not None
        self.total: float | None = None
        self.inner: int | None = None
        self.balance: int | None = None
        self._resampled, self._asked, self._seed, self._parts = None, 0, None, []
        self._model = dict(formula=formula, options=self.options, terms=self.terms, groups=self.groups, features=self.features, kept=len(self.kept), levels=self.levels, ranks=use_ranks, norm=use_norm, resid=resid_formula)
        self._folder, self.ledger = ledger, None

    # -- preparation

    @staticmethod
    def _ranked(data: DataFrame, cols: list[str]) -> DataFrame:
        """Predictors and features as ranks within the group, scaled to 0..1."""
        from ..functions.columns import average_rank

        n = F.count("*").over(_by("grp"))
        varying = [c for c in cols]
        out = data.select("row_id", "grp", "y", *[F.when(F.min(c).over(_by("grp")) == F.max(c).over(_by("grp")), F.col(c)).otherwise((average_rank(c, ["grp"]) - 1) / (n - 1)).alias(c) for c in varying])
        cell = data.select("row_id", "grp", F.posexplode("y").alias("f", "v"))
        cell = cell.withColumn("r", (average_rank("v", ["grp", "f"]) - 1) / (F.count("*").over(_by("grp", "f")) - 1))
        y = cell.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "r"))), lambda s: s["r"]).alias("y"))
        codes = [c for c in data.columns if c not in ("row_id", "grp", "y", *cols)]
        out = out.join(data.select("row_id", *codes), "row_id") if codes else out
        return out.drop("y").join(y, "row_id").select("row_id", "grp", "y", *cols, *codes)

    @staticmethod
    def _residuals(data: DataFrame, columns: dict, frame: DataFrame) -> DataFrame:
        """Features less what the residual formula explains, by one set of cross products over all rows."""
        from ..operators.permuted import cross_products

        x = frame.select("row_id", F.array(*columns.values()).alias("a"))
        rows = data.join(x, "row_id")
        s = cross_products(rows.withColumn("grp", F.lit(0))).filter("k >= 0 and j >= 0").collect()
        xx = np.zeros((len(columns),) * 2)
        for r in cross_products(rows.select(F.lit(0).alias("grp"), "a", F.col("a").alias("y"))).filter("k >= 0 and j >= 0").collect():
            xx[r["k"], r["j"]] = r["s"]
        xy = np.zeros((len(columns), 1 + max(r["j"] for r in s)))
        for r in s:
            xy[r["k"], r["j"]] = r["s"]
        b = np.linalg.lstsq(xx, xy, rcond=None)[0].T.tolist()
        coef = data.sparkSession.createDataFrame([(b,)], "b array<array<double>>")
        fitted = F.transform("b", lambda c: F.aggregate(F.zip_with(c, F.col("a"), lambda p, q: p * q), F.lit(0.0), lambda u, v: u + v))
        out = rows.crossJoin(F.broadcast(coef)).withColumn("y", F.zip_with("y", fitted, lambda u, v: u - v))
        return out.select(*data.columns)

    # -- runs

    def observed(self) -> FieldModel:
        return self.run_perms(0)

    def run_perms(self, n: int | DataFrame, seed: int = 1) -> FieldModel:
        """n more permutations within subjects, or a table (run, grp, row_id, src_row_id) of runs not yet done; run 0 is as observed."""
        self._only("perms", seed, None)
        if isinstance(n, int):
            self._ask(n)
            return self.resume()
        runs = sorted(r[0] for r in n.select("run").distinct().collect())
        if self.total is None and runs[:1] != [0]:
            raise ValueError("the first table needs run 0, as observed")
        for i in range(0, len(runs), self.batch):
            part = runs[i : i + self.batch]
            self._asked = max(self._asked, part[-1] + 1)
            if self.ledger:
                self.ledger.ask(part[0], part[-1], part[-1] - part[0] + 1)
            self._commit(part[0], part[-1], lambda part=part: self._permuted(part, n.filter(F.col("run").isin(part))))
        return self

    def run_boots(self, n: int, inner: int | None = None, seed: int = 1, balance: int | None = None) -> FieldModel:
        """n more bootstraps over subjects, each (and the observed run) with ``inner`` replicates for its error.

        More replicates than subjects are bootstraps of the run's subjects, fewer leave parts of them out; with none
        the errors come from the residuals. inner: that of the first call, as many as subjects if it doesn't say. Every subject is drawn as
        often as there are runs in the call, or with ``balance`` in every block of so many runs, whatever the calls.
        """
        inner = (len(self.groups) if self.inner is None else self.inner) if inner is None else inner
        if inner < 0 or self.inner not in (None, inner):
            raise ValueError("the number of inner replicates is set by the first call, and not negative")
        balance = self.balance if balance is None else balance
        if self._resampled and balance != self.balance:
            raise ValueError("the balance of bootstraps is set by the first call")
        self.balance = balance
        self._only("boots", seed, inner)
        self._ask(n)
        return self.resume()

    def _only(self, kind: str, seed: int, inner: int | None) -> None:
        if self._resampled not in (None, kind):
            raise ValueError("permutations and bootstraps can't be mixed")
        if self._seed not in (None, seed):
            raise ValueError("more runs need the seed of those before")
        if self._resampled is None:
            self._resampled, self._seed, self.inner = kind, seed, inner
            if self._folder:
                self.ledger = RunLedger(self.spark, f"{self._folder}/{kind}", self._model | {"seed_runs": seed, "inner": inner, "balance": self.balance})
                self._asked = self.ledger.next()
                self._found()

    def _ask(self, n: int) -> None:
        """The next n runs; the observed one comes with the first."""
        first, self._asked = self._asked, max(self._asked, 1) + n
        if first < self._asked:
            if self.ledger:
                self.ledger.ask(first, self._asked - 1, self.batch)
            self._open = [(a, min(a + self.batch, self._asked) - 1, first, self._asked - 1) for a in range(first, self._asked, self.batch)]
        else:
            self._open = []

    def resume(self) -> FieldModel:
        """Compute the parts that were asked for and are not committed."""
        for first, last, *call in self.ledger.missing() if self.ledger else self._open:
            runs = list(range(first, last + 1))
            self._commit(first, last, lambda runs=runs, call=call: self._permuted(runs, resample.permutations(self.data, runs, self._seed)) if self._resampled == "perms" else self._booted(runs, *call))
        self._open = []
        return self

    def _commit(self, first: int, last: int, compute) -> None:
        if not self.ledger:
            self._parts.append(compute().persist())
        elif (first, last) not in self.ledger.committed():
            self.ledger.write(compute(), first, last)
        self._found()

    def _found(self) -> None:
        if self.total is None:
            r = self.parts().filter("run = 0 AND feature = -2").select("beta").first()
            self.total = r[0] if r else None

    def parts(self) -> DataFrame:
        """All runs so far, as in PART."""
        if self.ledger:
            return self.ledger.read(PART)
        if not self._parts:
            return self.spark.createDataFrame([], PART)
        out = self._parts[0]
        for p in self._parts[1:]:
            out = out.union(p)
        return out

    @property
    def maps(self) -> DataFrame:
        """(run, outer_id, inner_id, term, feature, beta, t, mask, rss) of every run."""
        return self.parts().filter("feature >= 0")

    @property
    def summaries(self) -> DataFrame:
        """(run, term, beta, t): component fits weighted by each component's share."""
        return self.parts().filter("feature = -1").select("run", "term", "beta", "t")

    def _permuted(self, runs: list[int], perms: DataFrame) -> DataFrame:
        r = permuted_correlations(self.data, perms, [f"x{self.x_names.index(t)}" for t in self.terms], self.use_norm, runs)
        return self._fit(r, perms, None)

    def _booted(self, outer: list[int], first: int, last: int) -> DataFrame:
        """Bootstraps by the numbers of the outer runs, of a call that asked for ``first`` to ``last``."""
        g, inner, plan = len(self.groups), self.inner, []
        drawn = resample.balanced_slots(g, max(first, 1), last, self._seed, self.balance)
        for o in outer:
            slots = np.arange(g) if o == 0 else drawn[o]
            rng = np.random.Generator(np.random.PCG64([self._seed, o, 1]))
            plan.append((o * (inner + 1), o, 0, slots))
            for k in range(inner):
                if inner > g:
                    pick = slots[rng.integers(0, g, g)]
                else:
                    pick = np.delete(slots, np.arange(k, g, inner)) if inner > 1 else slots
                plan.append((o * (inner + 1) + k + 1, o, k + 1, pick))
        perms = resample.permutations(self.data, 0, self._seed)
        r = permuted_correlations(self.data, perms, [f"x{self.x_names.index(t)}" for t in self.terms], self.use_norm)
        return self._fit(r, perms, plan)

    def _fit(self, r: DataFrame, perms: DataFrame, plan) -> DataFrame:
        o, groups, nf, terms = self.options, self.groups, self.features, [f"x{self.x_names.index(t)}" for t in self.terms]
        graph, kept, stepped = self.graph, self.kept, self.stepped
        slots = {p[0]: p[3] for p in plan} if plan else None
        # numbers instead of names from here on
        at = self.spark.createDataFrame([(g, i) for i, g in enumerate(groups)], f"grp {dict(self.data.dtypes)['grp']}, g int")
        r = r.join(F.broadcast(at), "grp").select("run", "g", (F.array_position(F.array(*[F.lit(t) for t in terms]), F.col("term")) - 1).cast("int").alias("k"), "feature", "r")

        def cube_of(g, k, feature, value) -> np.ndarray:
            cube = np.full((len(groups), len(terms), nf), np.nan)
            cube[np.asarray(g), np.asarray(k), np.asarray(feature)] = np.asarray(value, float)
            return cube

        def decomposed(run: int, cube: np.ndarray) -> pd.DataFrame:
            invalid = np.isnan(cube).any(0)  # of any subject
            z = np.nan_to_num(cube)
            if o["z_transform"]:
                z = np.arctanh(np.clip(z, -1 + 1e-15, 1 - 1e-15))
                if o["double_z"] and slots is not None and run:
                    z = np.arctanh(np.clip(z, -1 + 1e-15, 1 - 1e-15))
            shown = z
            if o["tfce"]:
                shown = np.zeros_like(z)
                for g in range(len(z)):
                    for t in range(z.shape[1]):
                        whole = np.zeros(graph.n)
                        whole[kept] = z[g, t]
                        if stepped:
                            y = stepped_enhancement(whole, graph, o["dt"], o["E"], o["H"], 1) + stepped_enhancement(whole, graph, o["dt"], o["E"], o["H"], -1)
                        else:
                            y = exact_enhancement(whole, graph, o["E"], o["H"])
                        shown[g, t] = y[kept]
            rng = np.random.Generator(np.random.PCG64([o["seed"], run]))
            n = len(z)
            w = rng.multinomial(n, np.full(n, 1 / n), o["feat_nboot"]) / n
            se = np.tensordot(w, shown, (1, 0)).std(0)
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(se > 0, t_two_sided(shown.mean(0) / se, max(n - 1, 1)), 1.0)
            stable = (p < o["feat_thresh"]) & ~invalid
            m = np.where(stable, shown if o["tfce_svd"] else z, 0.0).reshape(-1, nf)
            gram = m @ m.T
            val, u = np.linalg.eigh(gram)
            val, u = np.maximum(val[::-1], 0), u[:, ::-1]
            keep = val > 1e-12 * max(val.sum(), 1e-300)
            s = np.sqrt(val[keep])
            v = (m.T @ u[:, keep] / np.where(s > 0, s, 1)).T
            v *= np.where(v[np.arange(len(v)), np.abs(v).argmax(1)] < 0, -1.0, 1.0)[:, None] if len(v) else 1.0
            return pd.DataFrame({"run": run, "comp": np.arange(len(s)), "s": s, "v": v.tolist(), "mask": [stable.any(0).tolist()] * len(s)})

        schema = "run int, comp int, s double, v array<double>, mask array<boolean>"
        order = [p[0] for p in plan] if plan else sorted(row[0] for row in perms.select("run").distinct().collect())
        tasks = min(len(order), MOST_TASKS)  # stated, as work isn't in proportion to bytes
        if slots is None:

            def one(key, pdf):
                return decomposed(int(key[0]), cube_of(pdf["g"], pdf["k"], pdf["feature"], pdf["r"]))

            comps = r.repartition(tasks, "run").groupBy("run").applyInPandas(one, schema)
        else:
            runs = self.spark.createDataFrame([(i // 16, [p[0] for p in plan[i : i + 16]]) for i in range(0, len(plan), 16)], "part int, runs array<int>")
            if len(groups) * len(terms) * nf * 8 <= GATHERED:  # sent to each worker once, whatever the number of runs
                cells = r.toArrow()
                whole = self.spark.sparkContext.broadcast(cube_of(*[cells.column(c).to_numpy() for c in ("g", "k", "feature", "r")]))

                def some(key, pdf):
                    return pd.concat([decomposed(int(k), whole.value[slots[int(k)]]) for k in pdf["runs"].iloc[0]])

                comps = runs.repartition(tasks, "part").groupBy("part").applyInPandas(some, schema)
            else:  # every 16 runs get a copy, by a join on their number

                def some(key, pdf):
                    cube = cube_of(pdf["g"], pdf["k"], pdf["feature"], pdf["r"])
                    return pd.concat([decomposed(int(k), cube[slots[int(k)]]) for k in pdf["runs"].iloc[0]])

                comps = r.crossJoin(F.broadcast(runs)).groupBy("part").applyInPandas(some, schema)
        comps = comps.persist()
        total = self.total
        if total is None:
            total = comps.filter("run = 0").agg(F.sum("s")).first()[0] or 0.0
        by_run = max(1, LOADINGS // max(1, nf * 8 * len(groups) * len(terms)))
        maps = None
        for i in range(0, len(order), by_run):
            now = order[i : i + by_run]
            part = self._maps(comps.filter(F.col("run").isin(now)), perms, plan, total, now)
            maps = part if maps is None else maps.union(part)
        ids = self.spark.createDataFrame([(p[0], p[1], p[2]) for p in plan] if plan else [(k, k, 0) for k in order], "run int, outer_id int, inner_id int")
        out = maps.join(F.broadcast(ids), "run").select(*[c.split(" ")[0] for c in PART.split(", ")])
        if self.total is None:
            out = out.union(self.spark.createDataFrame([(0, 0, 0, None, -2, float(total), None, None, None)], PART))
        return out

    def _maps(self, comps: DataFrame, perms: DataFrame, plan, total: float, order: list[int]) -> DataFrame:
        """Second scan: cross products of each component by cell (levels that occur together), then fits, then maps."""
        rows = comps.select("run", "comp", "s", "v", "mask").orderBy("run", "comp").toArrow()
        nf, x_names, groups = self.features, self.x_names, self.groups
        v = matrix(rows.column("v").combine_chunks(), len(rows)).reshape(-1, nf) if len(rows) else np.zeros((0, nf))
        s_all, masks = rows.column("s").to_numpy(), rows.column("mask").combine_chunks()
        masks = masks.flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(-1, nf) if len(rows) else np.zeros((0, nf), bool)
        of = rows.column("run").to_numpy()
        cuts = np.searchsorted(of, [*order, order[-1] + 1]) if len(order) == 1 else np.array([*np.searchsorted(of, order), len(of)])
        widths, p, grouping = [len(z) for z in self.z_names], len(x_names), self.grouping
        cols = [*[f"z{k}_{i}" for k, q in enumerate(widths) for i in range(q)], *[f"x{i}" for i in range(p)]]
        codes = [f"c{i}" for i in range(len(self.others))]
        w, q, nc = len(cols), sum(widths), len(codes)
        cross = bool(plan) and self.inner == 0  # residuals need the components' products with each other
        # the design rows each source row meets, run after run; bootstraps keep their own
        design_rows = self.data.select("row_id", F.array(*[F.col(c) for c in [*cols, *codes]]).alias("d"))
        met = perms.filter(F.col("run").isin([0] if plan else order)).select("run", "row_id", "src_row_id").join(design_rows, "row_id")
        met = met.groupBy(F.col("src_row_id").alias("row_id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run", "d"))), lambda r: r["d"])).alias("a"))
        at = self.spark.createDataFrame([(g, i) for i, g in enumerate(groups)], f"grp {dict(self.data.dtypes)['grp']}, g int")
        data = self.data.select("row_id", "grp", "y").join(met, "row_id").join(F.broadcast(at), "grp").select("g", "y", "a")
        of_run = [0] * len(order) if plan else list(range(len(order)))
        shared = self.spark.sparkContext.broadcast((np.ascontiguousarray(v.T), cuts, of_run))

        def sums(batches):
            v, cuts, of_run = shared.value
            held, size = {}, 0

            def out():
                cells = [(i, *cell, *[float(n)], dd.ravel().tolist(), de.ravel().tolist(), ee.ravel().tolist()) for (i, *cell), (n, dd, de, ee) in held.items()]
                i, *rest = zip(*cells)
                cell, (n, dd, de, ee) = list(zip(*rest[: 1 + nc])), rest[1 + nc :]
                return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array([list(c) for c in cell], pa.list_(pa.int32())), pa.array(n), *[pa.array(x, pa.list_(pa.float64())) for x in (dd, de, ee)]], ["i", "cell", "n", "dd", "de", "ee"])

            for b in batches:
                if not b.num_rows:
                    continue
                g = b.column(0).to_numpy()
                dw = matrix(b.column(1), b.num_rows) @ v
                a = matrix(b.column(2), b.num_rows).reshape(b.num_rows, -1, w + nc)
                for i, k in enumerate(of_run):
                    d, e = a[:, k, :w], dw[:, cuts[i] : cuts[i + 1]]
                    cell, inverse = np.unique(np.c_[g, a[:, k, w:].astype(np.int64)], axis=0, return_inverse=True)
                    inverse = inverse.ravel()
                    row = np.argsort(inverse, kind="stable")
                    starts = np.searchsorted(inverse[row], np.arange(len(cell)))
                    d, e = d[row], e[row]
                    for c, (u, z) in enumerate(zip(starts, [*starts[1:], len(row)])):
                        x, y = d[u:z], e[u:z]
                        new = [z - u, x.T @ x, x.T @ y, y.T @ y if cross else (y * y).sum(0)]
                        key = (i, *cell[c].tolist())
                        if key in held:
                            held[key] = [p + q for p, q in zip(held[key], new)]
                        else:
                            held[key] = new
                            size += sum(m.nbytes for m in new[1:])
                if size > HELD:
                    yield out()
                    held, size = {}, 0
            if held:
                yield out()

        partial = data.mapInArrow(sums, "i int, cell array<int>, n double, dd array<double>, de array<double>, ee array<double>")
        slots = {pl[0]: pl[3] for pl in plan} if plan else None
        levels = [len(x) for x in self.levels]

        def fit(key, pdf):
            i = int(key[0])
            run, own = order[i], slice(cuts[i], cuts[i + 1])
            k, s, vv = cuts[i + 1] - cuts[i], s_all[own], v[own]
            stack: dict = {}
            for cell, n, *rest in zip(pdf["cell"], pdf["n"], pdf["dd"], pdf["de"], pdf["ee"]):
                new = [float(n), *map(np.asarray, rest)]
                c = tuple(int(x) for x in cell)
                stack[c] = [x + y for x, y in zip(stack[c], new)] if c in stack else new
            by_group: dict = {}
            for c in sorted(stack):
                by_group.setdefault(c[0], []).append(c)
            use = slots[run] if slots else range(len(groups))
            cells = [(slot, c) for slot, g in enumerate(use) for c in by_group.get(int(g), [])]  # a subject drawn twice is two subjects
            n = int(sum(stack[c][0] for _, c in cells))
            dd = np.array([stack[c][1] for _, c in cells]).reshape(-1, w, w)
            de = np.array([stack[c][2] for _, c in cells]).reshape(-1, w, k)
            ee = np.array([stack[c][3] for _, c in cells]).reshape(len(cells), -1)
            at = [np.array([slot for slot, _ in cells]), *[np.array([c[1 + j] for _, c in cells]) for j in range(nc)]]
            size = [len(use), *levels]
            whole = dd.sum(0)
            zs, first = [], 0
            for width in widths:
                zs.append(slice(first, first + width))
                first += width

            def by_level(f, m):
                """Sums of cell blocks by the levels of random term f."""
                out = np.zeros((size[grouping[f]], *m.shape[1:]))
                np.add.at(out, at[grouping[f]], m)
                return out

            zz, zx = [by_level(f, dd[:, z, z]) for f, z in enumerate(zs)], [by_level(f, dd[:, z, q:]) for f, z in enumerate(zs)]
            structure = None
            if len(zs) > 1:
                pairs = {}
                for f in range(len(zs)):
                    for h in range(f + 1, len(zs)):
                        code, inverse = np.unique(at[grouping[f]] * size[grouping[h]] + at[grouping[h]], return_inverse=True)
                        block = np.zeros((len(code), widths[f], widths[h]))
                        np.add.at(block, inverse, dd[:, zs[f], zs[h]])
                        pairs[f, h] = (code // size[grouping[h]], code % size[grouping[h]], block)
                structure = Structure(zz, pairs)  # once for all components
            betas, ts, start = np.full((k, p), np.nan), np.full((k, p), np.nan), None
            gamma = np.zeros((len(cells), w, k))  # what each cell's design is multiplied with: its levels' modes, and the fixed effects
            yy = np.einsum("ckk->k", ee.reshape(-1, k, k)) if cross else ee.sum(0)
            for c in range(k):
                zy, xy = [by_level(f, de[:, z, c]) for f, z in enumerate(zs)], de[:, q:, c].sum(0)
                if structure is None:
                    f = fit_one_factor(zz[0], zx[0], zy[0], whole[q:, q:], xy, float(yy[c]), n)
                else:
                    f = structure.fit(zx, zy, whole[q:, q:], xy, float(yy[c]), n, start)
                    start = None if f is None or np.abs(f.theta).max() < 1e-3 else f.theta
                if f is not None:
                    betas[c], ts[c] = f.beta, f.t
                    gamma[:, q:, c] = f.beta
                    for j, z in enumerate(zs):
                        gamma[:, z, c] = f.modes[j][at[grouping[j]]]
            ok = ~np.isnan(betas).any(1)
            share = s / (total if slots is None and total else s.sum()) if k else s
            beta, t = betas[ok].T @ vv[ok], ts[ok].T @ (s[ok, None] * vv[ok])
            mask = masks[own][0] if k else np.zeros(nf, bool)
            rss = None
            if cross:
                both = np.einsum("cwk,cwl->kl", gamma, de)
                e = ee.reshape(-1, k, k).sum(0) - both - both.T + np.einsum("cwk,cwx,cxl->kl", gamma, dd, gamma, optimize=True)
                sv = s[ok, None] * vv[ok]
                rss = np.maximum(np.einsum("kj,kl,lj->j", sv, e[np.ix_(ok, ok)], sv, optimize=True), 0)
            maps = pd.concat([pd.DataFrame({"run": run, "term": name, "feature": np.arange(nf), "beta": beta[m], "t": t[m], "mask": mask, "rss": rss}) for m, name in enumerate(x_names)])
            ends = pd.DataFrame([(run, name, -1, float(betas[ok, m] @ share[ok]), float(ts[ok, m] @ share[ok]), None, None) for m, name in enumerate(x_names)], columns=list(maps.columns))
            return pd.concat([maps.astype({"mask": object, "rss": object}), ends])

        return partial.repartition(min(len(order), MOST_TASKS), "i").groupBy("i").applyInPandas(fit, "run int, term string, feature int, beta double, t double, mask boolean, rss double")

    # -- results

    def _ready(self) -> DataFrame:
        if self.total is None:
            self.observed()
        return self.maps

    def _names(self, names) -> list[str]:
        return list(names) if names else [n for n in self.x_names if n != INTERCEPT]

    def t_terms(self) -> DataFrame:
        """(run, term, beta, t): component fits weighted by each component's share."""
        self._ready()
        return self.summaries

    def _boot_maps(self, names) -> DataFrame:
        m = self.maps.filter(F.col("term").isin(names)).withColumn("stat", F.when(F.col("mask"), F.col("beta")).otherwise(0.0))
        if self.inner == 0:  # errors of the residuals, with the term's column over all trials
            squares = [F.sum(F.col(f"x{self.x_names.index(t)}") ** 2).alias(f"m{i}") for i, t in enumerate(names)]
            n, *mm = self.data.agg(F.count("*"), *squares).first()
            mm = self.spark.createDataFrame([(t, float(v), int(v > 0)) for t, v in zip(names, mm)], "term string, mm double, rank int")
            e = linalg.residual_errors(m.join(F.broadcast(mm), "term"), F.col("mm"), n, F.col("rank"))
            return inference.boot_stat(e.select(F.col("outer_id").alias("run"), "term", "feature", "stat", "sterr"), ["term", "feature"])
        e = inference.nested_standard_errors(m.select("term", "feature", "outer_id", "inner_id", "stat"), ["term", "feature"], len(self.groups))
        return inference.boot_stat(e.withColumnRenamed("outer_id", "run"), ["term", "feature"])

    def t_features(self, names=None) -> DataFrame:
        """(term, feature, t) of the observed data on the kept features; with bootstraps their statistic."""
        maps, names = self._ready(), self._names(names)
        if self._resampled == "boots":
            return self._boot_maps(names).filter("run = 0").select("term", "feature", F.col("b").alias("t"))
        return maps.filter((F.col("run") == 0) & F.col("term").isin(names)).select("term", "feature", F.when(F.col("mask"), F.col("t")).otherwise(0.0).alias("t"))

    def p_features(self, names=None, conj=None, do_tfce: bool = True) -> DataFrame:
        """(term, feature, p); conj: terms that must all hold. Needs permutations or bootstraps."""
        if self.total is None or not self.maps.agg(F.max("outer_id")).first()[0]:
            raise ValueError("run permutations or bootstraps before asking for p-values")
        names = list(conj) if conj else self._names(names)
        if self._resampled == "perms":
            m = self.maps.filter(F.col("term").isin(names)).withColumn("t", F.when(F.col("mask"), F.col("t")).otherwise(0.0))
            return inference.conjunction_pvalues(m, names) if conj else inference.two_stage_pvalues(m)
        b = self._boot_maps(names).select("run", "term", "feature", F.col("b").alias("t"))
        if conj:  # the least statistic, where permutations take the largest p
            b = b.groupBy("run", "feature").agg(F.min("t").alias("t")).withColumn("term", F.lit("&".join(names)))
        if do_tfce and self.graph is not None:
            kept = self.spark.createDataFrame([(i, int(k)) for i, k in enumerate(self.kept)], "feature int, node int")
            placed = b.join(F.broadcast(kept), "feature").select("run", "term", F.col("node").alias("feature"), F.col("t").alias("x"))
            on = enhance(placed, ["run", "term"], self.graph, e=self.options["E"], h=self.options["H"])
            b = on.join(F.broadcast(kept.withColumnRenamed("feature", "f")), F.col("feature") == F.col("node")).select("run", "term", F.col("f").alias("feature"), F.col("tfce").alias("t"))
        null = b.groupBy("run").agg(F.max("t").alias("m")).agg(F.sort_array(F.collect_list("m")).alias("null"))
        out = b.filter("run = 0").crossJoin(F.broadcast(null))
        return out.select("term", "feature", (F.size(F.filter("null", lambda v: v >= F.col("t"))) / F.size("null")).alias("p"))


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)
