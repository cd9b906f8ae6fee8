"""Mixed models over DataFrames: cross products by size, by level and by pair of levels first, fits on the sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formula import INTERCEPT, Formula, design, parse
from ..functions.levels import Structure
from ..functions.lmm import fit_one_factor, fit_sizes, random_effects

FIT = "term string, beta double, se double, t double, loglik double, var_resid double, re_name array<string>, re_var array<double>, re_cor_name array<string>, re_cor array<double>"
#: Rows of a random effect's level: number of the random term, level, its conditional mean.
MODE = "random int, level string, mode double"
#: Of several terms, an intercept of more levels than this is summed up by size ...
FEW_LEVELS = 1_000
#: ... if the others have together no more columns than this, which become sums of each of its levels.
MOST_OTHERS = 24


def _columns(df: DataFrame, f: Formula, factors):
    x = design(df, f.fixed, factors)
    z = [design(df, list(r.terms), factors) for r in f.random]
    return x, z


def level_sums(df: DataFrame, by: list[str], x: list, z: list[list], levels: list, y) -> DataFrame:
    """(by, f, g, a, b, n, s): all that a fit needs of rows of any number.

    g = -1: a level ``a`` of random term f; s holds the products of its z with themselves and with x and y (upper triangle of [z, x, y] for
    f = 0, whose sums over levels are those of all rows). Else a pair of levels a of f and b of g that occur together; s holds z_f by z_g.
    Each is one aggregation by key with map-side sums.
    """
    out = []
    for f, own in enumerate(z):
        cols = [*own, *x, y]
        pairs = [(i, j) for i in range(len(cols) if f == 0 else len(own)) for j in range(i, len(cols))]
        level = df.groupBy(*by, levels[f].cast("string").alias("a")).agg(F.count("*").alias("n"), F.array(*[F.sum(cols[i] * cols[j]) for i, j in pairs]).alias("s"))
        out.append(level.select(*by, F.lit(f).alias("f"), F.lit(-1).alias("g"), "a", F.lit(None).cast("string").alias("b"), "n", "s"))
        for g in range(f + 1, len(z)):
            both = df.groupBy(*by, levels[f].cast("string").alias("a"), levels[g].cast("string").alias("b")).agg(F.count("*").alias("n"), F.array(*[F.sum(p * q) for p in own for q in z[g]]).alias("s"))
            out.append(both.select(*by, F.lit(f).alias("f"), F.lit(g).alias("g"), "a", "b", "n", "s"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def solve_sums(pdf: pd.DataFrame, widths: list[int], p: int):
    """(fit, level names by term) from the rows of :func:`level_sums` of one model."""
    names, zz, zx, zy = [], [], [], []
    whole = n = None
    for f, q in enumerate(widths):
        own = pdf[(pdf["f"] == f) & (pdf["g"] == -1)].sort_values("a")
        s, k = np.stack(own["s"].to_numpy()), q + p + 1
        m, at = np.zeros((len(own), k, k)), 0
        for i in range(k if f == 0 else q):
            m[:, i, i:] = s[:, at : at + k - i]
            m[:, i:, i] = s[:, at : at + k - i]
            at += k - i
        names.append(own["a"].to_numpy())
        zz.append(m[:, :q, :q])
        zx.append(m[:, :q, q:-1])
        zy.append(m[:, :q, -1])
        if f == 0:
            whole, n = m[:, q:, q:].sum(0), int(own["n"].sum())
    xx, xy, yy = whole[:p, :p], whole[:p, p], float(whole[p, p])
    if len(widths) == 1:
        return fit_one_factor(zz[0], zx[0], zy[0], xx, xy, yy, n), names
    pairs = {}
    for (f, g), own in pdf[pdf["g"] >= 0].groupby(["f", "g"]):
        pairs[f, g] = (np.searchsorted(names[f], own["a"]), np.searchsorted(names[g], own["b"]), np.stack(own["s"].to_numpy()).reshape(-1, widths[f], widths[g]))
    return Structure(zz, pairs).fit(zx, zy, xx, xy, yy, n), names


def _summed_up(df: DataFrame, f: Formula, z: list[dict]) -> tuple[int, list[list[str]]] | None:
    """The random intercept whose levels are summed up by size, and the levels of the other terms; None where the levels themselves must reach the fit."""
    plain = [k for k, r in enumerate(f.random) if r.terms == (INTERCEPT,)]
    if len(f.random) == 1 or not plain:
        return (0, []) if plain else None
    levels = df.agg(*[F.approx_count_distinct(r.group).alias(f"n{k}") for k, r in enumerate(f.random)]).first()
    big = max(plain, key=lambda k: levels[k])
    others = [k for k in range(len(z)) if k != big]
    if levels[big] <= FEW_LEVELS or sum(levels[k] * len(z[k]) for k in others) > 2 * MOST_OTHERS:
        return None
    names = [sorted(r[0] for r in df.select(F.col(f.random[k].group).cast("string")).distinct().limit(MOST_OTHERS + 1).collect()) for k in others]
    return (big, names) if sum(len(own) * len(z[k]) for own, k in zip(names, others)) <= MOST_OTHERS else None


def _triangle(cols: list):
    return F.array(*[F.sum(cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))])


def _square(s, k: int) -> np.ndarray:
    m, (i, j) = np.zeros((k, k)), np.triu_indices(k)
    m[i, j] = m[j, i] = s
    return m


def size_sums(df: DataFrame, by: list[str], level, columns: list, counted: list) -> tuple[DataFrame, DataFrame]:
    """(by, _a, _n, _v) of each level _a: rows and sums of ``columns``; and what a fit needs of them, (by, _size, _n, _s, _present).

    Of each number of rows that levels have (_size): levels of it, and the sums over them of the products of _v (upper triangle). _size null: rows and
    products over all rows, and the sums of ``counted``. There are at most sqrt(2 rows) sizes, whatever the number of levels.
    """
    own = df.groupBy(*by, level.cast("string").alias("_a")).agg(F.count("*").alias("_n"), F.array(*[F.sum(c) for c in columns]).alias("_v"))
    sizes = own.groupBy(*by, F.col("_n").alias("_size")).agg(F.count("*").alias("_n"), _triangle([F.col("_v")[i] for i in range(len(columns))]).alias("_s"))
    present = F.array(*[F.sum(c) for c in counted]) if counted else F.lit(None)
    whole = df.groupBy(*by).agg(F.count("*").alias("_n"), _triangle(columns).alias("_s"), present.cast("array<double>").alias("_present"))
    return own, whole.withColumn("_size", F.lit(None).cast("bigint")).unionByName(sizes, allowMissingColumns=True)


def _solved(df: DataFrame, formula: str, by: list[str], response: str | None, factors, modes: bool):
    """Fits, and modes if asked for, in one table, and the formula and columns they are of; without ``by`` there is a column _all."""
    f = parse(formula)
    y = response or f.response
    if not f.random:
        raise ValueError("a mixed model has at least one (terms|group)")
    df = df.dropna(subset=[*f.variables, y, *[r.group for r in f.random]])
    x, z = _columns(df, f, factors)
    kinds = dict(df.dtypes)
    schema = "".join(f"`{b}` {kinds[b]}, " for b in by) + f"{FIT}, {MODE}"
    if not by:
        df, by, schema = df.withColumn("_all", F.lit(0)), ["_all"], f"_all int, {FIT}, {MODE}"
    z_names, x_names, groups = [list(c) for c in z], list(x), [r.group for r in f.random]
    columns = [c.split(" ")[0] for c in f"{FIT}, {MODE}".split(", ")]

    def table(head, fit, levels, more=None):
        """Rows of one fit; ``levels``: names by term, and which of the fit's modes they are."""
        if fit is None:
            return pd.DataFrame([{**head, **dict.fromkeys([*columns, *(more or {})])}])
        var, cor = random_effects(fit, z_names, groups)
        re = {"re_name": [v["Name"] for v in var[:-1]], "re_var": [v["Var"] for v in var[:-1]], "re_cor_name": [f"{c['IV1']}~{c['IV2']}" for c in cor or []], "re_cor": [c["Corr"] for c in cor or []]}
        rows = [{**head, "term": t, "beta": fit.beta[i], "se": fit.se[i], "t": fit.t[i], "loglik": fit.loglik, "var_resid": fit.sigma2, **re, **(more or {})} for i, t in enumerate(x_names)]
        out = [pd.DataFrame(rows, columns=[*head, *columns, *(more or {})])]
        for k, (names, values) in enumerate(levels) if modes else ():
            for j, t in enumerate(z_names[k]) if len(names) else ():
                out.append(pd.DataFrame({"term": t, "random": k, "level": names, "mode": values[:, j]}).assign(**head))
        out = pd.concat(out, ignore_index=True).reindex(columns=[*head, *columns, *(more or {})])
        for c in {*re, *(more or {})} - {"_ratio"}:
            out[c] = pd.Series([v if isinstance(v, list) else None for v in out[c]], dtype=object)  # a missing list is null, not NaN
        return out.astype({"random": "Int32", "term": object, "level": object})

    def solve(key, pdf):
        fit, levels = solve_sums(pdf, [len(c) for c in z_names], len(x_names))
        return table(dict(zip(by, key)), fit, fit and list(zip(levels, fit.modes)))

    tasks, value = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(y).cast("double")  # stated: fits take long for few bytes, and would be put together
    summed = _summed_up(df, f, z)
    if summed is None:
        sums = level_sums(df, by, list(x.values()), [list(c.values()) for c in z], [F.col(g) for g in groups], value)
        return sums.repartition(tasks, *by).groupBy(*by).applyInPandas(solve, schema), df, f, x, z, by
    big, names = summed
    others = [k for k in range(len(z)) if k != big]
    shapes = [(len(own), len(z[k])) for own, k in zip(names, others)]
    inside = [(k, F.when(F.col(groups[k]).cast("string") == F.lit(a), 1.0).otherwise(0.0)) for own, k in zip(names, others) for a in own]
    cols = [*[i * c for k, i in inside for c in z[k].values()], *x.values(), value]
    width = len(cols)

    def solve_sizes(key, pdf):
        whole, own = pdf[pdf["_size"].isna()].iloc[0], pdf[pdf["_size"].notna()].sort_values("_size")
        fit = fit_sizes(own["_size"], own["_n"], np.stack([_square(s, width) for s in own["_s"]]), _square(whole["_s"], width), int(whole["_n"]), shapes, big)
        if fit is None:
            return table(dict(zip(by, key)), None, None, {"_coef": None, "_ratio": None})
        levels, first = [((), None)] * len(groups), 0
        for (n, _), own, k in zip(shapes, names, others):
            here = np.asarray(whole["_present"][first : first + n]) > 0
            levels[k], first = (np.asarray(own, object)[here], fit.modes[k][here]), first + n
        coef = np.concatenate([*[fit.modes[k].ravel() for k in others], fit.beta])
        return table(dict(zip(by, key)), fit, levels, {"_coef": coef.tolist(), "_ratio": float(fit.cov[big][0, 0] / fit.sigma2)})

    own, sums = size_sums(df, by, F.col(groups[big]), cols, [i for _, i in inside])
    fits = sums.repartition(tasks, *by).groupBy(*by).applyInPandas(solve_sizes, f"{schema}, _coef array<double>, _ratio double")
    solved = fits.drop("_coef", "_ratio")
    if modes:  # of the levels summed up: from their own sums, by key
        one = fits.filter((F.col("term") == x_names[0]) & F.col("random").isNull()).select(*[F.col(f"`{b}`").alias(f"_by{i}") for i, b in enumerate(by)], "_coef", "_ratio")
        rest = F.aggregate(F.zip_with("_coef", "_v", lambda c, v: c * v), F.element_at("_v", -1), lambda s, v: s - F.coalesce(v, F.lit(0.0)))
        found = own.join(one, [F.col(f"`{b}`").eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)])
        found = found.select(*by, F.lit(INTERCEPT).alias("term"), F.lit(big).alias("random"), F.col("_a").alias("level"), (F.col("_ratio") / (1 + F.col("_ratio") * F.col("_n")) * rest).alias("mode"))
        solved = solved.unionByName(found, allowMissingColumns=True)
    return solved, df, f, x, z, by


def fit_models(df: DataFrame, formula: str, by: list[str] | None = None, response: str | None = None, factors=None) -> DataFrame:
    """One model for each value of ``by``: (by, term, beta, se, t, loglik, var_resid, re_name, re_var, re_cor_name, re_cor).

    A random intercept's levels are summed up by their numbers of rows, so that a fit's size does not depend on theirs (beside other terms, where these have
    few levels: MOST_OTHERS). Else rows are reduced to cross products by (by, level) of each random term, and by (by, pair of levels) of each two, and only these
    reach the fit; random terms may be nested or crossed, and share a grouping column. re_var, re_cor: variances of the random effects, and correlations of those
    of one term. Models that can't be fitted give one row of nulls. Rows with a null in any variable are left out.
    """
    solved, *_ = _solved(df, formula, list(by or []), response, factors, False)
    return solved.filter("random IS NULL").drop("_all", "random", "level", "mode")


def random_modes(df: DataFrame, formula: str, by: list[str] | None = None, response: str | None = None, factors=None) -> DataFrame:
    """(by, grp, random, level, term, mode): conditional means of the random effects; grp: the grouping column of random term number ``random``."""
    solved, _, f, *_ = _solved(df, formula, list(by or []), response, factors, True)
    group = F.element_at(F.array(*[F.lit(r.group) for r in f.random]), F.col("random") + 1)
    return solved.filter("random IS NOT NULL").select(*(by or []), group.alias("grp"), "random", "level", "term", "mode")


def residuals(df: DataFrame, formula: str, by: list[str] | None = None, response: str | None = None, factors=None) -> DataFrame:
    """``df``'s rows with ``fitted`` and ``residual``: the response less fixed and random effects, null where the model can't be fitted.

    Coefficients and modes are joined to the rows by key; rows with a null in any variable are left out.
    """
    solved, rows, f, x, z, keys = _solved(df, formula, list(by or []), response, factors, True)
    solved, names = solved.persist(), list(rows.columns)
    rows = rows.select(*names, F.array(*x.values()).alias("_x"), *[F.array(*c.values()).alias(f"_z{k}") for k, c in enumerate(z)], *[F.col(r.group).cast("string").alias(f"_g{k}") for k, r in enumerate(f.random)])

    def listed(of: DataFrame, value: str, order: list[str], *by: str) -> DataFrame:
        """The terms' values as one array, in the order of ``order``."""
        found = of.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("term", value))).alias("m"))
        return found.select(*by, F.array(*[F.col("m")[t] for t in order]).alias("v"))

    def dot(a: str, b: str):
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    fitted = listed(solved.filter("random IS NULL AND term IS NOT NULL"), "beta", list(x), *keys).withColumnRenamed("v", "_b")
    rows, total = rows.join(fitted, keys, "left"), dot("_x", "_b")
    for k, c in enumerate(z):
        modes = listed(solved.filter(F.col("random") == k), "mode", list(c), *keys, "level").withColumnsRenamed({"level": f"_g{k}", "v": f"_u{k}"})
        rows, total = rows.join(modes, [*keys, f"_g{k}"], "left"), total + dot(f"_z{k}", f"_u{k}")
    rows = rows.withColumn("fitted", total).withColumn("residual", F.col(response or f.response) - F.col("fitted"))
    return rows.select(*[n for n in names if n != "_all"], "fitted", "residual")
