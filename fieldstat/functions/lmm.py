"""Linear mixed models by restricted maximum likelihood, from cross products alone.

With one grouping factor all that the likelihood needs of a group is its cross products of random-effect
columns Z, fixed-effect columns X and the response. These are sums over rows, so any number of rows and
groups can be reduced before a model is fitted. Several factors are fitted in :mod:`levels`; here only densely, for comparison.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Fit:
    beta: np.ndarray
    se: np.ndarray
    t: np.ndarray
    sigma2: float
    cov: list[np.ndarray]  # random-effect covariance of each factor
    loglik: float
    modes: list[np.ndarray] | None = None  # of each factor, levels x columns: the conditional means of the random effects
    theta: np.ndarray | None = None  # relative factors, row by row of each lower triangle


def _lower(theta: np.ndarray, q: int) -> np.ndarray:
    out = np.zeros((q, q))
    out[np.tril_indices(q)] = theta
    return out


def _finish(xx, xy, yy, logdet, n, rank_check=True):
    """Profiled REML from the whitened cross products."""
    p = len(xy)
    c = np.linalg.cholesky(xx)
    u = np.linalg.solve(c, xy)
    beta = np.linalg.solve(c.T, u)
    rss = float(yy - u @ u)
    s2 = max(rss, 1e-300) / (n - p)
    dev = logdet + 2 * np.log(np.diag(c)).sum() + (n - p) * (1 + np.log(2 * np.pi * s2))
    return dev, beta, s2, c


def minimise(f, start: np.ndarray, tol: float = 1e-10, most: int = 2000) -> np.ndarray:
    """Nelder-Mead simplex search, restarted once from its result."""
    x = np.asarray(start, float)
    for _ in range(2):
        k = len(x)
        pts = np.vstack([x, x + 0.25 * np.eye(k)])
        val = np.array([f(p) for p in pts])
        for _ in range(most):
            o = np.argsort(val, kind="stable")
            pts, val = pts[o], val[o]
            if val[-1] - val[0] <= tol * (abs(val[0]) + tol) and np.ptp(pts, axis=0).max() < 1e-7:
                break
            mid = pts[:-1].mean(0)
            r = mid + (mid - pts[-1])
            fr = f(r)
            if fr < val[0]:
                e = mid + 2 * (mid - pts[-1])
                fe = f(e)
                pts[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
            elif fr < val[-2]:
                pts[-1], val[-1] = r, fr
            else:
                c = mid + 0.5 * ((r if fr < val[-1] else pts[-1]) - mid)
                fc = f(c)
                if fc < min(fr, val[-1]):
                    pts[-1], val[-1] = c, fc
                else:
                    pts[1:] = pts[0] + 0.5 * (pts[1:] - pts[0])
                    val[1:] = [f(p) for p in pts[1:]]
        x = pts[0]
    return x


def fit_one_factor(zz, zx, zy, xx, xy, yy: float, n: int) -> Fit | None:
    """One grouping factor. zz: groups x q x q, zx: groups x q x p, zy: groups x q; xx, xy, yy: whole sums; n: rows.

    None where the fixed effects are not estimable. Random effects of a group share a free covariance.
    """
    zz, zx, zy = np.asarray(zz, float), np.asarray(zx, float), np.asarray(zy, float)
    q, p = zz.shape[1], len(xy)
    if n <= p or np.linalg.matrix_rank(xx) < p:
        return None
    eye = np.eye(q)

    def at(theta):
        # V = I + Z L L' Z': its inverse and determinant come from the q x q matrices I + L' Z'Z L
        low = _lower(theta, q)
        m = eye + low.T @ zz @ low
        c = np.linalg.cholesky(m)
        a = np.linalg.solve(c, low.T @ zx)
        b = np.linalg.solve(c, (zy @ low)[..., None])[..., 0]
        logdet = 2 * np.log(np.diagonal(c, axis1=1, axis2=2)).sum()
        return _finish(xx - np.einsum("gqi,gqj->ij", a, a), xy - np.einsum("gqi,gq->i", a, b), yy - (b * b).sum(), logdet, n)

    def dev(theta):
        try:
            return at(theta)[0]
        except np.linalg.LinAlgError:
            return np.inf

    if q == 1:
        theta = _golden(lambda v: dev(np.array([v])))
    else:
        theta = minimise(dev, np.eye(q)[np.tril_indices(q)])
    try:
        d, beta, s2, c = at(np.atleast_1d(theta))
    except np.linalg.LinAlgError:
        return None
    theta = np.atleast_1d(theta)
    low = _lower(theta, q)
    se = np.sqrt(s2 * np.diag(np.linalg.inv(c @ c.T)))
    modes = low @ np.linalg.solve(eye + low.T @ zz @ low, low.T @ (zy - zx @ beta)[..., None])
    return Fit(beta, se, beta / se, s2, [s2 * low @ low.T], -d / 2, [modes[..., 0]], theta)


def fit_sizes(sizes, counts, outer, whole, n: int, rest: list[tuple[int, int]] | None = None, place: int = 0) -> Fit | None:
    """A random intercept from sums over all levels of one size, so that nothing grows with its levels; beside it other terms of few levels.

    A level's share in the likelihood depends on its number of rows and on squares of its sums v over the columns [of the levels of ``rest``, x, y].
    sizes: the numbers of rows that occur; counts: levels of each size; outer: sizes x k x k, the sums of v v' over these levels; whole: k x k cross
    products of all rows; n: rows; rest: (levels, columns) of the other terms; place: of the intercept among the terms. Its own modes are None.
    """
    sizes, counts, rest = np.asarray(sizes, float), np.asarray(counts, float), rest or []
    d = sum(k * q for k, q in rest)
    p = len(whole) - d - 1
    if n <= p or np.linalg.matrix_rank(whole[d:-1, d:-1]) < p:
        return None
    shapes = [*rest[:place], None, *rest[place:]]
    widths = [s[1] if s else 1 for s in shapes]
    cuts = np.cumsum([0, *[q * (q + 1) // 2 for q in widths]])

    def at(theta):
        lows = [_lower(theta[a:b], q) for q, a, b in zip(widths, cuts[:-1], cuts[1:])]
        v = float(lows[place][0, 0]) ** 2
        s = whole - np.tensordot(v / (1 + v * sizes), outer, 1)
        logdet, right, low, first = (counts * np.log1p(v * sizes)).sum(), s[d:, d:], np.zeros((d, d)), 0
        for shape, own in zip(shapes, lows):
            if shape:
                k = shape[0] * shape[1]
                low[first : first + k, first : first + k] = np.kron(np.eye(shape[0]), own)
                first += k
        c = np.linalg.cholesky(np.eye(d) + low.T @ s[:d, :d] @ low)
        if d:
            a = np.linalg.solve(c, low.T @ s[:d, d:])
            logdet, right = logdet + 2 * np.log(np.diag(c)).sum(), right - a.T @ a
        return *_finish(right[:p, :p], right[:p, p], right[p, p], logdet, n), lows, low, c, s

    def dev(theta):
        try:
            return at(theta)[0]
        except np.linalg.LinAlgError:
            return np.inf

    if cuts[-1] == 1:
        theta = _golden(lambda v: dev(np.array([v])))
    else:
        theta = minimise(dev, np.concatenate([np.eye(q)[np.tril_indices(q)] for q in widths]))
    try:
        value, beta, s2, c, lows, low, own, s = at(theta)
    except np.linalg.LinAlgError:
        return None
    u = low @ np.linalg.solve(own @ own.T, low.T @ (s[:d, -1] - s[:d, d:-1] @ beta)) if d else np.zeros(0)
    modes, first = [], 0
    for shape in shapes:
        modes.append(u[first : first + shape[0] * shape[1]].reshape(shape) if shape else None)
        first += shape[0] * shape[1] if shape else 0
    se = np.sqrt(s2 * np.diag(np.linalg.inv(c @ c.T)))
    return Fit(beta, se, beta / se, s2, [s2 * v @ v.T for v in lows], -value / 2, modes, theta)


def _golden(f) -> np.ndarray:
    """Least f(v), v >= 0: a coarse grid, then golden sections; 0 itself is tried."""
    grid = np.append(0.0, np.geomspace(1e-3, 1e3, 49))
    val = [f(v) for v in grid]
    i = int(np.argmin(val))
    a, b = grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)]
    g = (np.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(90):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    x = (a + b) / 2
    return np.array([0.0 if val[0] <= f(x) else x])


def fit_crossed(x: np.ndarray, y: np.ndarray, factors: list[tuple[np.ndarray, np.ndarray]]) -> Fit | None:
    """Several factors, crossed or not: (columns n x q, group codes n) of each. Dense, for models of a few thousand rows; tests hold :mod:`levels` against it."""
    n, p = x.shape
    if n <= p or np.linalg.matrix_rank(x) < p:
        return None
    blocks, shapes = [], []
    for cols, codes in factors:
        k, q = int(codes.max()) + 1, cols.shape[1]
        z = np.zeros((n, k * q))
        for j in range(q):
            z[np.arange(n), codes * q + j] = cols[:, j]
        blocks.append(z)
        shapes.append((k, q))
    z = np.concatenate(blocks, 1)
    zz, zx, zy = z.T @ z, z.T @ x, z.T @ y
    xx, xy, yy = x.T @ x, x.T @ y, float(y @ y)
    cuts = np.cumsum([0] + [q * (q + 1) // 2 for _, q in shapes])

    def lam(theta):
        out, at = np.zeros_like(zz), 0
        for (k, q), a, b in zip(shapes, cuts[:-1], cuts[1:]):
            out[at : at + k * q, at : at + k * q] = np.kron(np.eye(k), _lower(theta[a:b], q))
            at += k * q
        return out

    def at(theta):
        low = lam(theta)
        c = np.linalg.cholesky(np.eye(len(zz)) + low.T @ zz @ low)
        a, b = np.linalg.solve(c, low.T @ zx), np.linalg.solve(c, low.T @ zy)
        return _finish(xx - a.T @ a, xy - a.T @ b, yy - b @ b, 2 * np.log(np.diag(c)).sum(), n)

    def dev(theta):
        try:
            return at(theta)[0]
        except np.linalg.LinAlgError:
            return np.inf

    theta = minimise(dev, np.concatenate([np.eye(q)[np.tril_indices(q)] for _, q in shapes]))
    try:
        d, beta, s2, c = at(theta)
    except np.linalg.LinAlgError:
        return None
    se = np.sqrt(s2 * np.diag(np.linalg.inv(c @ c.T)))
    low = [_lower(theta[a:b], q) for (_, q), a, b in zip(shapes, cuts[:-1], cuts[1:])]
    return Fit(beta, se, beta / se, s2, [s2 * v @ v.T for v in low], -d / 2)


def random_effects(fit: Fit, names: list[list[str]], groups: list[str]) -> tuple[list[dict], list[dict] | None]:
    """Variances (Name, Var, Std, the residual last) and correlations (IV1, IV2, Corr), None if there are none."""
    var, cor = [], []
    for cov, cols, g in zip(fit.cov, names, groups):
        var += [{"Name": f"{g}.{c}", "Var": float(cov[i, i]), "Std": float(np.sqrt(cov[i, i]))} for i, c in enumerate(cols)]
        for i in range(len(cols)):
            for j in range(i + 1, len(cols)):
                d = np.sqrt(cov[i, i] * cov[j, j])
                cor.append({"IV1": f"{g}.{cols[i]}", "IV2": f"{g}.{cols[j]}", "Corr": float(cov[i, j] / d) if d > 0 else None})
    var.append({"Name": "Residual", "Var": float(fit.sigma2), "Std": float(np.sqrt(fit.sigma2))})
    return var, cor or None
