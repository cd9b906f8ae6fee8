"""Mixed models with several random terms, crossed or nested, from cross products by level and by pair of levels.

The likelihood needs Z'Z only where two levels share rows. A sum by level and one by pair of levels that occur together are all that is
taken from the data; what a fit works on grows with the levels and their pairs, not with the rows.

Levels are eliminated term by term, the term of most levels first. A term whose levels are not tied to each other, at the outset or
by what was eliminated before, is a block diagonal, and all of its levels go at once; nested terms of any size stay so and fill nothing in.
What is left of crossed terms (those with fewer levels) is one dense triangle.
"""

from __future__ import annotations

import numpy as np

from .lmm import Fit, _finish, _golden, _lower, minimise

#: Random effects that may be left for the dense triangle (0.5 GB).
MOST_DENSE = 8_000
#: Numbers of a strip of rows that is multiplied at once.
STRIP = 4_000_000


def _sum_at(at: np.ndarray, blocks: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``blocks`` (m x a x b) by ``at``, 0 to n - 1."""
    return np.stack([np.bincount(at, x, n) for x in blocks.reshape(len(at), -1).T], 1).reshape(n, *blocks.shape[1:]) if len(at) else np.zeros((n, *blocks.shape[1:]))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of small matrices, pair by pair."""
    return a * b if a.shape[2] == 1 else a @ b


class Structure:
    """Z'Z of the random terms, and the order in which it is factored; used again for each covariance and each response.

    zz: of each term, levels x q x q. pairs: for two terms f < g, (levels of f, levels of g, blocks m x qf x qg), each pair of levels once.
    """

    def __init__(self, zz: list[np.ndarray], pairs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]], most_dense: int = MOST_DENSE):
        self.zz = [np.asarray(b, float) for b in zz]
        self.levels, self.widths = [len(b) for b in zz], [b.shape[1] for b in self.zz]
        terms = range(len(zz))
        self.given, ties = {}, {}
        for (f, g), (i, j, b) in pairs.items():
            i, j, b = np.asarray(i, np.int64), np.asarray(j, np.int64), np.asarray(b, float)
            ties[f, g] = np.unique(i * self.levels[g] + j)
            if len(ties[f, g]) < len(i):
                raise ValueError("a pair of levels stands twice")
            self.given[f, g] = (i, j, b)
            self.given[g, f] = (j, i, b.transpose(0, 2, 1))

        def tied(f, g):
            """Levels of f and g that are tied, as arrays."""
            if f < g:
                code = ties.get((f, g), np.empty(0, np.int64))
                return code // self.levels[g], code % self.levels[g]
            return tied(g, f)[::-1]

        left, dense, self.single = sorted(terms, key=lambda f: (-self.levels[f] * self.widths[f], f)), set(), []
        for f in list(left):
            if f in dense:
                continue
            left.remove(f)
            self.single.append(f)
            for g in left:
                i, j = tied(f, g)
                if len(i) > len(np.unique(i)):  # a level of f ties several of g
                    dense.add(g)
            for g in left:
                for h in left:
                    if g < h and not {g, h} <= dense:
                        fill = _meet(*tied(f, g), *tied(f, h))
                        ties[g, h] = np.union1d(ties.get((g, h), np.empty(0, np.int64)), fill[0] * self.levels[h] + fill[1])
        self.dense = sorted(left)
        self.ties = {(f, g): tied(f, g) for k, f in enumerate(self.single) for g in [*self.single[k + 1 :], *self.dense]}
        self.at, total = {}, 0
        for f in self.dense:
            self.at[f] = total
            total += self.levels[f] * self.widths[f]
        self.total = total
        if total > most_dense:
            raise ValueError(f"{total} random effects of crossed terms are too many for a dense factor of {most_dense}")

    def factor(self, lows: list[np.ndarray]) -> Factor:
        return Factor(self, lows)

    def fit(self, zx: list, zy: list, xx, xy, yy: float, n: int, start: np.ndarray | None = None) -> Fit | None:
        """zx: of each term levels x q x p, zy: levels x q; xx, xy, yy: whole sums; n: rows. None where the fixed effects are not estimable.

        Effects of a level share a free covariance for each term. start: relative factors to begin with, such as those of a response before.
        """
        p = len(xy)
        if n <= p or np.linalg.matrix_rank(xx) < p:
            return None
        cuts = np.cumsum([0, *[q * (q + 1) // 2 for q in self.widths]])
        right = [np.concatenate([np.asarray(a, float), np.asarray(b, float)[..., None]], 2) for a, b in zip(zx, zy)]

        def lows(theta):
            return [_lower(theta[a:b], q) for q, a, b in zip(self.widths, cuts[:-1], cuts[1:])]

        def at(theta):
            f = self.factor(lows(theta))
            s = f.squares(f.forward(right))
            return _finish(xx - s[:p, :p], xy - s[:p, p], yy - s[p, p], f.logdet, n)

        def dev(theta):
            try:
                return at(theta)[0]
            except np.linalg.LinAlgError:
                return np.inf

        if cuts[-1] == 1:
            theta = _golden(lambda v: dev(np.array([v])))
        else:
            theta = minimise(dev, np.concatenate([np.eye(q)[np.tril_indices(q)] for q in self.widths]) if start is None else start)
        try:
            d, beta, s2, c = at(theta)
        except np.linalg.LinAlgError:
            return None
        low = lows(theta)
        f = self.factor(low)
        modes = f.solve([(b[..., p] - b[..., :p] @ beta)[..., None] for b in right])
        se = np.sqrt(s2 * np.diag(np.linalg.inv(c @ c.T)))
        return Fit(beta, se, beta / se, s2, [s2 * v @ v.T for v in low], -d / 2, [m[..., 0] for m in modes], theta)


def _meet(i: np.ndarray, a: np.ndarray, j: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (a, b) of equal i and j."""
    o = np.argsort(j, kind="stable")
    j, b = j[o], b[o]
    first, last = np.searchsorted(j, i, "left"), np.searchsorted(j, i, "right")
    n = last - first
    at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.repeat(a, n), b[at]


class Factor:
    """The triangle of L'Z'ZL + I for one set of relative factors L, and solutions with it."""

    def __init__(self, s: Structure, lows: list[np.ndarray]):
        self.s, self.lows, self.logdet = s, lows, 0.0
        diagonal = [np.eye(q) + low.T @ zz @ low for q, low, zz in zip(s.widths, lows, s.zz)]
        blocks: dict[tuple[int, int], np.ndarray] = {}

        def scaled(f, g):
            i, j, b = s.given[f, g]
            return i, j, lows[f].T @ b @ lows[g]

        for (f, g), (i, j) in s.ties.items():
            out = np.zeros((len(i), s.widths[f], s.widths[g]))
            if (f, g) in s.given:
                a, b, block = scaled(f, g)
                code = i * s.levels[g] + j
                o = np.argsort(code)
                out[o[np.searchsorted(code[o], a * s.levels[g] + b)]] = block
            blocks[f, g] = out
        whole = np.zeros((s.total, s.total))
        for f in s.dense:
            place = s.at[f] + np.arange(s.levels[f] * s.widths[f]).reshape(s.levels[f], -1)
            whole[place[:, :, None], place[:, None, :]] = diagonal[f]
            for g in s.dense:
                if f < g and (f, g) in s.given:
                    i, j, b = scaled(f, g)
                    rows, cols = place[i], s.at[g] + np.arange(s.levels[g] * s.widths[g]).reshape(s.levels[g], -1)[j]
                    whole[rows[:, :, None], cols[:, None, :]] = b
                    whole[cols[:, :, None], rows[:, None, :]] = b.transpose(0, 2, 1)
        self.own, self.across, self.strips = {}, {}, {}
        for k, f in enumerate(s.single):
            self.own[f] = c = np.linalg.cholesky(diagonal[f])
            self.logdet += 2 * np.log(np.diagonal(c, axis1=1, axis2=2)).sum()
            rest, inverse = [*s.single[k + 1 :], *s.dense], np.linalg.inv(c)
            for g in rest:
                self.across[f, g] = _times(inverse[s.ties[f, g][0]], blocks[f, g])
            for g in s.single[k + 1 :]:
                i, j = s.ties[f, g]
                w = self.across[f, g]
                diagonal[g] = diagonal[g] - _sum_at(j, _times(w.transpose(0, 2, 1), w), s.levels[g])
                for h in rest:
                    if h != g and (g, h) in s.ties:
                        i2, j2 = s.ties[f, h]
                        a, b = _meet(i, np.arange(len(i)), i2, np.arange(len(i2)))
                        if len(a):
                            gi, hj = s.ties[g, h]
                            code = gi * s.levels[h] + hj
                            o = np.argsort(code)
                            at = o[np.searchsorted(code[o], j[a] * s.levels[h] + j2[b])]
                            blocks[g, h] = blocks[g, h] - _sum_at(at, _times(w[a].transpose(0, 2, 1), self.across[f, h][b]), len(code))
            for strip in self._kept(f):
                whole -= strip.T @ strip
        self.triangle = np.linalg.cholesky(whole)
        self.logdet += 2 * np.log(np.diag(self.triangle)).sum()

    def _kept(self, f: int):
        """The strips of f, kept for the right sides if there are few."""
        if f not in self.strips and self.s.levels[f] * self.s.widths[f] * self.s.total <= 4 * STRIP:
            self.strips[f] = list(self._strips(f))
        return self.strips.get(f) or self._strips(f)

    def _strips(self, f: int):
        """Rows of the factor that belong to f, over the dense columns, some levels at a time."""
        s = self.s
        if s.total:
            step, q = max(1, STRIP // (s.total * s.widths[f])), s.widths[f]
            for first in range(0, s.levels[f], step):
                n = min(step, s.levels[f] - first)
                out = np.zeros((n, q, s.total))
                for g in s.dense:
                    i, j = s.ties[f, g]
                    m = (i >= first) & (i < first + n)
                    cols = s.at[g] + np.arange(s.levels[g] * s.widths[g]).reshape(s.levels[g], -1)[j[m]]
                    out[(i[m] - first)[:, None, None], np.arange(q)[None, :, None], cols[:, None, :]] = self.across[f, g][m]
                yield out.reshape(n * q, s.total)

    def forward(self, right: list[np.ndarray]) -> tuple[dict[int, np.ndarray], np.ndarray]:
        """Solutions of the triangle for right sides (of each term levels x q x m) that stand before L'."""
        s = self.s
        r = [low.T @ np.asarray(b, float) for low, b in zip(self.lows, right)]
        m, out = r[0].shape[2], {}
        bottom = np.concatenate([r[f].reshape(-1, m) for f in s.dense]) if s.dense else np.zeros((0, m))
        for k, f in enumerate(s.single):
            out[f] = np.linalg.solve(self.own[f], r[f])
            for g in s.single[k + 1 :]:
                i, j = s.ties[f, g]
                r[g] = r[g] - _sum_at(j, _times(self.across[f, g].transpose(0, 2, 1), out[f][i]), s.levels[g])
            flat, at = out[f].reshape(-1, m), 0
            for strip in self._kept(f):
                bottom = bottom - strip.T @ flat[at : at + len(strip)]
                at += len(strip)
        return out, np.linalg.solve(self.triangle, bottom) if s.dense else bottom

    @staticmethod
    def squares(forward) -> np.ndarray:
        single, bottom = forward
        return bottom.T @ bottom + sum(np.einsum("kqa,kqb->ab", a, a) for a in single.values())

    def solve(self, right: list[np.ndarray]) -> list[np.ndarray]:
        """L (L'Z'ZL + I)^-1 L' times the right sides, by term."""
        s = self.s
        single, bottom = self.forward(right)
        m, u = bottom.shape[1], {}
        bottom = np.linalg.solve(self.triangle.T, bottom) if s.dense else bottom
        for f in s.dense:
            n = s.levels[f] * s.widths[f]
            u[f] = bottom[s.at[f] : s.at[f] + n].reshape(s.levels[f], s.widths[f], m)
        for f in reversed(s.single):
            rest = single[f]
            for (a, g), w in self.across.items():
                if a == f:
                    i, j = s.ties[f, g]
                    rest = rest - _sum_at(i, _times(w, u[g][j]), s.levels[f])
            u[f] = np.linalg.solve(self.own[f].transpose(0, 2, 1), rest)
        return [low @ u[f] for f, low in enumerate(self.lows)]
