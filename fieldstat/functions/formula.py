"""Model formulas: ``val ~ a*b + (x|g) + (0+x|g) + (1|item)``."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERCEPT = "(Intercept)"


@dataclass(frozen=True)
class Random:
    terms: tuple[str, ...]  # with INTERCEPT if any
    group: str


@dataclass
class Formula:
    response: str | None
    fixed: list[str]  # terms such as "a", "a:b", INTERCEPT
    random: list[Random] = field(default_factory=list)

    @property
    def variables(self) -> list[str]:
        names = [v for t in [*self.fixed, *(x for r in self.random for x in r.terms)] if t != INTERCEPT for v in t.split(":")]
        return list(dict.fromkeys(names))


def _terms(text: str) -> list[str]:
    """Terms of a sum: ``a*b`` gives a, b and a:b; ``0`` or ``-1`` takes the intercept out."""
    out, intercept = [], True
    for raw in re.split(r"\+(?![^()]*\))", text.replace("-1", "+0").replace(" ", "")):
        if raw in ("", "1"):
            continue
        if raw == "0":
            intercept = False
            continue
        if not re.fullmatch(r"[A-Za-z_.][\w.]*([*:][A-Za-z_.][\w.]*)*", raw):
            raise ValueError(f"formula term {raw!r}")
        parts = raw.split("*")
        crossed = [p for k in range(1, 2 ** len(parts)) for p in [":".join(parts[i] for i in range(len(parts)) if k >> i & 1)]]
        out += sorted(crossed, key=lambda t: t.count(":"))
    return ([INTERCEPT] if intercept else []) + list(dict.fromkeys(out))


def parse(text: str) -> Formula:
    response, tilde, rest = text.partition("~")
    if not tilde:
        response, rest = "", text
    random = [Random(tuple(_terms(a)), b.strip()) for a, b in re.findall(r"\(([^()|]+)\|([^()|]+)\)", rest)]
    return Formula(response.strip() or None, _terms(re.sub(r"\([^()|]+\|[^()|]+\)", "", rest)), random)


def design(df: DataFrame, terms: list[str], factors: dict[str, list | None] | list[str] | None = None) -> dict[str, Column]:
    """Design columns by name. Factors (named, or strings) get treatment contrasts against their first level.

    ``factors`` is a dict to levels or None, or a list of names. Levels not given are the sorted distinct
    values, read once; a factor of more than 1000 levels is an error.
    """
    given = dict.fromkeys(factors) if isinstance(factors, list) else dict(factors or {})
    kinds = dict(df.dtypes)

    def parts(v: str) -> list[tuple[str, Column]]:
        if v in given or kinds[v] == "string":
            levels = given.get(v) or [r[0] for r in df.select(v).filter(F.col(v).isNotNull()).distinct().orderBy(v).limit(1001).collect()]
            if len(levels) > 1000:
                raise ValueError(f"factor {v} has more than 1000 levels")
            return [(f"{v}{x}", (F.col(v) == F.lit(x)).cast("double")) for x in levels[1:]]
        return [(v, F.col(v).cast("double"))]

    out: dict[str, Column] = {}
    for t in terms:
        if t == INTERCEPT:
            out[t] = F.lit(1.0)
            continue
        cols = [("", F.lit(1.0))]
        for v in t.split(":"):
            cols = [(f"{a}:{b}".strip(":"), x * y) for a, x in cols for b, y in parts(v)]
        out |= dict(cols)
    return out
