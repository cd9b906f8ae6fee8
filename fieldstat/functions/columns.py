"""Scalar functions as column expressions: everything stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keeps correlations off the poles of the inverse hyperbolic tangent.
NEAR_ONE = 1 - 1e-15


def fisher_z(r: Column) -> Column:
    """Inverse hyperbolic tangent of a correlation kept within +-(1 - 1e-15)."""
    return F.atanh(F.greatest(F.least(r, F.lit(NEAR_ONE)), F.lit(-NEAR_ONE)))


def clamp(x: Column, most: float) -> Column:
    return F.greatest(F.least(x, F.lit(float(most))), F.lit(-float(most)))


def nan_to_zero(x: Column) -> Column:
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero: the form in which results are compared."""
    return F.round(x, digits) + F.lit(0.0)


def corr_guarded(x: str, y: str) -> Column:
    """Pearson correlation; null for one row or where either side does not vary."""
    vx, vy = F.var_pop(x), F.var_pop(y)
    return F.when((F.count(x) > 1) & (vx > 0) & (vy > 0), F.covar_pop(x, y) / (F.sqrt(vx) * F.sqrt(vy)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def one_sample_t(x: str) -> Column:
    """Mean over its standard error; null for fewer than two values or none that vary."""
    sd = F.stddev_samp(x)
    return F.when((F.count(x) > 1) & (sd > 0), F.avg(x) / (sd / F.sqrt(F.count(x).cast("double"))))


def t_two_tailed(t: Column, df: Column) -> Column:
    """Two-tailed p of Student's t for whole degrees of freedom: the closed finite series in theta = atan(t / sqrt(df))."""
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    c2 = F.cos(theta) * F.cos(theta)
    odd = df % 2 == 1
    # terms k = 1..m, each the last times c2 * (2k) / (2k + 1) (odd) or c2 * (2k - 1) / (2k) (even)
    m = F.when(odd, (df - 3) / 2).otherwise((df - 2) / 2).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a, k):
        k = k.cast("double")
        term = a["term"] * c2 * F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    series = F.aggregate(F.when(m >= 1, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>")), start, step, lambda a: a["sum"])
    inside = F.when(odd, 2 / math.pi * (theta + F.when(df == 1, 0.0).otherwise(F.sin(theta) * F.cos(theta) * series))).otherwise(F.sin(theta) * series)
    return F.greatest(F.least(1 - inside, F.lit(1.0)), F.lit(0.0))


# Coefficients of the published rational approximations of the normal quantile (algorithm AS 241).
_A = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
_B = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
_C = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
_D = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
_E = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
_F = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function, for p strictly between 0 and 1; else null."""
    q = p - 0.5
    mid = 0.180625 - q * q
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    near, far = r - 1.6, r - 5
    tail = F.when(r <= 5, _poly(_C, near) / _poly(_D, near)).otherwise(_poly(_E, far) / _poly(_F, far))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * _poly(_A, mid) / _poly(_B, mid)).otherwise(F.signum(q) * tail))


def pol2cart(theta: Column, radius: Column, z: Column | None = None, radians: bool = True) -> list[Column]:
    """x, y (and z as it is) of polar coordinates."""
    a = theta if radians else F.radians(theta)
    out = [(radius * F.cos(a)).alias("x"), (radius * F.sin(a)).alias("y")]
    return out if z is None else [*out, z.alias("z")]


def divisors(n: Column) -> Column:
    """All divisors of a whole number from 1 on, ascending."""
    return F.filter(F.sequence(F.lit(1), n), lambda i: n % i == 0)


def average_rank(order: str, by: list[str]) -> Column:
    """Rank within ``by`` with ties at their average."""
    from pyspark.sql import Window

    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count("*").over(Window.partitionBy(*by, order)) - 1) / 2
