"""Normal distribution, whose CDF is a series of columns as Spark has no erf, and Student's t."""
from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cdf(z: Column | str, steps: int = 120) -> Column:
    """Standard normal CDF by the all-positive series of the error function, each term x^2 / (n + 1/2) times the one
    before. 0 or 1 beyond 8 standard deviations, null for null and NaN."""
    z = F.nanvl(F.col(z) if isinstance(z, str) else z, F.lit(None).cast("double"))
    x2 = z * z / 2
    first = 2 * F.sqrt(x2 / math.pi) * F.exp(-x2)
    start = F.struct(first.alias("term"), first.alias("sum"))

    def add(s, n):
        term = s["term"] * x2 / (n + 0.5)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    erf = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, add, lambda s: s["sum"])
    return F.when(z > 8, 1.0).when(z < -8, 0.0).when(z.isNotNull(), 0.5 + 0.5 * F.signum(z) * F.least(erf, F.lit(1.0)))


@F.pandas_udf(T.DoubleType())
def ppf(p: pd.Series) -> pd.Series:
    inv = NormalDist().inv_cdf
    return p.map(lambda x: inv(x) if x is not None and 0 < x < 1 else None).astype("float64")


def ppf_scalar(p: float) -> float:
    return NormalDist().inv_cdf(p)


def expected_max_z(trials: int) -> float:
    """Expected largest of ``trials`` independent standard normals (Euler-Mascheroni mix)."""
    if trials <= 1:
        return 0.0
    g = 0.5772156649015329
    return (1 - g) * ppf_scalar(1 - 1 / trials) + g * ppf_scalar(1 - 1 / (trials * math.e))


# ---- Student's t --------------------------------------------------------------------------------
def log_gamma(z: Column) -> Column:
    """ln of the gamma function of a positive number: Stirling's series twelve steps up."""
    w = z + 12
    series = (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + 1 / (12 * w) - 1 / (360 * w * w * w) + 1 / (1260 * F.pow(w, 5)) - 1 / (1680 * F.pow(w, 7))
    for k in range(12):
        series = series - F.log(z + k)
    return series


def _beta_fraction(a: Column, b: Column, x: Column, steps: int) -> Column:
    """Continued fraction of the incomplete beta function, folded from the front with its two running ratios."""
    def ratio(state, term):
        d = 1 / (1 + term * state["d"])
        c = 1 + term / state["c"]
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"))

    def both(state, k):
        k = k.cast("double")
        even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        return ratio(ratio(state, even), odd)

    d = 1 / (1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, both, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column, steps: int = 300) -> Column:
    """Regularised I_x(a, b) for x strictly between 0 and 1; the fraction takes the side on which it converges fast."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    return F.when(x < (a + 1) / (a + b + 2), front * _beta_fraction(a, b, x, steps) / a).otherwise(1 - front * _beta_fraction(b, a, 1 - x, steps) / b)


def t_two_sided(t: Column, freedom: Column) -> Column:
    """Probability of a Student's t at least as far from 0."""
    x = freedom / (freedom + t * t)
    p = incomplete_beta(freedom / 2, F.lit(0.5), x)
    return F.when(t == 0, 1.0).when(x <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), p))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n pairs; null below three pairs, 0 for a perfect one."""
    t = r * F.sqrt((n - 2) / (1 - r * r))
    return F.when(n > 2, F.when(F.abs(r) >= 1, 0.0).otherwise(t_two_sided(t, (n - 2).cast("double"))))
