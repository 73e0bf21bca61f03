"""Student-t, normal and chi-square tails for result rows.

The statistics themselves are aggregated by Spark; these vectorised helpers only turn a handful of
finished numbers into probabilities.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > TINY else TINY)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > TINY else TINY)
            c = 1.0 + num / c
            c = c if abs(c) > TINY else TINY
            step = c * d
            h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    if not (df > 0) or math.isnan(t):
        return math.nan
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def t_quantile(p: float, df: float) -> float:
    """Upper quantile by bisection of the two-sided tail; p between 0.5 and 1."""
    if not (df > 0):
        return math.nan
    lo, hi = 0.0, 1.0
    target = 2 * (1 - p)
    while t_two_sided(hi, df) > target:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > target else (lo, mid)
    return (lo + hi) / 2


def chi2_upper(x: float, k: float) -> float:
    """Upper tail of the chi-square distribution: regularised upper incomplete gamma."""
    if not (k > 0) or math.isnan(x):
        return math.nan
    if x <= 0:
        return 1.0
    a, z = k / 2, x / 2
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= z / n
            total += term
        return 1.0 - front * total
    b = z + 1 - a
    c, d = 1 / TINY, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > TINY else TINY)
        c = b + an / c
        c = c if abs(c) > TINY else TINY
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def _vector(fn):
    def run(x: pd.Series, k: pd.Series) -> pd.Series:
        ok = x.notna() & k.notna()
        out = np.full(len(x), np.nan)
        out[ok.to_numpy()] = [fn(float(a), float(b)) for a, b in zip(x[ok], k[ok])]
        return pd.Series(out)

    return F.pandas_udf(run, DoubleType())


t_p_value = _vector(t_two_sided)
t_upper_quantile = _vector(t_quantile)
chi2_p_value = _vector(chi2_upper)
