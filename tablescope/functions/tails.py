"""Tail probabilities for test results: small numpy helpers applied to result rows, never to data rows."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def gamma_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(s, x)."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        k = s
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - scale * total
    b = x + 1.0 - s
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - s)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return scale * h


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2.0, x / 2.0)


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def t_critical(df: float, level: float = 0.95) -> float:
    """The t value with `level` of the mass between -t and t (bisection on the tail)."""
    lo, hi = 0.0, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if t_two_sided(mid, df) > 1.0 - level else (lo, mid)
    return (lo + hi) / 2.0


def _over(fn, *series: pd.Series) -> pd.Series:
    out = []
    for args in zip(*series):
        ok = all(a is not None and not (isinstance(a, float) and math.isnan(a)) for a in args)
        out.append(float(fn(*(float(a) for a in args))) if ok else None)
    return pd.Series(out, dtype="object").astype("Float64")


@F.pandas_udf(T.DoubleType())
def _t_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _over(lambda a, b: t_two_sided(a, b) if b > 0 else np.nan, t, df)


@F.pandas_udf(T.DoubleType())
def _f_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _over(f_upper, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def _chi_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _over(chi2_upper, x, df)


@F.pandas_udf(T.DoubleType())
def _tcrit_udf(df: pd.Series) -> pd.Series:
    return _over(t_critical, df)


def p_t(t: Column, df: Column) -> Column:
    return _t_udf(t.cast("double"), df.cast("double"))


def p_f(f: Column, d1: Column, d2: Column) -> Column:
    return _f_udf(f.cast("double"), d1.cast("double"), d2.cast("double"))


def p_chi2(x: Column, df: Column) -> Column:
    return _chi_udf(x.cast("double"), df.cast("double"))


def t_crit(df: Column) -> Column:
    return _tcrit_udf(df.cast("double"))
