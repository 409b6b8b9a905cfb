"""Tail probabilities for small result tables.

Tests leave a handful of rows; their p-values need the incomplete beta and
gamma functions, which Spark lacks.  They run as Pandas UDFs on those rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F

_TINY = 1e-300


def _nonzero(x: float) -> float:
    return x if abs(x) > _TINY else _TINY


def beta_regularised(x: float, a: float, b: float) -> float:
    """I_x(a, b), by Lentz's evaluation of the continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_regularised(1 - x, b, a)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    c, d = 1.0, 1 / _nonzero(1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 / _nonzero(1 + term * d)
            c = _nonzero(1 + term / c)
            value *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * value


def gamma_upper(a: float, x: float) -> float:
    """Q(a, x), the regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # series for the lower part
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - scale * total)
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / _nonzero(b)
    value = d
    for i in range(1, 10_000):
        b += 2
        step = -i * (i - a)
        d = 1 / _nonzero(step * d + b)
        c = _nonzero(b + step / c)
        value *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return scale * value


def t_tail(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return 0.0 if math.isinf(t) else beta_regularised(df / (df + t * t), df / 2, 0.5)


def f_tail(f: float, d1: float, d2: float) -> float:
    return 0.0 if math.isinf(f) else beta_regularised(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def chi2_tail(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def kolmogorov_tail(d: float, n: float) -> float:
    """Asymptotic p of the Kolmogorov-Smirnov statistic (Stephens' correction)."""
    lam = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if lam < 0.2:
        return 1.0
    total = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    return min(1.0, max(0.0, total))


def _on_rows(tail, *arguments: Column) -> Column:
    @F.pandas_udf("double")
    def p_value(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(
            [None if any(pd.isna(v) for v in row) else tail(*map(float, row)) for row in frame.itertuples(index=False)],
            dtype="float64",
        )

    return p_value(F.struct(*[a.cast("double").alias(f"a{i}") for i, a in enumerate(arguments)]))


def t_p(t: Column, df: Column) -> Column:
    return _on_rows(t_tail, t, df)


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    return _on_rows(f_tail, f, d1, d2)


def chi2_p(x: Column, df: Column) -> Column:
    return _on_rows(chi2_tail, x, df)


def kolmogorov_p(d: Column, n: Column) -> Column:
    return _on_rows(kolmogorov_tail, d, n)
