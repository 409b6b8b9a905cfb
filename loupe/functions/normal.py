"""The normal distribution as column expressions.

Public approximations: W. J. Hart's rational form of the cumulative
distribution (double precision) and P. J. Acklam's inverse, sharpened by one
Halley step.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Hart's coefficients, highest power first.
HART_TOP = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
HART_BOTTOM = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
# Acklam's coefficients, highest power first.
ACKLAM_A = [
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
]
ACKLAM_B = [
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
]
ACKLAM_C = [
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]


def _horner(x: Column, coefficients: list[float]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def normal_cdf(z: Column) -> Column:
    """P(Z <= z)."""
    a = F.abs(z)
    density = F.exp(-a * a / 2)
    near = density * _horner(a, HART_TOP) / _horner(a, HART_BOTTOM)
    tail = a + F.lit(0.65)
    for k in (4, 3, 2, 1):
        tail = a + F.lit(float(k)) / tail
    upper = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(
        density / tail / F.lit(math.sqrt(2 * math.pi))
    )
    return F.when(z > 0, 1 - upper).otherwise(upper)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once; it is used in many places."""
    return F.transform(F.array(value), then)[0]


def normal_ppf(p: Column) -> Column:
    """The z with P(Z <= z) = p, for 0 < p < 1."""
    return _let(p, lambda p: _let(_acklam(p), lambda z: _sharpened(p, z)))


def _acklam(p: Column) -> Column:
    q = p - 0.5
    r = q * q
    middle = q * _horner(r, ACKLAM_A) / _horner(r, ACKLAM_B)
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    outer = _horner(t, ACKLAM_C) / _horner(t, ACKLAM_D)
    return F.when(F.abs(q) <= 0.5 - 0.02425, middle).otherwise(F.when(q < 0, outer).otherwise(-outer))


def _sharpened(p: Column, z: Column) -> Column:
    error = (normal_cdf(z) - p) * F.lit(math.sqrt(2 * math.pi)) * F.exp(z * z / 2)
    return F.when((p > 0) & (p < 1), z - error / (1 + z * error / 2))
