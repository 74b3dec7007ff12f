"""Normal, Student-t and Kolmogorov tails as column expressions.

Spark SQL has no error function, so the normal integral is a rational
approximation; the coefficients are published values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numerator and denominator of the double-precision normal tail
# (Hart 1968, as published by West 2005) and of the inverse normal (Acklam).
TAIL_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
INV_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
INV_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
INV_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
INV_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal_cdf(x: Column) -> Column:
    z = F.abs(x)
    near = F.exp(-z * z / 2) * _poly(TAIL_NUM, z) / _poly(TAIL_DEN, z)
    far = normal_pdf(z) / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65)))))
    tail = F.when(z > 37, 0.0).when(z < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_quantile(p: Column) -> Column:
    """Inverse normal, relative error about 1e-9."""
    low = 0.02425
    edge = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _poly(INV_C, edge) / _poly(INV_D, edge)
    c = p - 0.5
    centre = c * _poly(INV_A, c * c) / _poly(INV_B, c * c)
    return F.when(p < low, tail).when(p > 1 - low, -tail).otherwise(centre)


def kolmogorov_tail(statistic: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value of the two-sample statistic."""
    lam = statistic * F.sqrt(n1 * n2 / (n1 + n2))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    return F.when(lam < 0.2, 1.0).otherwise(F.least(F.greatest(2 * series, F.lit(0.0)), F.lit(1.0)))


def student_tail(t: Column, df: Column, steps: int = 400) -> Column:
    """Two-sided Student-t p-value.

    Uses p = 1 - I(theta) with I the integral of cos^(df-1) over
    [-theta, theta], theta = atan(|t|/sqrt(df)), by Simpson's rule on a fixed
    grid.  The power is taken through the logarithm of 1 - 2 sin^2(x/2), which
    keeps its digits for any number of degrees of freedom.
    """
    bound = F.atan(F.abs(t) / F.sqrt(df))
    # the integrand is concentrated within a few 1/sqrt(df) of zero
    upper = F.least(bound, 12.0 / F.sqrt(df))

    def simpson(limit: Column) -> Column:
        h = limit / steps
        return (
            F.aggregate(
                F.sequence(F.lit(0), F.lit(steps)),
                F.lit(0.0),
                lambda s, i: s
                + F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
                * F.exp((df - 1) * F.log1p(F.greatest(-2 * F.pow(F.sin(h * i / 2), F.lit(2.0)), F.lit(-1 + 1e-15)))),
            )
            * h
            / 3
        )

    whole = simpson(F.least(F.lit(math.pi / 2), 12.0 / F.sqrt(df)))
    return F.greatest(1 - simpson(upper) / whole, F.lit(0.0))


def gaussian_crps(y: Column, mu: Column, sigma: Column) -> Column:
    z = (y - mu) / sigma
    return sigma * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / math.sqrt(math.pi))


def gaussian_nll(y: Column, mu: Column, variance: Column, floor: float = 1e-9) -> Column:
    v = variance + floor
    return 0.5 * (F.log(2 * math.pi * v) + (y - mu) * (y - mu) / v)


def bias_corrected_skew(g1: Column, n: Column) -> Column:
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def bias_corrected_kurtosis(g2: Column, n: Column) -> Column:
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
