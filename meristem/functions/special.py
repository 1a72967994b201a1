"""Special functions and distribution quantiles in plain Python, for driver-side parameters and Arrow UDFs."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NORMAL = NormalDist()


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def digamma(x: float) -> float:
    """By recurrence to 10 and the asymptotic series."""
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + (1 / x) * y * (1 / 6 - y * (1 / 30 - y / 42))


def poisson_cdf(k: float, mu: float) -> float:
    if k < 0:
        return 0.0
    term, total = math.exp(-mu), 0.0
    for i in range(int(k) + 1):
        total += term
        term *= mu / (i + 1)
    return min(1.0, total)


def poisson_ppf(p: float, mu: float) -> float:
    """The least k whose cdf is at least ``p``."""
    if mu <= 0:
        return 0.0
    if mu > 500:  # the sum would underflow: search around the normal quantile by log terms
        k = max(0, int(mu + normal_ppf(p) * math.sqrt(mu)) - 20)
        total = sum(math.exp(i * math.log(mu) - mu - math.lgamma(i + 1)) for i in range(max(0, k - 400), k))
        while total < p and k < 10 * mu:
            total += math.exp(k * math.log(mu) - mu - math.lgamma(k + 1))
            k += 1
        return float(k - 1)
    term, total, k = math.exp(-mu), math.exp(-mu), 0
    while total < p and k < 100000:
        k += 1
        term *= mu / k
        total += term
    return float(k)


def negative_binomial_ppf(p: float, mean: float, variance: float) -> float | None:
    """Quantile from moments; null unless the variance exceeds the mean."""
    if variance <= mean or mean <= 0:
        return None
    q = mean / variance
    r = mean * q / (1 - q)
    total, k = 0.0, -1
    while total < p and k < 1_000_000:
        k += 1
        total += math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(q) + k * math.log1p(-q))
    return float(k)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        if i == 0:
            n = 1.0
        elif i % 2 == 0:
            n = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            n = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + n * d
        d = 1 / (d if abs(d) > 1e-30 else 1e-30)
        c = 1 + n / (c if abs(c) > 1e-30 else 1e-30)
        f *= c * d
        if abs(1 - c * d) < 1e-13:
            break
    return min(1.0, max(0.0, front * (f - 1)))


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_cdf(df / (df + t * t), df / 2, 0.5)
    return 1 - tail if t > 0 else tail


def hypergeometric_tail(k: int, population: int, marked: int, drawn: int) -> float:
    """P(at least ``k`` marked among ``drawn``)."""
    choose = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    base = choose(population, drawn)
    return min(1.0, sum(math.exp(choose(marked, i) + choose(population - marked, drawn - i) - base) for i in range(max(k, drawn - population + marked, 0), min(marked, drawn) + 1)))


@F.pandas_udf(T.DoubleType())
def _normal_sf(z: pd.Series) -> pd.Series:
    return pd.Series([0.5 * math.erfc(v / math.sqrt(2)) if v == v else np.nan for v in z.astype(float)])


def two_sided(z: Column) -> Column:
    """Two-sided normal p-value of a z column."""
    return F.least(F.lit(1.0), 2 * _normal_sf(F.abs(z)))


def upper_tail(z: Column) -> Column:
    """Upper normal tail of a z column."""
    return _normal_sf(z)
