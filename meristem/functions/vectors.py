"""Column expressions over ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    """Sum of an array."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a norm is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def centred(a: Column) -> Column:
    return F.transform(a, lambda x: x - mean(a))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays from their sums; null where one is constant."""
    n = F.size(a).cast("double")
    sx, sy = total(a), total(b)
    cov = dot(a, b) - sx * sy / n
    return F.try_divide(cov, F.sqrt(dot(a, a) - sx * sx / n) * F.sqrt(dot(b, b) - sy * sy / n))


def unit(a: Column) -> Column:
    """Scaled to length one; a zero vector stays."""
    # The length is a field of its own: within the inner function it would be computed again for each entry.
    held = F.array(F.struct(a.alias("a"), norm(a).alias("n")))
    return F.transform(held, lambda s: F.transform(s["a"], lambda x: x / F.when(s["n"] == 0, 1.0).otherwise(s["n"])))[0]


def weighted_pearson(x: Column, y: Column, w: Column) -> Column:
    """Weighted correlation, as an aggregate; null where a side doesn't vary."""
    n, mx, my = F.sum(w), F.sum(w * x), F.sum(w * y)
    cov = F.sum(w * x * y) / n - mx * my / (n * n)
    return F.try_divide(cov, F.sqrt((F.sum(w * x * x) / n - mx * mx / (n * n)) * (F.sum(w * y * y) / n - my * my / (n * n))))


def zscore(a: Column, sample: bool = False) -> Column:
    """Row z-scores with the population deviation unless ``sample``; constant rows become zero."""
    m = mean(a)
    spread = F.sqrt(total(F.transform(a, lambda x: (x - m) * (x - m))) / (F.size(a) - (1 if sample else 0)))
    return F.transform(a, lambda x: (x - m) / F.when(spread == 0, 1.0).otherwise(spread))


def kl(p: Column, q: Column, eps: float = 1e-10) -> Column:
    """Kullback-Leibler divergence of two arrays, each normalised to sum one first."""
    sp, sq = total(p), total(q)
    return total(F.zip_with(p, q, lambda x, y: (x / sp) * F.ln((x / sp + eps) / (y / sq + eps))))


def js(p: Column, q: Column, eps: float = 1e-10) -> Column:
    """Jensen-Shannon divergence."""
    sp, sq = total(p), total(q)
    mid = F.zip_with(p, q, lambda x, y: (x / sp + y / sq) / 2)
    return (kl(p, mid, eps) + kl(q, mid, eps)) / 2


def clip(x: Column, lo: Column | float, hi: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_col(lo), F.least(as_col(hi), x))
