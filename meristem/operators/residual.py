"""Regularised count models: trend-based gene selection, negative-binomial residuals, batch effects."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.special import digamma, trigamma
from ..plans import settled
from .preprocess import variance_with_zeros


def local_quadratic(x: np.ndarray, y: np.ndarray, span: float = 0.3, count: np.ndarray | None = None) -> np.ndarray:
    """Local quadratic regression with tricube weights at every x, over the share ``span`` of nearest rows.

    Rows of equal x are one row of their mean y and number, ``count`` if x is given so: the work grows with the distinct x."""
    u, back = np.unique(x, return_inverse=True)
    each = np.ones(len(x)) if count is None else np.asarray(count, float)
    number = np.bincount(back, each, len(u))
    mean, upto = np.bincount(back, each * y, len(u)) / number, np.cumsum(number)
    q = min(max(4, int(math.ceil(span * number.sum()))), number.sum())
    out = np.empty(len(u))
    for k in range(len(u)):
        # The window's reach is the distance of the q-th nearest row; what lies at it has next to no weight.
        d = np.abs(u - u[k])
        order = np.argsort(d, kind="stable")
        reach = d[order[np.searchsorted(np.cumsum(number[order]), q)]]
        lo, hi = np.searchsorted(d[: k + 1][::-1], reach, "right"), np.searchsorted(d[k:], reach, "right")
        px, py = u[k + 1 - lo : k + hi], mean[k + 1 - lo : k + hi]
        w = ((1 - np.minimum(1, np.abs(px - u[k]) / max(reach, 1e-12)) ** 3) ** 3 + 1e-9) * number[k + 1 - lo : k + hi]
        a = np.column_stack([np.ones(len(px)), px - u[k], (px - u[k]) ** 2]) * np.sqrt(w)[:, None]
        out[k] = np.linalg.lstsq(a, py * np.sqrt(w), rcond=None)[0][0]
    return out[back]


def trend_variable_genes(expr: DataFrame, n_cells: int, n_top: int, span: float = 0.3) -> DataFrame:
    """(gene, mean, variance, variance_norm, rank): variance of counts standardised by a trend of log variance on log mean, clipped at
    sqrt(N). The trend is fitted on the distinct means, a row of each on the driver; the clipped sums are one more pass over stored entries."""
    spark = expr.sparkSession
    m = settled(variance_with_zeros(expr, n_cells).withColumn("variance", F.col("variance") * n_cells / (n_cells - 1)).where("variance > 0"))
    at = m.groupBy("mean").agg(F.count("*").alias("n"), F.avg(F.log10("variance")).alias("y")).orderBy("mean").toArrow()
    x, n, y = (at.column(c).to_numpy() for c in ("mean", "n", "y"))
    fit = local_quadratic(np.log10(x), y, span, n) if len(x) else np.zeros(0)
    trend = spark.createDataFrame(pa.table({"mean": pa.array(x, pa.float64()), "sd": pa.array(np.sqrt(10**fit), pa.float64())}))
    genes = m.select("gene", "mean", "variance").join(F.broadcast(trend) if len(x) < 100_000 else trend, "mean")
    top = float(n_cells) ** 0.5
    clipped = F.least(F.col("value"), F.col("sd") * top + F.col("mean"))
    s = expr.join(genes, "gene").groupBy("gene").agg(F.sum(clipped).alias("s"), F.sum(clipped * clipped).alias("q"), F.first("mean").alias("mean"), F.first("variance").alias("variance"), F.first("sd").alias("sd"))
    norm = (n_cells * F.col("mean") ** 2 + F.col("q") - 2 * F.col("s") * F.col("mean")) / ((n_cells - 1) * F.col("sd") ** 2)
    scored = s.select("gene", "mean", "variance", norm.alias("variance_norm")).orderBy(F.desc("variance_norm"), "gene").limit(n_top)
    return scored.withColumn("rank", F.row_number().over(W.orderBy(F.desc("variance_norm"), "gene")) - 1)


def theta_by_likelihood(y: np.ndarray, mu: np.ndarray, rounds: int = 10) -> float:
    """Negative-binomial dispersion by Newton steps on the likelihood."""
    theta = len(y) / max(float(((y / mu - 1) ** 2).sum()), 1e-9)
    for _ in range(rounds):
        theta = min(max(theta, 1e-4), 1e6)
        score = sum(digamma(theta + v) for v in y) - len(y) * digamma(theta) + float((np.log(theta) + 1 - np.log(theta + mu) - (y + theta) / (mu + theta)).sum())
        info = -sum(trigamma(theta + v) for v in y) + len(y) * trigamma(theta) - float((1 / theta - 2 / (mu + theta) + (y + theta) / (mu + theta) ** 2).sum())
        step = score / info if abs(info) > 1e-12 else 0.0
        theta += step
        if abs(step) < 1e-6:
            break
    return float(min(max(theta, 1e-4), 1e6))


def regression_residuals(expr: DataFrame, n_cells: int, bandwidth: float = 0.3) -> DataFrame:
    """(cell, gene, residual) of stored entries: per-gene Poisson regression on log10 cell totals and dispersion, both smoothed over log
    gene means, then Pearson residuals, negatives zeroed, clipped at sqrt(N / 30)."""
    spark = expr.sparkSession
    totals = expr.groupBy("cell").agg(F.log10(F.sum("value")).alias("u"))
    cells = totals.orderBy("cell").toPandas()  # one number per cell; its size is the number of cells
    index = {c: k for k, c in enumerate(cells["cell"])}
    u = cells["u"].to_numpy()
    kind = expr.schema["gene"].dataType.simpleString()

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        y = np.zeros(len(u))
        y[[index[c] for c in frame["cell"]]] = frame["value"].to_numpy(float)
        x = np.column_stack([np.ones(len(u)), u])
        b = np.array([math.log(max(y.mean(), 1e-9)), 0.0])
        for _ in range(25):
            mu = np.exp(np.clip(x @ b, -30, 30))
            step = np.linalg.lstsq(x.T @ (x * mu[:, None]) + 1e-9 * np.eye(2), x.T @ (y - mu), rcond=None)[0]
            b = b + step
            if np.abs(step).max() < 1e-8:
                break
        theta = theta_by_likelihood(y, np.maximum(np.exp(np.clip(x @ b, -30, 30)), 1e-9))
        return pd.DataFrame({"gene": [frame["gene"].iloc[0]], "b0": [b[0]], "b1": [b[1]], "lt": [math.log10(theta)], "lm": [math.log10(math.exp(np.log(y + 1).mean()) - 1 + 1e-9)]})

    fits = expr.groupBy("gene").applyInPandas(fit, f"gene {kind}, b0 double, b1 double, lt double, lm double").orderBy("gene").toPandas()
    if len(fits):
        at = fits["lm"].to_numpy()
        w = np.exp(-0.5 * ((at[:, None] - at[None]) / bandwidth) ** 2)
        for c in ("b0", "b1", "lt"):
            fits[c] = w @ fits[c].to_numpy() / w.sum(axis=1)
    smooth = spark.createDataFrame(fits, f"gene {kind}, b0 double, b1 double, lt double, lm double")
    mu = F.exp(F.col("b0") + F.col("b1") * F.col("u"))
    r = (F.col("value") - mu) / F.sqrt(mu + mu * mu / F.pow(F.lit(10.0), F.col("lt")))
    top = (n_cells / 30) ** 0.5
    return expr.join(smooth, "gene").join(totals, "cell").select("cell", "gene", F.least(F.lit(top), F.greatest(F.lit(0.0), r)).alias("residual"))


def centre_batches(expr: DataFrame, batches: DataFrame, shrink: float = 1.0) -> DataFrame:
    """(cell, gene, value): per-gene batch means shrunk towards the gene's mean by ``n / (n + shrink)`` and removed, batch spreads
    scaled to the gene's."""
    each = expr.join(batches, "cell")
    whole = each.groupBy("gene").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    part = each.groupBy("gene", "batch").agg(F.avg("value").alias("mb"), F.stddev_pop("value").alias("sb"), F.count("*").alias("n"))
    both = each.join(whole, "gene").join(part, ["gene", "batch"])
    k = F.col("n") / (F.col("n") + shrink)
    scale = F.coalesce(F.pow(F.try_divide("s", "sb"), k), F.lit(1.0))
    return both.select("cell", "gene", (F.col("m") + (F.col("value") - F.col("m") - k * (F.col("mb") - F.col("m"))) * scale).alias("value"))
