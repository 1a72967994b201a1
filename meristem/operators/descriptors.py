"""Point descriptors: fast point feature histograms in long form, by two joins over neighbour edges, all in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vector = list[Column]


def _dot(a: Vector, b: Vector) -> Column:
    return sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))


def facing(points: DataFrame, normals: DataFrame, viewpoint: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(id, nx, ny, nz): normals turned towards ``viewpoint``."""
    both = normals.join(points.select("id", "x", "y", "z"), "id")
    n, p = [F.col(c) for c in ("nx", "ny", "nz")], [F.col(c) for c in "xyz"]
    side = F.when(_dot(n, [F.lit(float(v)) - q for v, q in zip(viewpoint, p, strict=True)]) < 0, -1.0).otherwise(1.0)
    return both.select("id", *[(c * side).alias(name) for c, name in zip(n, ("nx", "ny", "nz"), strict=True)])


def pair_bins(points: DataFrame, edges: DataFrame, bins: int = 11, eps: float = 1e-10) -> DataFrame:
    """(src, dst, dist, bins): the bins that an edge's three angles fall in. ``points`` have id, x, y, z and unit normals nx, ny, nz;
    edges shorter than ``eps`` are left out.

    Angles: between the edge and the neighbour's normal, the edge and the centre's normal (both by cosine), and the turn of
    the neighbour's normal around the axis that the centre's normal and the edge span. The three take bins 0 to n - 1, n to
    2 n - 1 and 2 n to 3 n - 1.
    """
    at = lambda side: points.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("x", "y", "z", "nx", "ny", "nz")])
    both = edges.where(F.col("dist") >= eps).select("src", "dst", "dist").join(at("src"), "src").join(at("dst"), "dst")
    of = lambda side, names: [F.col(f"{side}_{c}") for c in names]
    place, normal = ("x", "y", "z"), ("nx", "ny", "nz")
    step = [(b - a) / F.col("dist") for a, b in zip(of("src", place), of("dst", place), strict=True)]
    own, other = of("src", normal), of("dst", normal)
    axis = [own[(i + 1) % 3] * step[(i + 2) % 3] - own[(i + 2) % 3] * step[(i + 1) % 3] for i in range(3)]
    width = F.sqrt(_dot(axis, axis))
    turn = F.when(width > eps, F.atan2(_dot(other, axis) / width, _dot(other, own))).otherwise(0.0)
    shares = [(_dot(step, other) + 1) / 2, (_dot(step, own) + 1) / 2, (turn + math.pi) / (2 * math.pi)]
    found = [F.least(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(s, 9))) * bins), F.lit(bins - 1)) + k * bins for k, s in enumerate(shares)]
    return both.select("src", "dst", "dist", F.array(*found).alias("bins"))


def simple_histograms(found: DataFrame) -> DataFrame:
    """(id, bin, share): for each angle, the share of a point's edges in each bin; empty bins are absent."""
    each = found.select(F.col("src").alias("id"), F.explode("bins").alias("bin")).groupBy("id", "bin").agg(F.count("*").alias("n"))
    whole = found.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("all"))
    return each.join(whole, "id").select("id", "bin", (F.col("n") / F.col("all")).alias("share"))


def feature_histograms(points: DataFrame, edges: DataFrame, bins: int = 11, eps: float = 1e-10) -> DataFrame:
    """(id, bin, value): a point's histogram plus the mean of its neighbours' weighted by 1 / distance, scaled to sum one.
    Bins without a value are absent, and so are points without an edge of at least ``eps``."""
    found = pair_bins(points, edges, bins, eps)
    simple = simple_histograms(found)
    weight = found.groupBy(F.col("src").alias("id")).agg(F.sum(1 / F.col("dist")).alias("weight"))
    lent = found.select("src", F.col("dst").alias("id"), "dist").join(simple, "id")
    lent = lent.groupBy(F.col("src").alias("id"), "bin").agg(F.sum(F.col("share") / F.col("dist")).alias("lent")).join(weight, "id")
    both = simple.select("id", "bin", F.col("share").alias("value")).unionAll(lent.select("id", "bin", F.col("lent") / F.col("weight")))
    both = both.groupBy("id", "bin").agg(F.sum("value").alias("value"))
    total = both.groupBy("id").agg(F.sum("value").alias("total"))
    return both.join(total, "id").select("id", "bin", (F.col("value") / F.col("total")).alias("value"))
