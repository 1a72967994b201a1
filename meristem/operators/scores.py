"""Scores of registered slice stacks over cross-slice edges; points have (id, grp, x, y, vec): slice, place and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors
from .graphs import normals
from .neighbors import knn, shortest


def _flat(points: DataFrame) -> DataFrame:
    return points.select("id", "grp", F.array("x", "y").alias("vec"))


def slice_edges(points: DataFrame, k: int = 8, steps: int = 1, share: float = 0.99) -> DataFrame:
    """(src, dst, dist): both-direction neighbours between slices up to ``steps`` apart, the shortest ``share`` of them."""
    flat = _flat(points)
    ahead = knn(flat, k=k, scope="next", steps=steps, exclude_self=False).select("src", "dst", "dist")
    back = knn(flat.withColumn("grp", -F.col("grp")), k=k, scope="next", steps=steps, exclude_self=False).select("src", "dst", "dist")
    return shortest(ahead.unionAll(back), share)


def weighted_edges(points: DataFrame, k: int = 8, feature_weight: float = 1.0) -> DataFrame:
    """(src, dst, w): neighbours in the next slice, weight exp(-dx2 / median - lambda df2 / median), medians per slice pair."""
    e = knn(_flat(points), k=k, scope="next", exclude_self=False)
    a = points.select(F.col("id").alias("src"), "grp", F.col("vec").alias("u"))
    b = points.select(F.col("id").alias("dst"), F.col("vec").alias("v"))
    both = e.join(a, "src").join(b, "dst").withColumn("dx2", F.col("dist") * F.col("dist")).withColumn("df2", F.pow(vectors.l2(F.col("u"), F.col("v")), F.lit(2.0)))
    pair = W.partitionBy("grp")
    both = both.withColumn("mx", F.median("dx2").over(pair)).withColumn("mf", F.median("df2").over(pair))
    return both.select("src", "dst", "grp", "dx2", "df2", F.exp(-F.try_divide("dx2", "mx") - feature_weight * F.try_divide("df2", "mf")).alias("w"))


def match_scores(edges: DataFrame, alpha: float = 0.5) -> DataFrame:
    """One row: mean spatial, feature and mixed similarity of edges (dx2, df2)."""
    sx, sf = F.exp(-F.col("dx2")), F.exp(-F.col("df2"))
    return edges.agg(F.avg(sx).alias("spatial"), F.avg(sf).alias("feature"), F.avg(F.pow(sx, F.lit(alpha)) * F.pow(sf, F.lit(1 - alpha))).alias("mixed"), F.count("*").alias("n"))


def smoothness(edges: DataFrame, n_points: int) -> DataFrame:
    """One row: sum of w * d2 per point for spatial and feature distances."""
    return edges.agg((F.sum(F.col("w") * F.col("dx2")) / n_points).alias("spatial"), (F.sum(F.col("w") * F.col("df2")) / n_points).alias("feature"))


def bending(points: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: weighted squared second difference of each point with its strongest partner on either side (reversed edges
    give the side before)."""
    def strongest(e: DataFrame, own: str, other: str, name: str) -> DataFrame:
        best = F.max_by(F.struct(F.col(other), F.col("w")), F.struct(F.col("w"), -F.col(other))).alias("b")
        return e.groupBy(F.col(own).alias("id")).agg(best).select("id", F.col(f"b.{other}").alias(name), F.col("b.w").alias(f"w_{name}"))

    sides = strongest(edges, "src", "dst", "after").join(strongest(edges, "dst", "src", "before"), "id")
    at = lambda name: points.select(F.col("id").alias(name), F.col("x").alias(f"x_{name}"), F.col("y").alias(f"y_{name}"))
    both = sides.join(points.select("id", "x", "y"), "id").join(at("after"), "after").join(at("before"), "before")
    bend = sum((F.pow(F.col(f"{a}_after") - 2 * F.col(a) + F.col(f"{a}_before"), F.lit(2.0)) for a in "xy"), F.lit(0.0))
    w = F.col("w_after") * F.col("w_before")
    return both.agg(F.try_divide(F.sum(w * bend), F.sum(w)).alias("bending"), F.count("*").alias("n"))


def normal_continuity(points: DataFrame, edges: DataFrame, k: int = 16) -> DataFrame:
    """One row: the mean of 1 - abs(cosine) between the normals of edges' ends (src, dst, w), weighted by w. A normal is the smallest
    principal direction of a point's ``k`` neighbours (itself among them) in its slice ``grp``; points have id, grp, x, y, z."""
    near = knn(points.select("id", "grp", F.array("x", "y", "z").alias("vec")), k=k, scope="within", exclude_self=False)
    n = normals(points, near)
    ends = edges.join(n.withColumnsRenamed({"id": "src", "nx": "ax", "ny": "ay", "nz": "az"}), "src").join(n.withColumnsRenamed({"id": "dst", "nx": "bx", "ny": "by", "nz": "bz"}), "dst")
    cosine = F.abs(F.col("ax") * F.col("bx") + F.col("ay") * F.col("by") + F.col("az") * F.col("bz"))
    return ends.agg(F.try_divide(F.sum(F.col("w") * (1 - cosine)), F.sum("w")).alias("score"), F.count("*").alias("n"))


def label_agreement(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: share of edges whose ends carry the same label."""
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("la")), labels.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
    return edges.join(a, "src").join(b, "dst").agg(F.avg((F.col("la") == F.col("lb")).cast("double")).alias("same"), F.count("*").alias("n"))


def feature_variance(posterior: DataFrame, fixed: DataFrame, moving: DataFrame, cosine: bool = False) -> DataFrame:
    """One row (tau2, mass): the variance per feature of fixed vectors (id, vec) about moving ones under a posterior (src, dst, p). With
    ``cosine`` vectors count as unit vectors."""
    both = posterior.join(fixed.select(F.col("id").alias("src"), F.col("vec").alias("u")), "src").join(moving.select(F.col("id").alias("dst"), F.col("vec").alias("v")), "dst")
    inner = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    u, v = F.col("u"), F.col("v")
    apart = 2 - 2 * inner(vectors.unit(u), vectors.unit(v)) if cosine else inner(u, u) - 2 * inner(u, v) + inner(v, v)
    return both.agg((F.sum(F.col("p") * apart) / (F.sum("p") * F.max(F.size("u")))).alias("tau2"), F.sum("p").alias("mass"))
