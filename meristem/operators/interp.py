"""Interpolation from neighbours, kernels and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import arg_max

_AGGREGATES = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "median": F.median}


def neighbour_aggregate(edges: DataFrame, values: DataFrame, queries: DataFrame, agg: str = "mean") -> DataFrame:
    """(id, value) for every query: an aggregate of its neighbours' values; ``mode`` breaks ties by the smaller value; none -> null."""
    each = edges.join(values.select(F.col("id").alias("dst"), "value"), "dst").where("value IS NOT NULL")
    if agg == "mode":
        counted = each.groupBy("src", "value").agg(F.count("*").alias("n"))
        got = arg_max(counted, ["src"], "n", "value").select("src", "value")
    else:
        got = each.groupBy("src").agg(_AGGREGATES[agg]("value").alias("value"))
    return queries.select("id").join(got.withColumnRenamed("src", "id"), "id", "left")


def kernel_weight(dist: Column, kernel: str, power: float = 2.0, sharp: float = 2.0, radius: float = 1.0, sigma2: float = 1.0) -> Column:
    """shepard 1 / d ** power, gaussian exp(-(sharp d / radius) ** 2), prob exp(-d ** 2 / 2 sigma2), linear 1."""
    return {
        "shepard": 1 / F.pow(F.greatest(dist, F.lit(1e-12)), F.lit(power)),
        "gaussian": F.exp(-F.pow(dist * sharp / radius, F.lit(2.0))),
        "prob": F.exp(-dist * dist / (2 * sigma2)),
        "linear": F.lit(1.0),
    }[kernel]


def kernel_mean(edges: DataFrame, values: DataFrame, kernel: str, **parameters: float) -> DataFrame:
    """(src, value): kernel-weighted mean of the neighbours' values."""
    w = kernel_weight(F.col("dist"), kernel, **parameters)
    each = edges.join(values.select(F.col("id").alias("dst"), "value"), "dst").withColumn("w", w)
    return each.groupBy("src").agg(F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w")).alias("value"))


def kernel_label(edges: DataFrame, labels: DataFrame, sigma2: float, least: float = 0.0, null_label: str = "_NONE") -> DataFrame:
    """(src, label, score): the label of largest kernel share, ``null_label`` below ``least``."""
    each = edges.join(labels.select(F.col("id").alias("dst"), F.col("label").cast("string").alias("label")), "dst").withColumn("w", kernel_weight(F.col("dist"), "prob", sigma2=sigma2))
    total = each.groupBy("src").agg(F.sum("w").alias("t"))
    share = each.groupBy("src", "label").agg(F.sum("w").alias("w")).join(total, "src").select("src", "label", F.try_divide(F.col("w"), F.col("t")).alias("score"))
    best = arg_max(share, ["src"], "score", "label")
    return best.withColumn("label", F.when(F.col("score") < least, F.lit(null_label)).otherwise(F.col("label")))


def grid_bins(points: DataFrame, bins: int, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """``points`` with a bin index and bin centre per axis, ``bins`` of equal width between the axis' bounds."""
    span = points.agg(*[f(a).alias(f"__{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))])
    out = points.crossJoin(F.broadcast(span))
    for a in axes:
        lo, width = F.col(f"__lo_{a}"), (F.col(f"__hi_{a}") - F.col(f"__lo_{a}")) / bins
        at = F.coalesce(F.least(F.floor(F.try_divide(F.col(a) - lo, width)), F.lit(bins - 1)), F.lit(0))
        out = out.withColumn(f"bin_{a}", at).withColumn(f"centre_{a}", lo + (F.col(f"bin_{a}") + 0.5) * width)
    return out.drop(*span.columns)


def grid_counts(binned: DataFrame, label: str, values: list, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Counts per bin, one column per label value."""
    return binned.groupBy(*[f"bin_{a}" for a in axes]).pivot(label, values).agg(F.count(F.lit(1))).na.fill(0)


def into_breaks(points: DataFrame, breaks: list[float], axis: str, extend: bool = False) -> DataFrame:
    """Index of the half-open interval of ``breaks`` that holds each value, null (or the end bins) outside."""
    at = sum((F.when(F.col(axis) >= b, 1).otherwise(0) for b in breaks), F.lit(0)) - 1
    last = len(breaks) - 2
    at = F.greatest(F.lit(0), F.least(F.lit(last), at)) if extend else F.when((at >= 0) & ((at <= last) | (F.col(axis) == breaks[-1])), F.least(at, F.lit(last)))
    return points.withColumn(f"bin_{axis}", at)


def mesh_grid(spark, ranges: dict[str, tuple[float, float, int]]) -> DataFrame:
    """Centres of a regular grid: (lo, hi, bins) per axis."""
    out = None
    for a, (lo, hi, n) in ranges.items():
        axis = spark.range(n).select((F.lit(lo) + (F.col("id") + 0.5) * ((hi - lo) / n)).alias(a))
        out = axis if out is None else out.crossJoin(axis)
    return out


def voxel_down_sample(points: DataFrame, size: float, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """One mean point per occupied voxel, with its count."""
    cells = [F.floor(F.col(a) / size).alias(f"v_{a}") for a in axes]
    return points.groupBy(*cells).agg(*[F.avg(a).alias(a) for a in axes], F.count("*").alias("n"))


def hashed_subset(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` points chosen by a hash of their id: the same at every run and partitioning."""
    return points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)


def inside_mesh(points: DataFrame, triangles: DataFrame, cell: float) -> DataFrame:
    """``points`` (id, x, y, z) that lie inside a closed mesh of ``triangles`` (tri, x0..z2), by ray parity along z. Points meet only
    triangles whose xy box covers their grid cell."""
    lo = lambda a: F.floor(F.least(*[F.col(f"{a}{i}") for i in range(3)]) / cell)
    hi = lambda a: F.floor(F.greatest(*[F.col(f"{a}{i}") for i in range(3)]) / cell)
    boxed = triangles.withColumn("cx", F.explode(F.sequence(lo("x"), hi("x")))).withColumn("cy", F.explode(F.sequence(lo("y"), hi("y"))))
    placed = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    c = F.col
    d = (c("y1") - c("y2")) * (c("x0") - c("x2")) + (c("x2") - c("x1")) * (c("y0") - c("y2"))
    a = F.try_divide((c("y1") - c("y2")) * (c("x") - c("x2")) + (c("x2") - c("x1")) * (c("y") - c("y2")), d)
    b = F.try_divide((c("y2") - c("y0")) * (c("x") - c("x2")) + (c("x0") - c("x2")) * (c("y") - c("y2")), d)
    hit = placed.join(boxed, ["cx", "cy"]).withColumn("__a", a).withColumn("__b", b)
    above = (c("__a") * c("z0") + c("__b") * c("z1") + (1 - c("__a") - c("__b")) * c("z2")) > c("z")
    odd = hit.where((c("__a") >= 0) & (c("__b") >= 0) & (c("__a") + c("__b") <= 1) & above).groupBy("id").agg(F.count("*").alias("n")).where("n % 2 = 1").select("id")
    return points.join(odd, "id", "left_semi")


def density(points: DataFrame, queries: DataFrame, reach: float, bandwidth: float) -> DataFrame:
    """(id, density): Gaussian kernel density at each query, over points within ``reach``, scaled to [0, 1]."""
    from .neighbors import kernel_sums

    raw = kernel_sums(queries, points, reach, bandwidth)
    every = queries.select(F.col("id")).join(raw.withColumnRenamed("src", "id"), "id", "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    span = every.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return every.crossJoin(F.broadcast(span)).select("id", F.coalesce(F.try_divide(F.col("d") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)).alias("density"))


def voxel_label(points: DataFrame, voxels: DataFrame, space: dict[str, float]) -> DataFrame:
    """``points`` with the label of the nearest voxel of a regular grid (integer indices and ``label``), null outside."""
    axes = list(space)
    at = points.withColumns({f"__{a}": F.round(F.col(a) / space[a]).cast("long") for a in axes})
    cells = voxels.select(*[F.col(a).cast("long").alias(f"__{a}") for a in axes], "label")
    return at.join(cells, [f"__{a}" for a in axes], "left").drop(*[f"__{a}" for a in axes])


def pixels(images: DataFrame, column: str = "image", threshold: float = 0.0) -> DataFrame:
    """(id, row, col, value) of a nested array column's entries above ``threshold``."""
    rows = images.select("id", F.posexplode(column).alias("row", "__r"))
    return rows.select("id", "row", F.posexplode("__r").alias("col", "value")).where(F.col("value") > threshold)


def widened_bins(points: DataFrame, breaks: list[float], axis: str = "z", least: int = 100, grow: float = 0.05) -> list[tuple[float, float]]:
    """Intervals between ``breaks``, each widened by ``grow`` of its span until it holds ``least`` points; counts come from one
    aggregate per round for all intervals."""
    spans = [(a, b) for a, b in zip(breaks, breaks[1:], strict=False)]
    total = points.count()
    while True:
        counts = points.agg(*[F.count_if(F.col(axis).between(a, b)).alias(str(k)) for k, (a, b) in enumerate(spans)]).first()
        short = [k for k in range(len(spans)) if counts[k] < min(least, total)]
        if not short:
            return spans
        for k in short:
            a, b = spans[k]
            pad = max((b - a) * grow, 1e-9)
            spans[k] = (a - pad, b + pad)


def displaced(points: DataFrame, field: DataFrame, step: float, axes: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Points minus a displacement field (i, j, u, v on a grid of ``step``), bilinear between the four grid nodes."""
    i, j = (F.floor(F.col(a) / step) for a in axes)
    fx, fy = (F.col(a) / step - F.floor(F.col(a) / step) for a in axes)
    corners = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (0, 1) for q in (0, 1)]))
    near = points.select("*", fx.alias("__fx"), fy.alias("__fy"), i.alias("__i"), j.alias("__j"), corners.alias("__c"))
    near = near.withColumns({"i": F.col("__i") + F.col("__c.p"), "j": F.col("__j") + F.col("__c.q")}).join(field, ["i", "j"], "left")
    w = F.when(F.col("__c.p") == 1, F.col("__fx")).otherwise(1 - F.col("__fx")) * F.when(F.col("__c.q") == 1, F.col("__fy")).otherwise(1 - F.col("__fy"))
    moved = near.groupBy("id").agg(F.sum(w * F.coalesce("u", F.lit(0.0))).alias("__u"), F.sum(w * F.coalesce("v", F.lit(0.0))).alias("__v"))
    return points.join(moved, "id").withColumns({axes[0]: F.col(axes[0]) - F.col("__u"), axes[1]: F.col(axes[1]) - F.col("__v")}).drop("__u", "__v")
