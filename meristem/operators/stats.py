"""Tests, corrections, marker tables and spatially variable genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import special
from ..plans import settled
from .neighbors import by_range, radius_sums, ranged
from .preprocess import minmax, variance_with_zeros


def bh_adjust(table: DataFrame, p: str = "p", by: list[str] | None = None, order: str = "id") -> DataFrame:
    """Benjamini-Hochberg ``q`` within ``by``: the reversed running minimum of p * n / rank, at most one, ties by ``order``. A null p has a
    null q and does not count. Without ``by`` ranks and minima come from sorted ranges, each a task."""
    if not by:
        placed, counts = ranged(table.where(F.col(p).isNotNull()), p, order)
        before, total = {}, 0
        for part, n in counts.items():
            before[part], total = total, total + n
        ranked = placed.withColumn("__step", F.col(p) * float(total) / (by_range(before, 0) + F.col("__place") + 1))
        later, least = {}, 1.0
        lowest = dict(ranked.groupBy("__part").agg(F.min("__step")).collect())
        for part in reversed(counts):
            later[part], least = least, min(least, lowest[part])
        down = W.partitionBy("__part").orderBy(F.desc("__place")).rowsBetween(W.unboundedPreceding, 0)
        out = ranked.withColumn("q", F.least(F.min("__step").over(down), by_range(later, 1.0))).select(*table.columns, "q")
        return out.unionAll(table.where(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))
    up = W.partitionBy(*by).orderBy(F.col(p).asc_nulls_last(), F.col(order).asc())
    whole = W.partitionBy(*by)
    down = W.partitionBy(*by).orderBy(F.col(p).desc(), F.col(order).desc()).rowsBetween(W.unboundedPreceding, 0)
    step = F.col(p) * F.count(p).over(whole) / F.row_number().over(up)
    q = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("__step").over(down)))
    return table.withColumn("__step", step).withColumn("q", q).drop("__step")


def bonferroni(table: DataFrame, p: str = "p", by: list[str] | None = None) -> DataFrame:
    return table.withColumn("q", F.least(F.lit(1.0), F.col(p) * F.count("*").over(W.partitionBy(*(by or [])))))


def mann_whitney(values: DataFrame, group_sizes: DataFrame | None = None) -> DataFrame:
    """(gene, grp, n1, n2, u, z): each group against the rest per gene over rows (gene, grp, value).

    With ``group_sizes`` (grp, n) values are sparse: absent rows are zeros, one block of ties, and stored values are positive.
    """
    ties = values.groupBy("gene", "value").agg(F.count("*").alias("t"))
    stored = ties.groupBy("gene").agg(F.sum("t").alias("stored"))
    if group_sizes is not None:
        total = group_sizes.agg(F.sum("n").alias("n"))
        zeros = stored.crossJoin(F.broadcast(total)).select("gene", (F.col("n") - F.col("stored")).alias("zeros"), "n")
    else:
        zeros = stored.select("gene", F.lit(0).cast("long").alias("zeros"), F.col("stored").alias("n"))
    before = W.partitionBy("gene").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    ranked = ties.join(zeros, "gene").withColumn("rank", F.coalesce(F.sum("t").over(before), F.lit(0)) + F.col("zeros") + (F.col("t") + 1) / 2)
    cube = lambda t: t * t * t - t
    spread = ranked.groupBy("gene").agg(F.max("n").alias("n"), F.max("zeros").alias("zeros"), F.sum(cube(F.col("t").cast("double"))).alias("ties"))
    spread = spread.withColumn("ties", F.col("ties") + cube(F.col("zeros").cast("double")))
    own = values.join(ranked.select("gene", "value", "rank"), ["gene", "value"]).groupBy("gene", "grp").agg(F.sum("rank").alias("r"), F.count("*").alias("seen"))
    own = own.join(spread, "gene")
    if group_sizes is not None:
        own = own.join(group_sizes.select("grp", F.col("n").alias("n1")), "grp")
        own = own.withColumn("r", F.col("r") + (F.col("n1") - F.col("seen")) * (F.col("zeros") + 1) / 2)
    else:
        own = own.withColumn("n1", F.col("seen"))
    n1, n = F.col("n1").cast("double"), F.col("n").cast("double")
    n2 = n - n1
    u = F.col("r") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.try_divide(F.abs(u - n1 * n2 / 2) - 0.5, sigma) * F.signum(u - n1 * n2 / 2)
    return own.where(n2 > 0).select("gene", "grp", F.col("n1").cast("long").alias("n1"), n2.cast("long").alias("n2"), u.alias("u"), z.alias("z"))


def log_mean(value: Column, n: Column, base: float = 2.0, offset: float = 1.0) -> Column:
    """log_base(mean(expm1(v)) + offset) over ``n`` cells, as an aggregate."""
    return F.ln(F.sum(F.expm1(value)) / n + offset) / F.ln(F.lit(base))


def group_summary(expr: DataFrame, cells: DataFrame, column: str = "norm") -> DataFrame:
    """(gene, grp, n, expm1_sum, positive): sums that markers need, zeros implied."""
    sizes = cells.groupBy("grp").agg(F.count("*").alias("n"))
    each = expr.join(cells, "cell").groupBy("gene", "grp").agg(F.sum(F.expm1(column)).alias("expm1_sum"), F.count_if(F.col(column) > 0).alias("positive"))
    genes = expr.select("gene").distinct()
    full = genes.crossJoin(F.broadcast(sizes)).join(each, ["gene", "grp"], "left")
    return full.select("gene", "grp", "n", F.coalesce("expm1_sum", F.lit(0.0)).alias("expm1_sum"), F.coalesce("positive", F.lit(0)).alias("positive"))


def markers(expr: DataFrame, cells: DataFrame, column: str = "norm", min_in: float = 0.005, min_lfc: float = 0.1, max_out: float = 1.0, only_positive: bool = False) -> DataFrame:
    """(gene, grp, lfc, pct_in, pct_out) of each group against the rest; the rest is total minus group, in one pass."""
    s = group_summary(expr, cells, column)
    whole = W.partitionBy("gene")
    total, hits, sum_ = F.sum("n").over(whole), F.sum("positive").over(whole), F.sum("expm1_sum").over(whole)
    s = s.select("gene", "grp", "n", "expm1_sum", "positive", total.alias("t"), hits.alias("h"), sum_.alias("s"))
    mean_in = F.log2(F.col("expm1_sum") / F.col("n") + 1)
    mean_out = F.log2(F.greatest(F.try_divide(F.col("s") - F.col("expm1_sum"), F.col("t") - F.col("n")), F.lit(0.0)) + 1)
    out = s.select("gene", "grp", (mean_in - mean_out).alias("lfc"), (F.col("positive") / F.col("n")).alias("pct_in"), F.try_divide(F.col("h") - F.col("positive"), F.col("t") - F.col("n")).alias("pct_out"))
    large = F.col("lfc") >= min_lfc if only_positive else F.abs("lfc") >= min_lfc
    return out.where((F.col("pct_in") >= min_in) & (F.col("pct_out") <= max_out) & large)


def marker_table(expr: DataFrame, cells: DataFrame, column: str = "norm", max_q: float = 0.2, **filters) -> DataFrame:
    """``markers`` with Mann-Whitney p-values on the genes kept, adjusted within each group, and filtered by q."""
    kept = markers(expr, cells, column, **filters)
    sizes = cells.groupBy("grp").agg(F.count("*").alias("n"))
    tested = mann_whitney(expr.where(F.col(column) > 0).join(cells, "cell").select("gene", "grp", F.col(column).alias("value")), sizes)
    out = kept.join(tested.select("gene", "grp", special.two_sided(F.col("z")).alias("p")), ["gene", "grp"], "left").withColumn("p", F.coalesce("p", F.lit(1.0)))
    return bh_adjust(out, "p", ["grp"], "gene").where(F.col("q") <= max_q)


def top_per_group(table: DataFrame, group: str, by: str, n: int, tie: str) -> DataFrame:
    """The ``n`` highest rows of each group, ties by ``tie``."""
    order = W.partitionBy(group).orderBy(F.col(by).desc_nulls_last(), F.col(tie).asc())
    return table.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def neighbour_mean(edges: DataFrame, expr: DataFrame, nodes: DataFrame, column: str = "value") -> DataFrame:
    """(id, gene, mean): mean over each node's neighbours (edges dst -> id ``src``), zeros counted; a node without
    neighbours has its own value. Absent rows are zero."""
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    linked = edges.join(expr.select(F.col("cell").alias("dst"), "gene", F.col(column).alias("v")), "dst").groupBy("src", "gene").agg(F.sum("v").alias("s"))
    means = linked.join(degree, "src").select(F.col("src").alias("id"), "gene", (F.col("s") / F.col("degree")).alias("mean"))
    alone = nodes.select("id").join(degree.select(F.col("src").alias("id")), "id", "left_anti")
    own = expr.join(alone.withColumnRenamed("id", "cell"), "cell").select(F.col("cell").alias("id"), "gene", F.col(column).cast("double").alias("mean"))
    return means.unionAll(own)


def radius_mean(points: DataFrame, expr: DataFrame, r: float, column: str = "value") -> DataFrame:
    """(id, gene, mean): ``neighbour_mean`` over the points (id, x, y) within ``r`` of each, itself included, without a row a pair."""
    sums = settled(radius_sums(points, expr, (r,), column))
    degree = sums.where("whole").select("src", F.col("n0").alias("degree"))
    return sums.where("NOT whole").join(degree, "src").select(F.col("src").alias("id"), "gene", (F.col("s0") / F.col("degree")).alias("mean"))


def scale_unit(points: DataFrame, axes: tuple[str, ...] = ("x", "y"), quantile: bool = True) -> float:
    """Geometric mean of the axes' spans (2.5 to 97.5 %) over n ** (1 / d)."""
    span = lambda a: F.percentile(a, F.lit(0.975)) - F.percentile(a, F.lit(0.025)) if quantile else F.max(a) - F.min(a)
    row = points.agg(F.count("*").alias("n"), *[span(a).alias(a) for a in axes]).first()
    product = 1.0
    for a in axes:
        product *= row[a]
    return float(product ** (1 / len(axes)) / row["n"] ** (1 / len(axes)))


def spatial_genes(expr: DataFrame, points: DataFrame, min_cell: float = 5, min_gene: float = 5, d1: float = 1.0, d2: float = 3.0, power: float = 1.0, radii: tuple[float, float] | None = None) -> DataFrame:
    """(gene, t): spatial variability of each gene, variance of neighbourhood means in a wide over a narrow radius, times the gene's
    own share of the largest variance to ``power``. Each point is its own neighbour."""
    cells = expr.groupBy("cell").agg(F.sum("value").alias("s")).where(F.col("s") > min_cell).select("cell")
    genes = expr.groupBy("gene").agg(F.sum("value").alias("s")).where(F.col("s") > min_gene).select("gene")
    points = settled(points.join(cells.withColumnRenamed("cell", "id"), "id", "left_semi"))
    kept = expr.join(points.select(F.col("id").alias("cell")), "cell", "left_semi").join(genes, "gene", "left_semi")
    n = points.count()
    if radii is None:
        unit = scale_unit(points)
        radii = (d1 * unit, d2 * unit)
    scaled = minmax(kept, n)
    # One pass over the pairs serves both radii, whose sums differ in which pairs they take.
    found = settled(radius_sums(points, scaled, radii, "scaled"))
    degree = found.where("whole").select("src", *[F.col(f"n{i}").alias(f"d{i}") for i in (0, 1)])
    means = found.where("NOT whole").join(degree, "src").select("gene", *[F.coalesce(F.try_divide(f"s{i}", f"d{i}"), F.lit(0.0)).alias(f"m{i}") for i in (0, 1)])
    spread = [(F.sum(F.col(m) * F.col(m)) / n - F.pow(F.sum(m) / n, F.lit(2.0))).alias(v) for m, v in (("m0", "v0"), ("m1", "v1"))]
    found = means.groupBy("gene").agg(*spread)
    raw = variance_with_zeros(kept, n).select("gene", F.col("variance").alias("raw"))
    top = raw.agg(F.max("raw").alias("top"))
    out = raw.join(found, "gene").crossJoin(F.broadcast(top))
    return out.select("gene", (F.try_divide(F.col("v1"), F.col("v0")) * F.pow(F.col("raw") / F.col("top"), F.lit(power))).alias("t"))


def spatial_gene_table(scores: DataFrame, middle: float = 0.5) -> DataFrame:
    """``scores`` (gene, t) with a lognormal upper tail p fitted below the ``middle`` quantile, and q."""
    scores = settled(scores)
    cut = scores.agg(F.percentile("t", F.lit(middle))).first()[0]
    fit = scores.where((F.col("t") < cut) & (F.col("t") > 0)).agg(F.avg(F.ln("t")).alias("m"), F.stddev_pop(F.ln("t")).alias("s")).first()
    z = (F.ln(F.nullif("t", F.lit(0.0))) - (fit["m"] or 0.0)) / (fit["s"] or 1.0)
    return bh_adjust(scores.withColumn("p", F.coalesce(special.upper_tail(z), F.lit(1.0))), "p", order="gene").orderBy("q", "p", "gene")


def weighted_moments(expr: DataFrame, points: DataFrame, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(gene, moment, weight): each gene's mean squared Mahalanobis distance from its centroid, its values as weights over the points
    (id, axes) and the metric the inverse covariance of all points. One pass of sums: the trace of the metric times the gene's
    weighted covariance. Weights are not negative; a gene without weight is left out."""
    import numpy as np

    d = len(axes)
    row = points.agg(*[F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(axes) for j, b in enumerate(axes)]).first()
    metric = np.linalg.inv(np.array([[row[f"c{i}_{j}"] for j in range(d)] for i in range(d)], float))
    both = expr.join(points.select(F.col("id").alias("cell"), *axes), "cell")
    w = F.col("value")
    sums = [F.sum(w).alias("weight"), *[F.sum(w * F.col(a)).alias(f"s{i}") for i, a in enumerate(axes)]]
    sums += [F.sum(w * F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(axes) for j, b in enumerate(axes)]
    s = both.groupBy("gene").agg(*sums).where("weight > 0")
    spread = lambda i, j: F.col(f"s{i}_{j}") / F.col("weight") - F.col(f"s{i}") * F.col(f"s{j}") / (F.col("weight") * F.col("weight"))
    moment = sum((F.lit(float(metric[i, j])) * spread(i, j) for i in range(d) for j in range(d)), F.lit(0.0))
    return s.select("gene", moment.alias("moment"), "weight")


def interval(values: DataFrame, column: str, share: float = 0.995, tailed: str = "two", kernel: str = "normal") -> tuple[float | None, float | None]:
    """Bounds of a fitted normal, Poisson (shifted by its mean) or negative binomial interval."""
    row = values.agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("s")).first()
    mean, sd = float(row["m"] or 0.0), float(row["s"] or 0.0)
    upper = (1 + share) / 2 if tailed == "two" else share
    if kernel == "normal":
        at = lambda p: mean + sd * special.normal_ppf(p)
    elif kernel == "poisson":
        at = lambda p: special.poisson_ppf(p, mean) + mean
    else:
        at = lambda p: special.negative_binomial_ppf(p, mean, sd * sd)
    low = at(1 - upper) if tailed != "greater" else float("-inf")
    return low, at(upper) if tailed != "less" else float("inf")


def histogram_threshold(values: DataFrame, column: str, method: str = "otsu", bins: int = 256) -> float:
    """A threshold from a histogram of ``bins`` counts: otsu, isodata, mean, triangle, yen or minimum."""
    import numpy as np

    lo, hi, mean = values.agg(F.min(column), F.max(column), F.avg(column)).first()
    if lo is None or lo == hi or method == "mean":
        return float(mean if mean is not None else 0.0)
    at = F.least(F.floor((F.col(column) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    h = np.zeros(bins)
    for r in values.where(F.col(column).isNotNull()).groupBy(at.alias("b")).count().collect():
        h[r["b"]] = r["count"]
    centre = lo + (np.arange(bins) + 0.5) * (hi - lo) / bins
    w, m = np.cumsum(h), np.cumsum(h * centre)
    below, above = w[:-1], w[-1] - w[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        mb, ma = m[:-1] / below, (m[-1] - m[:-1]) / above
        if method == "otsu":
            return float(centre[np.nanargmax(np.where((below > 0) & (above > 0), below * above * (mb - ma) ** 2, -1))])
        if method == "isodata":
            mid = (mb + ma) / 2
            fits = np.flatnonzero((centre[:-1] <= mid) & (mid <= centre[1:]))
            return float(centre[fits[0]]) if len(fits) else float(mean)
        if method == "yen":
            p = h / h.sum()
            c, s1 = np.cumsum(p), np.cumsum(p**2)
            s2 = np.cumsum(p[::-1] ** 2)[::-1]
            crit = np.log((s1[:-1] * s2[1:]) ** -1.0 * (c[:-1] * (1 - c[:-1])) ** 2)
            return float(centre[:-1][np.nanargmax(np.where(np.isfinite(crit), crit, -np.inf))])
    if method == "triangle":
        peak, ends = int(h.argmax()), np.flatnonzero(h)
        left, right = int(ends[0]), int(ends[-1])
        flip = peak - left < right - peak
        a, b = (peak, right) if flip else (left, peak)
        x = np.arange(a, b + 1)
        if len(x) < 2:
            return float(centre[peak])
        line = h[a] + (h[b] - h[a]) * (x - a) / (b - a)
        return float(centre[x[np.argmax(line - h[x])]])
    for _ in range(10000):
        peaks = np.flatnonzero((h[1:-1] > h[:-2]) & (h[1:-1] >= h[2:])) + 1
        if len(peaks) <= 2:
            break
        h = np.convolve(np.pad(h, 1, mode="edge"), np.ones(3) / 3, mode="valid")
    if len(peaks) < 2:
        return float(mean)
    return float(centre[peaks[0] + h[peaks[0] : peaks[1] + 1].argmin()])


def consecutive_t_tests(values: DataFrame, group: str, column: str) -> DataFrame:
    """(grp, next, t, df, p) of Welch tests between groups that follow each other in order."""
    spark = values.sparkSession
    rows = values.groupBy(group).agg(F.count(column).alias("n"), F.avg(column).alias("m"), F.var_samp(column).alias("v")).orderBy(group).collect()
    out = []
    for a, b in zip(rows, rows[1:], strict=False):
        va, vb = (a["v"] or 0) / a["n"], (b["v"] or 0) / b["n"]
        if va + vb == 0:
            out.append((str(a[group]), str(b[group]), None, None, None))
            continue
        t = (a["m"] - b["m"]) / (va + vb) ** 0.5
        df = (va + vb) ** 2 / (va**2 / max(1, a["n"] - 1) + vb**2 / max(1, b["n"] - 1))
        out.append((str(a[group]), str(b[group]), t, df, 2 * (1 - special.t_cdf(abs(t), df))))
    return spark.createDataFrame(out, "grp string, next string, t double, df double, p double")


def group_correlation(expr: DataFrame, cells: DataFrame, n_genes: int, column: str = "value") -> DataFrame:
    """(a, b, r): correlation over all genes of two groups' mean expression, zeros counted, for groups that share a gene."""
    from .network import gene_correlation

    sizes = cells.groupBy("grp").agg(F.count("*").alias("n"))
    sums = expr.join(cells, "cell").groupBy("grp", "gene").agg(F.sum(column).alias("s")).join(sizes, "grp")
    return gene_correlation(sums.select(F.col("gene").alias("cell"), F.col("grp").alias("gene"), (F.col("s") / F.col("n")).alias("value")), n_genes)
