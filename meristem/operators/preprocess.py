"""Quality control, normalisation, scaling and feature selection over long-form counts ``expr(cell, gene, value)``.

Zeros are absent, so every mean, variance and fraction divides by an explicit number of cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors

# Gene-name patterns of mitochondrial, ribosomal and haemoglobin genes.
GENE_FLAGS = {"mt": r"^(MT|mt|Mt)-", "ribo": r"^(RP|Rp|rp)[SLsl]", "hb": r"^HB[^(P)]|^Hb[^(p)]"}


def flag_genes(genes: DataFrame, name: str = "name", patterns: dict[str, str] | None = None) -> DataFrame:
    """A boolean column per pattern."""
    return genes.withColumns({flag: F.col(name).rlike(p) for flag, p in (patterns or GENE_FLAGS).items()})


def drop_genes(genes: DataFrame, flags: list[str], name: str = "name", patterns: dict[str, str] | None = None) -> DataFrame:
    """Genes that match none of the chosen patterns."""
    patterns = patterns or GENE_FLAGS
    for flag in flags:
        genes = genes.where(~F.coalesce(F.col(name).rlike(patterns[flag]), F.lit(False)))
    return genes


def clear_flagged(genes: DataFrame, flags: list[str], selected: str = "highly_variable") -> DataFrame:
    """The selection flag without genes of functional classes."""
    keep = F.col(selected)
    for flag in flags:
        keep = keep & ~F.col(flag)
    return genes.withColumn(selected, keep)


def qc_metrics(expr: DataFrame, genes: DataFrame, flags: list[str]) -> DataFrame:
    """Per cell: total, n_genes, and the percentage of each flag's genes."""
    marked = expr.join(genes.select("gene", *flags), "gene", "left")
    share = [F.round(100 * F.try_divide(F.sum(F.when(F.col(f), F.col("value")).otherwise(0.0)), F.sum("value")), 6).alias(f"pct_{f}") for f in flags]
    return marked.groupBy("cell").agg(F.sum("value").alias("total"), F.count_if(F.col("value") > 0).alias("n_genes"), *share)


def gene_metrics(expr: DataFrame, n_cells: int) -> DataFrame:
    """Per gene: total, n_cells, mean over all cells, dropout percentage."""
    found = F.count_if(F.col("value") > 0)
    return expr.groupBy("gene").agg(F.sum("value").alias("total"), found.alias("n_cells"), (F.sum("value") / n_cells).alias("mean"), (100 * (1 - found / n_cells)).alias("pct_dropout"))


def normalise(expr: DataFrame, target: float = 1e4, log: bool = True, exclude_above: float | None = None) -> DataFrame:
    """Each cell scaled to ``target``, then ln(1 + x). With ``exclude_above``, genes that make up more than this share of
    some cell don't count in the totals."""
    totals = expr.groupBy("cell").agg(F.sum("value").alias("total"))
    if exclude_above is not None:
        loud = expr.join(totals, "cell").where(F.col("value") > exclude_above * F.col("total")).select("gene").distinct()
        totals = expr.join(loud, "gene", "left_anti").groupBy("cell").agg(F.sum("value").alias("total"))
    scaled = F.col("value") * F.lit(float(target)) / F.nullif(F.col("total"), F.lit(0.0))
    out = expr.join(totals, "cell").withColumn("norm", F.log1p(scaled) if log else scaled)
    return out.select("cell", "gene", "value", "norm")


def variance_with_zeros(expr: DataFrame, n_cells: int | Column, column: str = "value") -> DataFrame:
    """Per gene: mean and population variance over all cells."""
    n = F.lit(n_cells) if isinstance(n_cells, int) else n_cells
    v = F.col(column)
    return expr.groupBy("gene").agg((F.sum(v) / n).alias("mean"), (F.sum(v * v) / n - F.pow(F.sum(v) / n, 2)).alias("variance"))


def zscore(expr: DataFrame, n_cells: int, top: float | None = None, centre: bool = True) -> DataFrame:
    """Stored entries as z-scores per gene (population deviation, zero deviation as one), clipped above ``top``.
    ``absent`` is the value of the cells that store nothing."""
    moments = variance_with_zeros(expr, n_cells).withColumn("sd", F.sqrt(F.greatest("variance", F.lit(0.0))))
    moments = moments.withColumn("sd", F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")))
    shift = F.col("mean") if centre else F.lit(0.0)
    z = (F.col("value") - shift) / F.col("sd")
    out = expr.join(moments, "gene").withColumn("z", z if top is None else F.least(z, F.lit(float(top)))).withColumn("absent", -shift / F.col("sd"))
    return out.select("cell", "gene", "z", "absent")


def minmax(expr: DataFrame, n_cells: int) -> DataFrame:
    """Per-gene scaling to [0, 1]; a gene that some cell lacks has minimum at most 0."""
    lo = F.when(F.count("*") < n_cells, F.least(F.min("value"), F.lit(0.0))).otherwise(F.min("value"))
    hi = F.when(F.count("*") < n_cells, F.greatest(F.max("value"), F.lit(0.0))).otherwise(F.max("value"))
    bounds = expr.groupBy("gene").agg(lo.alias("lo"), hi.alias("hi"))
    return expr.join(bounds, "gene").select("cell", "gene", F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)).alias("scaled"))


def variable_genes(expr: DataFrame, n_cells: int, n_top: int, bins: int = 20, column: str = "value") -> DataFrame:
    """Dispersion selection: genes binned by mean, dispersion z-scored in its bin, the ``n_top`` highest kept.

    Bins have equal width between the smallest and largest mean; a bin of one gene has z = 1.
    """
    unbiased = variance_with_zeros(expr, n_cells, column).withColumn("variance", F.col("variance") * n_cells / (n_cells - 1))
    stat = unbiased.withColumn("dispersion", F.try_divide(F.col("variance"), F.col("mean")))
    span = stat.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    at = F.floor((F.col("mean") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)
    stat = stat.crossJoin(F.broadcast(span)).withColumn("bin", F.coalesce(F.least(at, F.lit(bins - 1)), F.lit(0)))
    in_bin = W.partitionBy("bin")
    z = F.coalesce(F.try_divide(F.col("dispersion") - F.avg("dispersion").over(in_bin), F.stddev_samp("dispersion").over(in_bin)), F.lit(1.0))
    stat = stat.withColumn("dispersion_norm", z)
    top = stat.orderBy(F.desc(F.round("dispersion_norm", 9)), "gene").limit(n_top).select("gene", F.lit(True).alias("hv"))
    return stat.join(top, "gene", "left").select("gene", "mean", "dispersion", "bin", "dispersion_norm", F.coalesce("hv", F.lit(False)).alias("highly_variable"))


def null_residuals(expr: DataFrame, model: str = "deviance", family: str = "poisson") -> DataFrame:
    """Residuals of stored entries under a null of gene share times cell size.

    ``model`` is deviance or pearson, ``family`` poisson or binomial. Zeros' residuals follow from ``mu`` alone.
    """
    cells = expr.groupBy("cell").agg(F.sum("value").alias("size"))
    genes = expr.groupBy("gene").agg(F.sum("value").alias("total"))
    whole = expr.agg(F.sum("value").alias("whole"))
    x, n, p = F.col("value"), F.col("size"), F.col("total") / F.col("whole")
    mu = n * p
    out = expr.join(cells, "cell").join(genes, "gene").crossJoin(F.broadcast(whole))
    if family == "poisson":
        deviance = 2 * (x * F.ln(x / mu) - (x - mu))
        pearson = (x - mu) / F.sqrt(mu)
    else:
        rest = F.when(n > x, (n - x) * F.ln((n - x) / (n - mu))).otherwise(0.0)
        deviance = 2 * (x * F.ln(x / mu) + rest)
        pearson = (x - mu) / F.sqrt(mu * (1 - p))
    value = F.signum(x - mu) * F.sqrt(F.greatest(deviance, F.lit(0.0))) if model == "deviance" else pearson
    return out.select("cell", "gene", mu.alias("mu"), value.alias("residual"))


def geometric_mean(expr: DataFrame, n_cells: int, eps: float = 1.0) -> DataFrame:
    """Per gene exp(mean(ln(v + eps))) - eps over all cells."""
    zeros = (F.lit(n_cells) - F.count("*")) * F.ln(F.lit(eps))
    return expr.groupBy("gene").agg((F.exp((F.sum(F.ln(F.col("value") + eps)) + zeros) / n_cells) - eps).alias("gmean"))


def residual_variance(expr: DataFrame, n_cells: int, theta: float = 100.0, gene_rows: int = 4096, size_rows: int = 65_536) -> DataFrame:
    """Variance of clipped Pearson residuals per gene under a negative binomial null, zeros included.

    A zero's residual follows from the gene's total and the cell's size, so zeros are summed over the distinct sizes and their
    counts, blocks of genes against blocks of sizes; stored entries then put their own residual in a zero's place.
    """
    expr = expr.select("cell", "gene", F.col("value").cast("double").alias("value"))
    cells = expr.groupBy("cell").agg(F.sum("value").alias("size"))
    genes = expr.groupBy("gene").agg(F.sum("value").alias("total"))
    whole, top = expr.agg(F.sum("value")).first()[0] or 1.0, float(n_cells) ** 0.5
    sizes = cells.groupBy("size").agg(F.count("*").alias("times"))
    g_blocks, s_blocks = max(1, -(-genes.count() // gene_rows)), max(1, -(-sizes.count() // size_rows))

    def dealt(frame: DataFrame, key: str, n: int, m: int) -> DataFrame:
        return frame.select("*", F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("met"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        total, size, times = left.column("total").to_numpy(), right.column("size").to_numpy(), right.column("times").to_numpy()
        s1, s2 = np.zeros(len(total)), np.zeros(len(total))
        for i in range(0, len(total), 64):
            mu = np.maximum(total[i : i + 64, None] * size[None] / whole, 1e-300)
            r = np.maximum(-top, -mu / np.sqrt(mu + mu * mu / theta))
            s1[i : i + 64], s2[i : i + 64] = r @ times, (r * r) @ times
        return pa.Table.from_arrays([left.column("gene"), pa.array(s1), pa.array(s2)], names=["gene", "s1", "s2"])

    left, right = dealt(genes, "gene", g_blocks, s_blocks), dealt(sizes, "size", s_blocks, g_blocks)
    zeros = left.groupBy("own", "met").cogroup(right.groupBy("met", "own")).applyInArrow(run, f"gene {expr.schema['gene'].dataType.simpleString()}, s1 double, s2 double")
    mu = F.col("size") * F.col("total") / F.lit(float(whole))
    clipped = lambda x: F.greatest(F.lit(-top), F.least(F.lit(top), F.coalesce(F.try_divide(x - mu, F.sqrt(mu + mu * mu / theta)), F.lit(0.0))))
    own = expr.join(cells, "cell").join(genes, "gene").select("gene", clipped(F.col("value")).alias("r"), clipped(F.lit(0.0)).alias("z"))
    own = own.select("gene", (F.col("r") - F.col("z")).alias("s1"), (F.col("r") * F.col("r") - F.col("z") * F.col("z")).alias("s2"))
    sums = zeros.unionAll(own).groupBy("gene").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    # Cells without any count have residual zero, as their size is.
    return sums.select("gene", (F.col("s2") / n_cells - F.pow(F.col("s1") / n_cells, F.lit(2.0))).alias("residual_variance"))


def gene_set_score(expr: DataFrame, members: DataFrame, controls: DataFrame, column: str = "norm") -> DataFrame:
    """Per cell: mean of a gene set minus mean of a control set (both counted with their zeros)."""
    sides = members.select("gene", F.lit(1).alias("side")).unionAll(controls.select("gene", F.lit(0).alias("side")))
    size = sides.groupBy("side").agg(F.count("*").alias("n"))
    each = expr.join(sides, "gene").groupBy("cell", "side").agg(F.sum(column).alias("s")).join(size, "side")
    return each.groupBy("cell").agg((F.sum(F.when(F.col("side") == 1, F.col("s") / F.col("n")).otherwise(-F.col("s") / F.col("n")))).alias("score"))


def robust_outliers(points: DataFrame, width: float, threshold: float = 10.0) -> DataFrame:
    """(id, x, y, outlier): robust z of y in two offset binnings of x; an outlier exceeds ``threshold`` in both."""
    lo = points.agg(F.min("x").alias("lo"))
    out = points.crossJoin(F.broadcast(lo))
    for k, shift in enumerate((0.0, width / 2)):
        b = f"bin{k}"
        out = out.withColumn(b, F.floor((F.col("x") - F.col("lo") + shift) / width))
        median = F.percentile("y", F.lit(0.5)).over(W.partitionBy(b))
        out = out.withColumn(f"d{k}", F.col("y") - median)
        mad = F.percentile(F.abs(f"d{k}"), F.lit(0.5)).over(W.partitionBy(b))
        out = out.withColumn(f"z{k}", F.col(f"d{k}") / (1.4826 * mad + 1e-9))
    return out.select("id", "x", "y", (F.least(F.abs("z0"), F.abs("z1")) > threshold).alias("outlier"))


def detection(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """(grp, side, size, n): how many cells of a group store ``size`` genes (``side`` 'cell'), and how many genes are stored by ``size`` of
    its cells ('gene'). Cells and genes that store nothing above zero have no row."""
    stored = expr.where("value > 0").join(cells, "cell")
    sides = [stored.groupBy("grp", s).agg(F.count("*").alias("size")).groupBy("grp", "size").agg(F.count("*").alias("n")).select("grp", F.lit(s).alias("side"), "size", "n") for s in ("cell", "gene")]
    return sides[0].unionAll(sides[1])


def regressed(expr: DataFrame, covariate: DataFrame, top: float | None = None) -> DataFrame:
    """(cell, gene, z) of stored entries: residuals of each gene's line over a covariate (cell, c) by all its cells, zeros included, over
    their sample deviation, clipped above ``top``. One pass of sums per gene; a gene without spread has z = 0."""
    c = F.col("c")
    all_ = covariate.agg(F.count("*").cast("double").alias("n"), F.avg(c).alias("mc"), F.var_pop(c).alias("vc"))
    both = expr.join(covariate, "cell")
    v = F.col("value").cast("double")
    sums = both.crossJoin(F.broadcast(all_.select("mc"))).groupBy("gene").agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.sum(v * (c - F.col("mc"))).alias("k"))
    fit = sums.crossJoin(F.broadcast(all_)).withColumn("slope", F.coalesce(F.try_divide(F.col("k"), F.col("n") * F.col("vc")), F.lit(0.0)))
    left = F.col("q") - F.col("s") * F.col("s") / F.col("n") - F.col("slope") * F.col("k")
    fit = fit.select("gene", (F.col("s") / F.col("n")).alias("m"), "slope", "mc", F.sqrt(F.greatest(left, F.lit(0.0)) / (F.col("n") - 1)).alias("sd"))
    z = F.coalesce(F.try_divide(v - F.col("m") - F.col("slope") * (c - F.col("mc")), F.col("sd")), F.lit(0.0))
    return both.join(fit, "gene").select("cell", "gene", (z if top is None else F.least(z, F.lit(float(top)))).alias("z"))


def doublet_pairs(cells: DataFrame, ratio: int = 2, seed: int = 0) -> DataFrame:
    """(id, a, b): ``ratio`` simulated doublets a cell, with ids -1, -2, ...: each time the cells are put in an order by hash, and each is paired
    with the next, the last with the first. Ranks come from sorted ranges."""
    from .neighbors import by_range, ranged

    parts = []
    for turn in range(ratio):
        key = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(turn)), F.lit(str(seed))).cast("binary"))
        placed, sizes = ranged(cells.select("id", key.alias("key")), "key", "id")
        before, total = {}, 0
        for part, n in sizes.items():
            before[part], total = float(total), total + n
        at = placed.select("id", (by_range(before, 0.0).cast("long") + F.col("__place")).alias("at"))
        if total:
            b = at.select(F.col("id").alias("b"), F.pmod(F.col("at") - 1, F.lit(total)).alias("at"))
            parts.append(at.withColumnRenamed("id", "a").join(b, "at").select((-(F.col("at") + 1 + turn * total)).alias("id"), "a", "b"))
    out = parts[0] if parts else cells.select(F.lit(0).cast("long").alias("id"), F.col("id").alias("a"), F.col("id").alias("b")).where("false")
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def doublet_scores(edges: DataFrame, k: int, ratio: float, rate: float = 0.1) -> DataFrame:
    """(id, simulated, score) from the ``k`` neighbours of every observed cell (src, dst) among observed and simulated ones (negative ids):
    the likelihood of a doublet given the share of simulated neighbours, ``ratio`` simulated a cell and an expected ``rate``."""
    q = (F.col("simulated") + 1) / (k + 2)
    counted = edges.where("src >= 0").groupBy(F.col("src").alias("id")).agg(F.count_if(F.col("dst") < 0).alias("simulated"))
    return counted.select("id", "simulated", (q * (rate / ratio) / (1 - rate - q * (1 - rate - rate / ratio))).alias("score"))


def unit_rows(rows: DataFrame, column: str = "vec") -> DataFrame:
    """``rows`` with their arrays centred by position over all rows and scaled to length one; a row at the centre is zero."""
    width = rows.agg(F.max(F.size(column))).first()[0] or 0
    means = rows.agg(*[F.avg(F.col(column)[j]).alias(f"m{j}") for j in range(width)]).first()
    centre = F.array(*[F.lit(float(m or 0.0)) for m in means]) if width else F.array().cast("array<double>")
    return rows.withColumn(column, F.zip_with(column, centre, lambda a, b: a - b)).withColumn(column, vectors.unit(F.col(column)))
