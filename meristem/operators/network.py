"""Co-expression networks: correlation, activation, soft thresholds, topological overlap, connectivity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pair_sums(entries: DataFrame, block: int = 512, chunk: int = 4096) -> DataFrame:
    """(a, b, n, xy, x, y, xx, yy) of gene pairs a < b over the cells that store both, from entries (cell, gene, value): how many cells,
    and the sums of products, values and squares.

    Genes are dealt into blocks of about ``block`` and cells into chunks of about ``chunk`` by hash; each pair of blocks meets a chunk
    in one task, which multiplies matrices and gives a row per pair that it holds. A repeated (cell, gene) adds up.
    """
    entries = entries.select("cell", "gene", F.col("value").cast("double").alias("value")).dropna()
    kind = entries.schema["gene"].dataType.simpleString()
    size = entries.agg(F.count_distinct("gene"), F.count_distinct("cell")).first()
    blocks, chunks = max(1, -(-size[0] // block)), max(1, -(-size[1] // chunk))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    own = entries.select("*", part("gene", blocks).alias("own"), part("cell", chunks).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("met"))
    own = own.withColumns({"lo": F.least("own", "met"), "hi": F.greatest("own", "met")})

    def run(rows: pa.Table) -> pa.Table:
        cells, genes = rows.column("cell").combine_chunks().dictionary_encode(), rows.column("gene").combine_chunks().dictionary_encode()
        at, g = cells.indices.to_numpy(), genes.indices.to_numpy()
        lo, hi = rows.column("lo").to_numpy(), rows.column("hi").to_numpy()
        lower, same = rows.column("own").to_numpy() == lo, bool(lo[0] == hi[0])
        home = np.zeros(len(genes.dictionary), bool)
        home[g[lower]] = True
        left = np.flatnonzero(home)
        right = left if same else np.flatnonzero(~home)
        x, held = np.zeros((len(cells.dictionary), len(home))), np.zeros((len(cells.dictionary), len(home)))
        np.add.at(x, (at, g), rows.column("value").to_numpy())
        held[at, g] = 1
        u, v, hu, hv = x[:, left], x[:, right], held[:, left], held[:, right]
        n = hu.T @ hv
        if same:
            n = np.triu(n, 1)
        i, j = np.nonzero(n)
        sums = [n, u.T @ v, u.T @ hv, hu.T @ v, (u * u).T @ hv, hu.T @ (v * v)]
        a, b = (genes.dictionary.take(pa.array(s[k])) for s, k in ((left, i), (right, j)))
        return pa.Table.from_arrays([a, b, *[pa.array(m[i, j]) for m in sums]], names=["a", "b", "n", "xy", "x", "y", "xx", "yy"])

    found = own.groupBy("lo", "hi", "part").applyInArrow(run, f"a {kind}, b {kind}, n double, xy double, x double, y double, xx double, yy double")
    turned = F.col("a") > F.col("b")
    pick = lambda c, d: F.when(turned, F.col(d)).otherwise(F.col(c)).alias(c)
    found = found.select(pick("a", "b"), pick("b", "a"), "n", "xy", pick("x", "y"), pick("y", "x"), pick("xx", "yy"), pick("yy", "xx"))
    return found.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "xy", "x", "y", "xx", "yy")])


def gene_correlation(expr: DataFrame, n_cells: int) -> DataFrame:
    """(a, b, r) for gene pairs a < b that share a cell, zeros included by moments."""
    m = expr.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    dots = pair_sums(expr).select("a", "b", F.col("xy").alias("d"))
    ma, mb = m.select(F.col("gene").alias("a"), F.col("s").alias("sa"), F.col("q").alias("qa")), m.select(F.col("gene").alias("b"), F.col("s").alias("sb"), F.col("q").alias("qb"))
    n = float(n_cells)
    cov = F.col("d") - F.col("sa") * F.col("sb") / n
    scale = F.sqrt((F.col("qa") - F.col("sa") * F.col("sa") / n) * (F.col("qb") - F.col("sb") * F.col("sb") / n))
    return dots.join(ma, "a").join(mb, "b").select("a", "b", F.try_divide(cov, scale).alias("r"))


def bicor(expr: DataFrame) -> DataFrame:
    """(a, b, r): biweight midcorrelation of gene pairs over cells where both are stored."""
    value = F.col("value").cast("double")
    m = expr.groupBy("gene").agg(F.median(value).alias("m"))
    med = expr.join(m, "gene").withColumn("apart", value - F.col("m"))
    med = med.join(med.groupBy("gene").agg(F.median(F.abs("apart")).alias("mad")), "gene")
    u = F.try_divide(F.col("apart"), 9 * F.col("mad"))
    w = F.when(F.abs(u) < 1, F.pow(1 - u * u, F.lit(2.0))).otherwise(0.0)
    x = med.select("cell", "gene", (F.col("apart") * w).alias("x"))
    norm = x.groupBy("gene").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    x = x.join(norm, "gene").select("cell", "gene", F.try_divide("x", "norm").alias("value"))
    return pair_sums(x).select("a", "b", F.col("xy").alias("r"))


def spearman(expr: DataFrame) -> DataFrame:
    """(a, b, r): rank correlation of gene pairs over cells where both are stored; average ranks at ties. Ranks come from counts of
    distinct values, so what is ordered within a gene is its values, not its cells. A constant side gives null."""
    ties = expr.groupBy("gene", "value").agg(F.count("*").alias("t"))
    before = F.coalesce(F.sum("t").over(W.partitionBy("gene").orderBy("value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    middle = ties.groupBy("gene").agg((F.sum("t") / 2).alias("mid"))
    # Ranks about their middle keep the sums small.
    ranks = ties.select("gene", "value", (before + (F.col("t") + 1) / 2).alias("k")).join(middle, "gene")
    s = pair_sums(expr.join(ranks, ["gene", "value"]).select("cell", "gene", (F.col("k") - F.col("mid")).alias("value")))
    n = F.col("n")
    spread = lambda q, t: F.col(q) - F.col(t) * F.col(t) / n
    both = spread("xx", "x") * spread("yy", "y")
    return s.select("a", "b", F.when(both > 1e-9, (F.col("xy") - F.col("x") * F.col("y") / n) / F.sqrt(both)).alias("r"))


def activation(r: Column, kind: str = "unsigned", alpha: float = 0.02) -> Column:
    zero = F.lit(0.0)
    return {
        "unsigned": F.abs(r),
        "signed": (1 + r) / 2,
        "relu": F.greatest(r, zero),
        "leaky": F.when(r > 0, r).otherwise(alpha * r),
        "elu": F.when(r > 0, r).otherwise(alpha * F.expm1(r)),
        "swish": r / (1 + F.exp(-r)),
        "softplus": F.log1p(F.exp(r)),
    }[kind]


def adjacency(correlation: DataFrame, power: float, kind: str = "unsigned") -> DataFrame:
    """(a, b, w), both directions, zero diagonal left out."""
    half = correlation.select("a", "b", F.pow(activation(F.col("r"), kind), F.lit(float(power))).alias("w"))
    return half.unionAll(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def normalised(edges: DataFrame, src: str = "a", dst: str = "b", weight: str = "w") -> DataFrame:
    """D^-1/2 A D^-1/2 with row degrees of a symmetric edge table."""
    degree = edges.groupBy(src).agg(F.sum(weight).alias("d"))
    out = edges.join(degree.select(src, F.col("d").alias("da")), src).join(degree.select(F.col(src).alias(dst), F.col("d").alias("db")), dst)
    return out.select(src, dst, F.try_divide(F.col(weight), F.sqrt(F.col("da") * F.col("db"))).alias("norm"))


def stochastic(edges: DataFrame, by: str = "a", weight: str = "w") -> DataFrame:
    """Each weight over its row's (or column's) sum."""
    return edges.withColumn("share", F.try_divide(F.col(weight), F.sum(weight).over(W.partitionBy(by))))


def overlap(edges: DataFrame) -> DataFrame:
    """(a, b, tom): (A^2 + A) / (min(k_a, k_b) + 1 - A) of a symmetric adjacency without diagonal."""
    k = edges.groupBy("a").agg(F.sum("w").alias("k"))
    half = pair_sums(edges.select(F.col("b").alias("cell"), F.col("a").alias("gene"), F.col("w").alias("value"))).select("a", "b", F.col("xy").alias("l"))
    two = half.unionAll(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "l"))
    full = two.join(edges, ["a", "b"], "full").join(k.select("a", F.col("k").alias("ka")), "a").join(k.select(F.col("a").alias("b"), F.col("k").alias("kb")), "b")
    w = F.coalesce("w", F.lit(0.0))
    return full.select("a", "b", F.try_divide(F.coalesce("l", F.lit(0.0)) + w, F.least("ka", "kb") + 1 - w).alias("tom"))


def scale_free_fit(degrees: DataFrame, breaks: int = 10, base: float = 1e-9) -> DataFrame:
    """One row: r2, slope, mean_k, median_k, max_k, density, centralisation, heterogeneity of (k) degrees cut into equal bins."""
    span = degrees.agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.avg("k").alias("mean_k"), F.median("k").alias("median_k"), F.max("k").alias("max_k"), F.count("*").alias("n"), F.var_pop("k").alias("v"))
    width = (F.col("hi") - F.col("lo")) / breaks
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col("k") - F.col("lo"), width)), F.lit(breaks - 1)), F.lit(0))
    binned = degrees.crossJoin(F.broadcast(span)).withColumn("bin", at).groupBy("bin").agg(F.avg("k").alias("dk"), (F.count("*") / F.max("n")).alias("pk"))
    logs = binned.where("dk > 0").select(F.log10("dk").alias("x"), F.log10(F.col("pk") + base).alias("y"))
    fit = logs.agg(F.regr_r2("y", "x").alias("r2"), F.regr_slope("y", "x").alias("slope"))
    n = F.col("n")
    density = F.col("mean_k") / (n - 1)
    return fit.crossJoin(span).select("r2", "slope", "mean_k", "median_k", "max_k", density.alias("density"), (n / (n - 2) * (F.col("max_k") / (n - 1) - density)).alias("centralisation"), (F.sqrt(F.col("v")) / F.col("mean_k")).alias("heterogeneity"))


def soft_power(correlation: DataFrame, powers: list[int], kind: str = "unsigned") -> DataFrame:
    """(power, mean_k, max_k): connectivity at each candidate power, one pass over pairs."""
    both = correlation.select("a", "r").unionAll(correlation.select(F.col("b").alias("a"), "r"))
    each = both.select("a", activation(F.col("r"), kind).alias("w"), F.explode(F.array(*map(F.lit, powers))).alias("power"))
    k = each.groupBy("power", "a").agg(F.sum(F.pow(F.col("w"), F.col("power").cast("double"))).alias("k"))
    return k.groupBy("power").agg(F.avg("k").alias("mean_k"), F.max("k").alias("max_k"))


def pick_power(correlation: DataFrame, powers: list[int], r2_cut: float = 0.9, mean_cut: float = 100.0) -> int:
    """The first power whose scale-free fit exceeds ``r2_cut`` with mean connectivity at most ``mean_cut``, else the best fit."""
    best = (-1.0, powers[0])
    for p in powers:
        k = adjacency(correlation, p).groupBy("a").agg(F.sum("w").alias("k"))
        row = scale_free_fit(k.select("k")).first()
        r2 = row["r2"] if row["r2"] is not None else -1.0
        if r2 > r2_cut and row["mean_k"] <= mean_cut:
            return p
        best = max(best, (r2, -p)) if best[1] > 0 else best
        if r2 > best[0]:
            best = (r2, p)
    return abs(best[1])


def module_connectivity(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(gene, total, within, outside) of (a, b, w) over modules (gene, module)."""
    ma, mb = modules.select(F.col("gene").alias("a"), F.col("module").alias("ma")), modules.select(F.col("gene").alias("b"), F.col("module").alias("mb"))
    each = edges.join(ma, "a").join(mb, "b")
    within = F.sum(F.when(F.col("ma") == F.col("mb"), F.col("w")).otherwise(0.0))
    return each.groupBy(F.col("a").alias("gene")).agg(F.sum("w").alias("total"), within.alias("within"), (F.sum("w") - within).alias("outside"))


def module_membership(expr: DataFrame, eigengenes: DataFrame) -> DataFrame:
    """(gene, module, kme): correlation of each gene with each module's eigengene (cell, module, score)."""
    return expr.join(eigengenes, "cell").groupBy("gene", "module").agg(F.corr("value", "score").alias("kme"))


def _tau(x: np.ndarray, y: np.ndarray) -> float | None:
    """Kendall's tau-b: concordant less discordant pairs, of pairs that no side ties. Discordant ones are inversions, counted by bits of rank."""
    n = len(x)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    rank = np.unique(y, return_inverse=True)[1].astype(np.int64)
    pairs = lambda counts: float((counts * (counts - 1) // 2).sum())
    sizes = lambda *keys: np.diff(np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0), True])) if n else np.zeros(0, np.int64)
    tied_x, tied_y, tied_both = pairs(sizes(x)), pairs(np.bincount(rank, minlength=1)), pairs(sizes(x, y))
    inversions = 0
    for bit in reversed(range(int(rank.max(initial=0)).bit_length())):
        high = rank >> (bit + 1)
        at = np.argsort(high, kind="stable")
        high, ones = high[at], (rank[at] >> bit) & 1
        before = np.cumsum(ones) - ones
        first = np.flatnonzero(np.r_[True, high[1:] != high[:-1]])
        own = before - np.repeat(before[first], np.diff(np.r_[first, n]))
        inversions += int(own[ones == 0].sum())
    total = n * (n - 1) / 2
    scale = (total - tied_x) * (total - tied_y)
    return (total - tied_x - tied_y + tied_both - 2 * inversions) / scale**0.5 if scale > 0 else None


def kendall(expr: DataFrame, block: int = 32) -> DataFrame:
    """(a, b, r): Kendall's tau-b of gene pairs a < b over cells where both are stored; a constant side gives null.

    Genes are dealt into blocks of about ``block`` by hash and each pair of blocks is one task, which holds its genes' entries: two blocks'
    columns, whatever the number of genes. A pair takes n log n steps.
    """
    entries = expr.groupBy("gene", "cell").agg(F.sum(F.col("value").cast("double")).alias("value")).dropna()
    kind = entries.schema["gene"].dataType.simpleString()
    blocks = max(1, -(-entries.agg(F.count_distinct("gene")).first()[0] // block))
    own = F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int")
    dealt = entries.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("met"))
    dealt = dealt.withColumns({"lo": F.least("own", "met"), "hi": F.greatest("own", "met")})

    def run(rows: pa.Table) -> pa.Table:
        genes, cells = rows.column("gene").combine_chunks().dictionary_encode(), rows.column("cell").combine_chunks().dictionary_encode()
        g, c, v = genes.indices.to_numpy(), cells.indices.to_numpy(), rows.column("value").to_numpy()
        lower, same = rows.column("own").to_numpy() == rows.column("lo").to_numpy(), rows.column("lo")[0] == rows.column("hi")[0]
        order = np.lexsort((c, g))
        edge = np.searchsorted(g[order], np.arange(len(genes.dictionary) + 1))
        column = [(c[order[i:j]], v[order[i:j]], bool(lower[order[i]])) for i, j in zip(edge, edge[1:], strict=False)]
        a, b, r = [], [], []
        for i, (ci, vi, li) in enumerate(column):
            for j, (cj, vj, lj) in enumerate(column):
                if (i < j) if same else (li and not lj):
                    _, p, q = np.intersect1d(ci, cj, assume_unique=True, return_indices=True)
                    if len(p):
                        a.append(i)
                        b.append(j)
                        r.append(_tau(vi[p], vj[q]))
        at = lambda k: genes.dictionary.take(pa.array(k, pa.int32()))
        return pa.Table.from_arrays([at(a), at(b), pa.array(r, pa.float64())], names=["a", "b", "r"])

    found = dealt.groupBy("lo", "hi").applyInArrow(run, f"a {kind}, b {kind}, r double")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "r")
