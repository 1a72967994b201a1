"""Pseudotime windows, transition matrices, floods and random walks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import settled


def lag_difference(rows: DataFrame, key: str, order: list[str], value: str, k: int = 1) -> DataFrame:
    """``rows`` with the difference to the value ``k`` rows before."""
    return rows.withColumn("lag_diff", F.col(value) - F.lag(value, k).over(W.partitionBy(key).orderBy(*order)))


def prefix_mean(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with the running mean of ``value``, nulls skipped."""
    return rows.withColumn("prefix_mean", F.avg(value).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def hop_position(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with the relative position in their walk, 1 at the end."""
    return rows.withColumn("hop", F.row_number().over(W.partitionBy(key).orderBy(*order)) / F.count("*").over(W.partitionBy(key)))


def logistic_parameters(pseudotime: DataFrame, forward: int = 20, back: int = 40) -> tuple[float, float]:
    """(x0, k) of the logistic that weights transitions, from lag differences of sorted pseudotime (id, t)."""
    order = W.orderBy("t", "id")
    row = pseudotime.select((F.col("t") - F.lag("t", forward).over(order)).alias("f"), (F.col("t") - F.lag("t", back).over(order)).alias("b")).agg(F.avg("f").alias("f"), F.avg("b").alias("b")).first()
    x0 = (row["f"] - row["b"]) / 2
    return x0, np.log(0.01 / 0.99) / (x0 - row["f"])


def weight_transitions(transitions: DataFrame, pseudotime: DataFrame, x0: float, k: float) -> DataFrame:
    """(src, dst, w): transition weights times a logistic of the pseudotime step."""
    a, b = pseudotime.select(F.col("id").alias("src"), F.col("t").alias("ts")), pseudotime.select(F.col("id").alias("dst"), F.col("t").alias("td"))
    step = F.col("td") - F.col("ts")
    return transitions.join(a, "src").join(b, "dst").select("src", "dst", (F.col("w") / (1 + F.exp(-k * (step - x0)))).alias("w"))


def row_scaled(transitions: DataFrame) -> DataFrame:
    """Transition weights over the largest row sum."""
    top = transitions.groupBy("src").agg(F.sum("w").alias("s")).agg(F.max("s").alias("top"))
    return transitions.crossJoin(F.broadcast(top)).select("src", "dst", (F.col("w") / F.col("top")).alias("p"))


def combined_visit(transitions: DataFrame, visited: DataFrame) -> DataFrame:
    """(id, p): probability that some visited neighbour reaches a node, 1 - prod(1 - p); certain ones stay 1."""
    near = transitions.join(visited.select(F.col("id").alias("src")), "src").join(visited.select(F.col("id").alias("dst")), "dst", "left_anti")
    sure = F.max(F.when(F.col("p") >= 1, 1).otherwise(0))
    rest = 1 - F.exp(F.sum(F.when(F.col("p") < 1, F.log1p(-F.col("p"))).otherwise(0.0)))
    return near.groupBy(F.col("dst").alias("id")).agg(F.when(sure == 1, F.lit(1.0)).otherwise(rest).alias("p"))


def diffusion_kernel(edges: DataFrame, sigma2: float) -> DataFrame:
    """(src, dst, w): Gaussian kernel of neighbour distances, normalised by densities and symmetrically by degrees."""
    w = edges.select("src", "dst", F.exp(-F.col("dist") ** 2 / (2 * sigma2)).alias("w"))
    w = w.unionAll(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg((F.sum("w") / 2).alias("w"))
    for power in (1.0, 0.5):
        d = w.groupBy("src").agg(F.sum("w").alias("d"))
        w = w.join(d.withColumnRenamed("d", "ds"), "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
        w = w.select("src", "dst", (F.col("w") / F.pow(F.col("ds") * F.col("dd"), F.lit(power))).alias("w"))
    return w


def _csr(transitions: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = transitions.count()
    if n > most:
        raise ValueError(f"{n} transitions are over the bound of {most} that replicates hold in memory")
    t = transitions.orderBy("src", "dst").toArrow()
    src, dst, p = (t.column(c).to_numpy() for c in ("src", "dst", transitions.columns[2]))
    ids = np.unique(np.concatenate([src, dst]))
    s, d = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    return ids, np.searchsorted(s, np.arange(len(ids) + 1)), d, p.astype(float)


def flood(transitions: DataFrame, roots: list[int], reps: int = 60, least: int = 2, seed: int = 200504, most: int = 20_000_000) -> DataFrame:
    """(rep, id, step): stochastic floods from ``roots`` over (src, dst, p), one replicate a group; a flood ends when fewer than
    ``least`` nodes are newly visited. The transition table is checked against ``most`` before it goes to the workers."""
    ids, at, to, p = _csr(transitions, most)
    start = np.searchsorted(ids, [r for r in roots if r in set(ids.tolist())])
    spark = transitions.sparkSession

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = np.repeat(np.arange(len(ids)), np.diff(at))
        for frame in frames:
            for rep in frame["id"]:
                rng = np.random.default_rng(seed + int(rep))
                step = np.full(len(ids), -1)
                step[start] = 0
                turn = 0
                while True:
                    turn += 1
                    open_ = (step[source] >= 0) & (step[to] < 0)
                    stay = np.ones(len(ids))
                    np.multiply.at(stay, to[open_], 1 - np.minimum(1, p[open_]))
                    new = np.flatnonzero((step < 0) & (rng.random(len(ids)) < 1 - stay))
                    step[new] = turn
                    if len(new) < least:
                        break
                seen = step >= 0
                yield pd.DataFrame({"rep": int(rep), "id": ids[seen], "step": step[seen].astype("int64")})

    return spark.range(reps).mapInPandas(run, "rep bigint, id bigint, step bigint")


def flood_pseudotime(floods: DataFrame) -> DataFrame:
    """(id, pseudotime, visits): mean of steps scaled by their flood's last step."""
    last = floods.groupBy("rep").agg(F.max("step").alias("last"))
    return floods.join(last, "rep").groupBy("id").agg(F.avg(F.try_divide("step", "last")).alias("pseudotime"), F.count("*").alias("visits"))


def random_walks(transitions: DataFrame, starts: list[int], ends: list[int], walks: int = 100, max_steps: int = 1000, seed: int = 200504, most: int = 20_000_000) -> DataFrame:
    """(walk, hop, id): weighted walks over (src, dst, w) until an end; walks that take too long give nothing."""
    ids, at, to, w = _csr(transitions, most)
    total = np.concatenate([[0], np.cumsum(w)])
    known = set(ids.tolist())
    first, stop = np.searchsorted(ids, [s for s in starts if s in known]), set(np.searchsorted(ids, [e for e in ends if e in known]).tolist())
    spark = transitions.sparkSession

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for walk in frame["id"]:
                rng = np.random.default_rng(seed + int(walk))
                if not len(first):
                    continue
                node = int(first[rng.integers(len(first))])
                path = [node]
                while node not in stop and len(path) <= max_steps:
                    lo, hi = at[node], at[node + 1]
                    if hi == lo or total[hi] <= total[lo]:
                        break
                    node = int(to[min(hi - 1, np.searchsorted(total, total[lo] + rng.random() * (total[hi] - total[lo]), "right") - 1)])
                    path.append(node)
                if node in stop:
                    yield pd.DataFrame({"walk": int(walk), "hop": np.arange(1, len(path) + 1), "id": ids[path]})

    return spark.range(walks).mapInPandas(run, "walk bigint, hop bigint, id bigint")


def walk_summary(walks: DataFrame) -> DataFrame:
    """(id, visits, position): visits and mean relative hop."""
    return hop_position(walks, "walk", ["hop"]).groupBy("id").agg(F.count("*").alias("visits"), F.avg("hop").alias("position"))


def diffusion_components(kernel: DataFrame, k: int = 10, rounds: int = 200, tolerance: float = 1e-9) -> tuple[list[float], DataFrame]:
    """(eigenvalues, (id, vec)) of a symmetric kernel (src, dst, w): the ``k`` algebraically largest of eigenvalues in -1 to 1, largest first,
    with unit eigenvectors whose sum is not negative. Subspace iteration: a round is a sum over edges, and k x k matrices on the driver; it ends when
    no eigenvalue moves by ``tolerance``. ``k`` is at most the number of nodes."""
    at = range(k)
    uniform = lambda j: F.pmod(F.xxhash64("id", F.lit(j)), F.lit(1 << 20)) / float(1 << 20) - 0.4
    basis = kernel.select(F.col("src").alias("id")).distinct().select("id", *[uniform(j).alias(f"v{j}") for j in at])
    last = None
    kernel = settled(kernel.select("src", "dst", "w"))
    cross = lambda a, b: [F.sum(F.col(f"{a}{i}") * F.col(f"{b}{j}")) for i in at for j in at]
    turned = lambda m, *parts: [sum((F.lit(float(m[i, j])) * sum((F.col(f"{p}{i}") for p in parts), F.lit(0.0)) for i in at), F.lit(0.0)).alias(f"v{j}") for j in at]
    for turn in range(rounds + 1):
        moved = kernel.join(basis.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(*[F.sum(F.col("w") * F.col(f"v{j}")).alias(f"t{j}") for j in at])
        both = settled(basis.join(moved, "id"))
        vv, vt, tt = np.array(both.agg(*cross("v", "v"), *cross("v", "t"), *cross("t", "t")).first(), float).reshape(3, k, k)
        root = np.linalg.cholesky(vv)
        ritz = np.linalg.solve(root, np.linalg.solve(root, (vt + vt.T) / 2).T)
        values, vectors = np.linalg.eigh((ritz + ritz.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        if turn == rounds or (last is not None and np.abs(values - last).max() < tolerance):
            break
        last = values
        # The next basis: (V + T V) / 2 made orthonormal, whose largest eigenvalues are the algebraically largest of T.
        basis = both.select("id", *turned(np.linalg.inv(np.linalg.cholesky(vv + vt + vt.T + tt)).T, "v", "t"))
    out = both.select("id", *turned(np.linalg.solve(root.T, vectors), "v"))
    signs = [1.0 if (s or 0) >= 0 else -1.0 for s in out.agg(*[F.sum(f"v{j}") for j in at]).first()]
    return values.tolist(), out.select("id", F.array(*[F.col(f"v{j}") * s for j, s in zip(at, signs, strict=True)]).alias("vec"))


def _uniform(id_: Column, draw: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the id, the draw's name and the seed alone."""
    key = F.concat_ws(":", id_.cast("string"), F.lit(draw), F.lit(str(seed))).cast("binary")
    return F.conv(F.left(F.md5(key), F.lit(8)), 16, 10).cast("double") / float(1 << 32)


def thinned(visits: DataFrame, draws: int = 20, seed: int = 0) -> DataFrame:
    """(id, n) of visits (id, p) that stay: n of ``draws`` draws come up with probability p, and a visit with any stays with probability
    n / draws. Draws depend on id and seed alone."""
    id_, p = F.col("id"), F.col("p")
    n = F.aggregate(F.array(*[F.when(_uniform(id_, str(j), seed) < p, 1).otherwise(0) for j in range(draws)]), F.lit(0), lambda a, x: a + x)
    counted = visits.select("id", n.alias("n")).where("n > 0")
    return counted if draws == 1 else counted.where(_uniform(id_, "stay", seed) < F.col("n") / draws)
