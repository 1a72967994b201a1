"""Principal components and clustering from distributed sufficient statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbors import _matrix


def gram(rows: DataFrame, column: str = "vec") -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, column sums and second moments of an array column: a partial per task, summed by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, None, None
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                s = x.sum(axis=0) if s is None else s + x.sum(axis=0)
                g = x.T @ x if g is None else g + x.T @ x
                n += len(x)
        if n:
            flat = np.concatenate([[n], s, g.ravel()])
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(flat))), "v": pa.array(flat)})

    parts = rows.select(column).where(F.col(column).isNotNull()).mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.array([r["v"] for r in sorted(parts)])
    if not len(flat):
        return 0, np.zeros(0), np.zeros((0, 0))
    d = int(round((-1 + np.sqrt(1 + 4 * (len(flat) - 1))) / 2))
    return int(flat[0]), flat[1 : 1 + d], flat[1 + d :].reshape(d, d)


def pca(rows: DataFrame, k: int, column: str = "vec", centre: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components d x k, explained variances, mean); each component's entry of largest magnitude is positive."""
    n, s, g = gram(rows, column)
    mean = s / n if centre else np.zeros_like(s)
    cov = (g - n * np.outer(mean, mean)) / max(1, n - 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    v = vectors[:, order]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])[None, :]
    return v, values[order], mean


def project(rows: DataFrame, components: np.ndarray, mean: np.ndarray, column: str = "vec", name: str = "scores") -> DataFrame:
    """``rows`` with scores on the components."""
    parts = []
    for j in range(components.shape[1]):
        w = F.array(*[F.lit(float(x)) for x in components[:, j]])
        parts.append(F.aggregate(F.zip_with(column, w, lambda x, y: x * y), F.lit(float(-mean @ components[:, j])), lambda acc, x: acc + x))
    return rows.withColumn(name, F.array(*parts))


def residual_vectors(expr: DataFrame, model: str = "deviance", most: int = 20_000) -> DataFrame:
    """(cell, vec): each cell's residuals of all genes, in order of gene, under a Poisson null of gene share times cell size, zeros
    included. ``model`` is deviance or pearson. With ``pca`` these are the residual form of generalised PCA.

    Genes' shares go to the workers; beyond ``most`` genes it refuses, so choose variable genes first. Cells without counts are left out.
    """
    totals = expr.where("value > 0").groupBy("gene").agg(F.sum("value").cast("double").alias("total")).orderBy("gene").limit(most + 1).collect()
    if len(totals) > most:
        raise ValueError(f"more than {most} genes; choose variable genes first")
    genes, share = [r["gene"] for r in totals], np.array([r["total"] for r in totals])
    share = share / max(share.sum(), 1e-300)
    at = {g: i for i, g in enumerate(genes)}
    cells = expr.where("value > 0").groupBy("cell").agg(F.collect_list("gene").alias("genes"), F.collect_list(F.col("value").cast("double")).alias("values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                names, values = part.column("genes").to_pylist(), part.column("values").to_pylist()
                x = np.zeros((part.num_rows, len(genes)))
                for r, (own, v) in enumerate(zip(names, values, strict=True)):
                    np.add.at(x[r], [at[g] for g in own], v)
                mu = x.sum(axis=1, keepdims=True) * share
                if model == "pearson":
                    out = (x - mu) / np.sqrt(mu)
                else:
                    out = np.sign(x - mu) * np.sqrt(np.maximum(2 * (x * np.log(np.where(x > 0, x / mu, 1)) - (x - mu)), 0))
                ends = np.arange(0, out.size + 1, max(1, len(genes)), dtype=np.int32)
                yield pa.RecordBatch.from_pydict({"cell": part.column("cell"), "vec": pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))})

    return cells.mapInArrow(run, f"cell {expr.schema['cell'].dataType.simpleString()}, vec array<double>")


def dual_pca(x: DataFrame, y: DataFrame, k: int, column: str = "vec") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors of X Y^T between two sets over common features: feature-space bases scaled by the root of the singular values.

    X Y^T shares its singular values with R_x R_y^T, where G = R^T R are the sets' Gram matrices.
    """
    roots = []
    for rows in (x, y):
        _, _, g = gram(rows, column)
        values, vectors = np.linalg.eigh(g)
        roots.append((np.sqrt(np.maximum(values, 0))[:, None] * vectors.T, np.sqrt(np.maximum(values, 0)), vectors))
    u, s, vt = np.linalg.svd(roots[0][0] @ roots[1][0].T)
    back = lambda root, basis: root[2] @ np.diag(1 / np.maximum(root[1], 1e-12)) @ basis
    return back(roots[0], u[:, :k]) * np.sqrt(s[:k]), back(roots[1], vt.T[:, :k]) * np.sqrt(s[:k]), s[:k]


def kmeans(rows: DataFrame, k: int, column: str = "vec", seed: int = 7, rounds: int = 20) -> tuple[DataFrame, np.ndarray]:
    """(rows with ``cluster``, centres): Lloyd rounds whose sums are aggregated per task; starting centres are the first of a hash order."""
    start = rows.select(column).where(F.col(column).isNotNull()).orderBy(F.xxhash64(F.lit(seed), column)).limit(64 * k).toArrow()
    pool = _matrix(start.column(0))
    pool = pool[np.sort(np.unique(pool, axis=0, return_index=True)[1])] if len(pool) else pool
    centres = pool[:1]
    while len(centres) < min(k, len(pool)):
        far = ((pool[:, None, :] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        centres = np.vstack([centres, pool[far.argmax()]])

    def step(c: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(c), c.shape[1] + 1))
            for batch in batches:
                x = _matrix(batch.column(0))
                if len(x):
                    near = ((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None]).argmin(axis=1)
                    np.add.at(total, near, np.column_stack([x, np.ones(len(x))]))
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(total.size)), "v": pa.array(total.ravel())})

        return run

    vectors = rows.select(column).where(F.col(column).isNotNull())
    for _ in range(rounds):
        sums = np.zeros(centres.shape[0] * (centres.shape[1] + 1))
        for r in vectors.mapInArrow(step(centres), "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            sums[r["at"]] = r["v"]
        sums = sums.reshape(len(centres), -1)
        new = np.where(sums[:, -1:] > 0, sums[:, :-1] / np.maximum(sums[:, -1:], 1), centres)
        if np.allclose(new, centres, atol=1e-9):
            break
        centres = new

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(column))
            near = ((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None]).argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names} | {"cluster": pa.array(near.astype(np.int64))})

    kept = rows.where(F.col(column).isNotNull())
    return kept.mapInArrow(assign, kept.withColumn("cluster", F.lit(0).cast("long")).schema), centres


def ridge(rows: DataFrame, x: str, y: str, penalty: float | np.ndarray) -> np.ndarray:
    """Coefficients of array column ``y`` on array column ``x`` with per-coefficient penalties, from one Gram matrix."""
    both = rows.select(F.concat(x, y).alias("vec"), F.size(x).alias("d"))
    d = both.select(F.max("d")).first()[0]
    _, _, g = gram(both)
    return np.linalg.solve(g[:d, :d] + np.diag(np.broadcast_to(np.asarray(penalty, float), (d,))), g[:d, d:])


def eigengenes(expr: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, cell, score): first principal component of each module's standardised genes, aligned with the module's mean."""
    import pandas as pd

    def first(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot_table(index="cell", columns="gene", values="value", fill_value=0.0).sort_index()
        x = wide.to_numpy(float)
        sd = x.std(axis=0)
        x = (x - x.mean(axis=0)) / np.where(sd == 0, 1, sd)
        u, s, _ = np.linalg.svd(x, full_matrices=False)
        score = u[:, 0]
        if score @ x.mean(axis=1) < 0:
            score = -score
        return pd.DataFrame({"module": frame["module"].iloc[0], "cell": wide.index.to_numpy(), "score": score})

    kind = expr.schema["cell"].dataType.simpleString()
    return expr.join(modules, "gene").select("module", "cell", "gene", F.col("value").cast("double").alias("value")).groupBy("module").applyInPandas(first, f"module {modules.schema['module'].dataType.simpleString()}, cell {kind}, score double")
