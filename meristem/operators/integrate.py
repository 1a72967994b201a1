"""Batch integration of vectors: mutual-neighbour correction and diversity-penalised soft clusters with a linear correction.

Points have ``id`` bigint, ``vec`` array<double> and the batch ``grp`` bigint. Per-point work runs in the workers; the driver holds
sums by cluster and batch, whose size does not grow with the points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import settled
from .neighbors import knn, mutual

_CORRECTED = "id bigint, grp bigint, vec array<double>"


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def anchors(points: DataFrame, k: int = 20) -> DataFrame:
    """(src, dst, dist, target): pairs of points of different batches that are each among the other's ``k`` nearest of its batch."""
    return mutual(knn(points, k=k, scope="each").select("src", "dst", "dist", "target"))


def mnn_correct(points: DataFrame, reference: int, k: int = 20, sigma: float = 1.0, smooth: int = 20) -> DataFrame:
    """``points`` with batches moved onto batch ``reference``: a point's shift is the mean of the anchor shifts of its ``smooth`` nearest
    anchored points of its own batch, weighted by exp(-distance**2 / (2 sigma**2)). Batches without an anchor stay as they are."""
    movable, fixed = points.where(F.col("grp") != reference), points.where(F.col("grp") == reference)
    # Of the anchors between all batches only those with ``reference`` count.
    pairs = knn(movable, fixed, k, exclude_self=True, scope="each").select("src", "dst")
    back = knn(fixed, movable, k, exclude_self=True, scope="each").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    pairs = pairs.join(back, ["src", "dst"], "left_semi")
    vec = points.select("id", "vec")
    ends = pairs.join(vec.withColumnsRenamed({"id": "src", "vec": "a"}), "src").join(vec.withColumnsRenamed({"id": "dst", "vec": "b"}), "dst")
    # One sum an axis: a row per point and axis would be shuffled many times over.
    axes = range(points.agg(F.max(F.size("vec"))).first()[0] or 0)
    shift = ends.groupBy("src").agg(F.array(*[F.avg(F.get("b", F.lit(i)) - F.get("a", F.lit(i))) for i in axes]).cast("array<double>").alias("shift"))
    shift = settled(shift)
    anchored = movable.join(shift.select(F.col("src").alias("id")), "id", "left_semi")
    near = knn(movable, anchored, smooth, exclude_self=False, scope="within")
    weighted = near.join(shift.withColumnRenamed("src", "dst"), "dst").withColumn("w", F.exp(-F.col("dist") ** 2 / (2 * sigma * sigma)))
    each = [F.coalesce(F.try_divide(F.sum(F.col("w") * F.get("shift", F.lit(i))), F.sum("w")), F.lit(0.0)) for i in axes]
    moved = weighted.groupBy(F.col("src").alias("id")).agg(F.array(*each).cast("array<double>").alias("move"))
    out = points.join(moved, "id", "left")
    return out.select("id", "grp", F.when(F.col("move").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "move", lambda v, m: v + m)).alias("vec"))


def memberships(z: np.ndarray, batch: np.ndarray, centres: np.ndarray, penalty: np.ndarray, sigma: float) -> np.ndarray:
    """Soft assignment of unit vectors to unit centres, times the penalty of (cluster, batch)."""
    unit = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    logits = -2 * (1 - unit @ centres.T) / sigma
    r = np.exp(logits - logits.max(axis=1, keepdims=True)) * penalty[:, batch].T
    return r / np.maximum(r.sum(axis=1, keepdims=True), 1e-300)


def corrections(counts: np.ndarray, sums: np.ndarray, ridge: float) -> np.ndarray:
    """Per cluster and batch the shift of a ridge regression of vectors on batches; the intercept is not penalised nor taken away.
    ``counts``: clusters x batches, ``sums``: clusters x batches x axes."""
    clusters, batches, axes = sums.shape
    out = np.zeros((clusters, batches, axes))
    for k in range(clusters):
        design = np.zeros((batches + 1, batches + 1))
        design[0, 0], design[0, 1:], design[1:, 0] = counts[k].sum(), counts[k], counts[k]
        design[1:, 1:] = np.diag(counts[k] + ridge)
        design[0, 0] += 1e-12
        out[k] = np.linalg.solve(design, np.vstack([sums[k].sum(axis=0), sums[k]]))[1:]
    return out


def harmony(points: DataFrame, clusters: int = 8, rounds: int = 3, inner: int = 5, sigma: float = 0.1, theta: float = 2.0, ridge: float = 1.0) -> DataFrame:
    """``points`` (id, grp, vec) corrected for their batch. Each round: soft k-means on unit vectors, where clusters that hold more of a batch
    than expected are penalised by ((expected + 1) / (observed + 1)) ** theta, then a ridge regression in each cluster takes the
    batch's shift away. Centres begin at distinct vectors chosen by the hash of their id."""
    now = settled(points.where("id IS NOT NULL AND vec IS NOT NULL AND grp IS NOT NULL").select("id", "grp", "vec"))
    sizes = {r["grp"]: r["n"] for r in now.groupBy("grp").agg(F.count("*").alias("n")).orderBy("grp").collect()}
    if len(sizes) < 2:
        return now
    names = np.array(sorted(sizes))
    share = np.array([sizes[g] for g in names.tolist()], float) / sum(sizes.values())
    first = now.groupBy("vec").agg(F.min(F.xxhash64("id")).alias("h")).orderBy("h").limit(clusters).collect()
    centres = np.array([r["vec"] for r in first], float)
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    clusters, axes = centres.shape
    original = now
    penalty = np.ones((clusters, len(names)))

    def sums_of(frame: DataFrame, centres: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums by cluster and batch of memberships, of unit vectors and of original vectors (column ``was``)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            o, y, s = np.zeros((clusters, len(names))), np.zeros((clusters, axes)), np.zeros((clusters, len(names), axes))
            for batch in batches:
                if batch.num_rows:
                    z, b = _rows(batch), np.searchsorted(names, batch.column("grp").to_numpy())
                    was = batch.column("was").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(z.shape)
                    r = memberships(z, b, centres, penalty, sigma)
                    y += r.T @ (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12))
                    for k in np.unique(b):
                        o[:, k] += r[b == k].sum(axis=0)
                        s[:, k] += r[b == k].T @ was[b == k]
            yield pa.RecordBatch.from_pydict({"sums": pa.array([np.concatenate([o.ravel(), y.ravel(), s.ravel()]).tolist()], pa.list_(pa.float64()))})

        parts = frame.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
        flat = np.array([r["x"] for r in parts])
        cut = clusters * len(names)
        return flat[:cut].reshape(clusters, -1), flat[cut : cut + clusters * axes].reshape(clusters, axes), flat[cut + clusters * axes :].reshape(clusters, len(names), axes)

    for _ in range(rounds):
        both = settled(now.join(original.select("id", F.col("vec").alias("was")), "id"))
        for _ in range(inner):
            o, y, _ = sums_of(both, centres, penalty)
            centres = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
            penalty = ((o.sum(axis=1, keepdims=True) * share + 1) / (o + 1)) ** theta
        o, _, s = sums_of(both, centres, penalty)
        shift = corrections(o, s, ridge)

        def move(batches: Iterator[pa.RecordBatch], centres=centres, penalty=penalty, shift=shift) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    z, b = _rows(batch), np.searchsorted(names, batch.column("grp").to_numpy())
                    was = batch.column("was").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(z.shape)
                    r = memberships(z, b, centres, penalty, sigma)
                    new = was - np.einsum("ik,ikd->id", r, shift[:, b].transpose(1, 0, 2))
                    yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "grp": batch.column("grp"), "vec": pa.array(list(new), pa.list_(pa.float64()))})

        now = settled(both.mapInArrow(move, _CORRECTED))
    return now
