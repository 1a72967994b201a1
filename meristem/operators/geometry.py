"""Homogeneous transforms, normalisation and least-squares estimates from moments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transform_points(points: DataFrame, matrix: np.ndarray, axes: tuple[str, ...] = ("x", "y"), inverse: bool = False) -> DataFrame:
    """Coordinates after a homogeneous matrix (with its perspective divide)."""
    m = np.linalg.inv(matrix) if inverse else np.asarray(matrix, float)
    d = len(axes)
    line = lambda i: sum((F.lit(float(m[i, j])) * F.col(a) for j, a in enumerate(axes)), F.lit(float(m[i, d])))
    affine = np.allclose(m[d], np.eye(d + 1)[d])
    return points.withColumns({a: line(i) if affine else F.try_divide(line(i), line(d)) for i, a in enumerate(axes)})


def transform_by_slice(points: DataFrame, matrices: DataFrame, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Each slice's own affine ``matrix`` (row-major array of d+1 squared), joined on ``slice``."""
    d = len(axes) + 1
    m = lambda i, j: F.col("matrix")[i * d + j]
    new = {a: sum((m(i, j) * F.col(b) for j, b in enumerate(axes)), m(i, d - 1)) for i, a in enumerate(axes)}
    return points.join(matrices, "slice").withColumns(new).drop("matrix")


def compose(rotation=None, scale=None, shift=None, d: int = 2) -> np.ndarray:
    """A homogeneous matrix from rotation, scale and shift."""
    m = np.eye(d + 1)
    r = np.eye(d) if rotation is None else np.asarray(rotation, float)
    s = np.ones(d) if scale is None else np.broadcast_to(np.asarray(scale, float), (d,))
    m[:d, :d] = r * s[None, :]
    if shift is not None:
        m[:d, d] = shift
    return m


def decompose(matrix: np.ndarray) -> dict[str, np.ndarray]:
    """Rotation, scale, skew and shift of an affine matrix, by QR with positive scales."""
    d = len(matrix) - 1
    q, r = np.linalg.qr(matrix[:d, :d])
    sign = np.sign(np.diag(r))
    sign[sign == 0] = 1
    q, r = q * sign[None, :], r * sign[:, None]
    return {"rotation": q, "scale": np.diag(r), "skew": r / np.diag(r)[:, None] - np.eye(d), "shift": matrix[:d, d]}


def padded(points: DataFrame, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Points (id, grp, axes) with each slice moved to the middle of a frame of the largest slice's extent, which begins at 0."""
    box = points.groupBy("grp").agg(*[f(a).alias(f"{a}_{n}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))])
    wide = box.agg(*[F.max(F.col(f"{a}_hi") - F.col(f"{a}_lo")).alias(f"{a}_wide") for a in axes]).first()
    moved = [(F.col(a) - F.col(f"{a}_lo") + (F.lit(wide[f"{a}_wide"]) - F.col(f"{a}_hi") + F.col(f"{a}_lo")) / 2).alias(a) for a in axes]
    return points.join(box, "grp").select("id", "grp", *moved)


def chain(matrices: list[np.ndarray]) -> np.ndarray:
    """The product that applies the first matrix first."""
    out = np.eye(len(matrices[0]))
    for m in matrices:
        out = m @ out
    return out


def along_tree(edges: list[tuple[int, int]], pairwise: dict[tuple[int, int], np.ndarray], root: int) -> dict[int, np.ndarray]:
    """Matrices to the root's frame, composed along (parent, child) edges."""
    d = len(next(iter(pairwise.values()))) if pairwise else 3
    out = {root: np.eye(d)}
    for parent, child in edges:
        out[child] = out[parent] @ pairwise[(parent, child)]
    return out


def centre_scale(points: DataFrame, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Centred coordinates over sqrt(sum of squares / (n d / 2))."""
    return _scaled(points, axes, len(axes) / 2)


def _scaled(points: DataFrame, axes: tuple[str, ...], part: float) -> DataFrame:
    means = points.agg(F.count("*").alias("__n"), *[F.avg(a).alias(f"__m_{a}") for a in axes], sum((F.var_pop(a) for a in axes), F.lit(0.0)).alias("__v"))
    size = F.sqrt(F.col("__v") / part)
    out = points.crossJoin(F.broadcast(means))
    return out.withColumns({a: F.coalesce(F.try_divide(F.col(a) - F.col(f"__m_{a}"), size), F.lit(0.0)) for a in axes}).drop(*means.columns)


def scale_about_centre(points: DataFrame, factor: float, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Scaling about the bounding box's centre."""
    box = points.agg(*[((F.min(a) + F.max(a)) / 2).alias(f"__c_{a}") for a in axes])
    return points.crossJoin(F.broadcast(box)).withColumns({a: (F.col(a) - F.col(f"__c_{a}")) * factor + F.col(f"__c_{a}") for a in axes}).drop(*box.columns)


def mirror(points: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """max - coordinate on the chosen axes."""
    box = points.agg(*[F.max(a).alias(f"__h_{a}") for a in axes])
    return points.crossJoin(F.broadcast(box)).withColumns({a: F.col(f"__h_{a}") - F.col(a) for a in axes}).drop(*box.columns)


def moments(pairs: DataFrame, src: tuple[str, ...], dst: tuple[str, ...], weight: str | None = None) -> dict:
    """Weighted means, cross moments and source moments of matched coordinates: one aggregate row."""
    w = F.col(weight) if weight else F.lit(1.0)
    names = [*src, *dst]
    exprs = [F.sum(w).alias("w")] + [F.sum(w * F.col(a)).alias(f"s_{a}") for a in names]
    exprs += [F.sum(w * F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    row = pairs.agg(*exprs).first()
    n = len(names)
    second = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            second[i, j] = second[j, i] = row[f"p_{i}_{j}"]
    return {"w": row["w"], "sum": np.array([row[f"s_{a}"] for a in names]), "second": second, "d": len(src)}


def procrustes(m: dict, scale: bool = False, per_axis: bool = False) -> np.ndarray:
    """The rigid or similarity matrix that maps src to dst in least squares, from ``moments`` (determinant kept positive)."""
    d, w = m["d"], m["w"]
    mean = m["sum"] / w
    cov = m["second"] / w - np.outer(mean, mean)
    sigma = cov[d:, :d]  # dst x src
    u, s, vt = np.linalg.svd(sigma)
    flip = np.ones(d)
    if np.linalg.det(u) * np.linalg.det(vt) < 0:
        flip[-1] = -1
    r = u @ np.diag(flip) @ vt
    if per_axis:
        k = np.diag(r.T @ sigma) / np.maximum(np.diag(cov[:d, :d]), 1e-12)
    else:
        k = np.full(d, (s * flip).sum() / max(np.trace(cov[:d, :d]), 1e-12) if scale else 1.0)
    out = np.eye(d + 1)
    out[:d, :d] = r * k[None, :]
    out[:d, d] = mean[d:] - out[:d, :d] @ mean[:d]
    return out


def affine_fit(m: dict, ridge: float = 0.0) -> np.ndarray:
    """The affine matrix of least squares, from ``moments``."""
    d, w = m["d"], m["w"]
    mean = m["sum"] / w
    cov = m["second"] / w - np.outer(mean, mean)
    a = np.linalg.solve(cov[:d, :d] + ridge * np.eye(d), cov[:d, d:] + ridge * np.eye(d)).T
    out = np.eye(d + 1)
    out[:d, :d] = a
    out[:d, d] = mean[d:] - a @ mean[:d]
    return out


def kernel_displace(points: DataFrame, control: np.ndarray, weights: np.ndarray, beta: float, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """y + sum_j exp(-|y - c_j|^2 / beta) w_j over a bounded set of control points, given as literals' arrays."""
    table = points.sparkSession.createDataFrame([(*map(float, c), *map(float, w)) for c, w in zip(control, weights, strict=True)], [*[f"c{i}" for i in range(len(axes))], *[f"w{i}" for i in range(len(axes))]])
    near = points.select("id", *axes).crossJoin(F.broadcast(table))
    square = sum(((F.col(a) - F.col(f"c{i}")) ** 2 for i, a in enumerate(axes)), F.lit(0.0))
    k = F.exp(-square / float(beta))
    moved = near.groupBy("id").agg(*[F.sum(k * F.col(f"w{i}")).alias(f"__d_{a}") for i, a in enumerate(axes)])
    return points.join(moved, "id").withColumns({a: F.col(a) + F.col(f"__d_{a}") for a in axes}).drop(*[f"__d_{a}" for a in axes])


def mean_square_distance(a: DataFrame, b: DataFrame, axes: tuple[str, ...] = ("x", "y")) -> float:
    """Mean squared distance over all cross pairs, from sums alone."""
    row = lambda t: t.agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in axes], sum((F.sum(F.col(c) * F.col(c)) for c in axes), F.lit(0.0)).alias("q")).first()
    x, y = row(a), row(b)
    cross = sum(x[f"s_{c}"] * y[f"s_{c}"] for c in axes)
    return x["q"] / x["n"] + y["q"] / y["n"] - 2 * cross / (x["n"] * y["n"])


def next_square_distances(points: DataFrame, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(grp, sigma2): mean squared distance over all cross pairs of each group and the next, from sums alone."""
    square = sum((F.col(c) * F.col(c) for c in axes), F.lit(0.0))
    own = points.groupBy("grp").agg(F.avg(square).alias("q"), *[F.avg(c).alias(f"m_{c}") for c in axes])
    after = own.select((F.col("grp") - 1).alias("grp"), F.col("q").alias("q2"), *[F.col(f"m_{c}").alias(f"n_{c}") for c in axes])
    cross = sum((F.col(f"m_{c}") * F.col(f"n_{c}") for c in axes), F.lit(0.0))
    return own.join(after, "grp").select("grp", (F.col("q") + F.col("q2") - 2 * cross).alias("sigma2"))


def rescaled_matrix(m: np.ndarray, scale: float | list[float], back: bool = True) -> np.ndarray:
    """A homogeneous matrix for scaled axes: the scale (linear part and shift alike) after ``m``, and with ``back`` the inverse axis scale
    before it."""
    d = len(m) - 1
    s = np.broadcast_to(np.asarray(scale, float), d)
    left, right = np.diag([*s, 1.0]), np.diag([*(1 / s), 1.0])
    left[:d, d] = s
    return left @ m @ right if back else left @ m


def swapped_axes(m: np.ndarray, i: int = 0, j: int = 1) -> np.ndarray:
    """A homogeneous matrix for points whose axes i and j changed places."""
    order = np.arange(len(m))
    order[[i, j]] = order[[j, i]]
    return m[np.ix_(order, order)]


def mirrored(m: np.ndarray, size: int, axis: int = 0) -> np.ndarray:
    """A homogeneous matrix for a grid of ``size`` places that was mirrored along an axis: place p is size - 1 - p."""
    flip = np.eye(len(m))
    flip[axis, axis], flip[axis, -1] = -1, size - 1
    return m @ flip


def rescaled(points: DataFrame, scales: DataFrame, axes: tuple[str, ...] = ("x", "y"), back: bool = False) -> DataFrame:
    """Points (grp, axes) times their slice's scale (grp, scale), or over it with ``back``; a slice without a scale stays."""
    s = F.coalesce(F.col("__s"), F.lit(1.0))
    both = points.join(scales.select("grp", F.col("scale").cast("double").alias("__s")), "grp", "left")
    return both.withColumns({a: F.col(a) / s if back else F.col(a) * s for a in axes}).drop("__s")
