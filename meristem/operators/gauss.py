"""Sums of Gaussian kernels between point sets, without the matrix of their pairs.

Two exact forms, alike but for rounding. ``Grid``, in the plane: boxes of 1.25 deviations with 16 x 16 Chebyshev nodes, between which the kernel is
a product of two banded matrices, so work grows with the points and the grid. ``Near``, in any dimension: cells no smaller than the kernel's reach,
each against its neighbours, a tile at a time. ``chosen`` takes the cheaper one.
"""

from __future__ import annotations

from itertools import product

import numpy as np

#: Nodes of a box along an axis, and a box's side in deviations: interpolation errs by about 4e-15 of the kernel's peak.
NODES, SIDE = 16, 1.25
#: Nodes of a grid along an axis at most.
WIDEST = 1600
#: Pairs of a tile.
TILE = 1 << 18

_K = np.arange(NODES)
_ZEROS = np.cos((2 * _K + 1) * np.pi / (2 * NODES))
_TO_NODES = np.cos(np.arccos(_ZEROS)[:, None] * _K) * np.where(_K == 0, 1.0, 2.0) / NODES


def _weights(t: np.ndarray) -> np.ndarray:
    """Interpolation weights of the nodes at ``t`` in [-1, 1]."""
    basis = np.ones((len(t), NODES))
    basis[:, 1] = t
    for k in range(2, NODES):
        basis[:, k] = 2 * t * basis[:, k - 1] - basis[:, k - 2]
    return basis @ _TO_NODES.T


class Grid:
    def __init__(self, y: np.ndarray, sigma2: float, low: np.ndarray, high: np.ndarray, reach: float):
        self.y, self.low, self.side = y, low, SIDE * np.sqrt(sigma2)
        self.boxes = np.maximum(1, np.ceil((high - low) / self.side).astype(int))
        self.band = int(np.ceil(reach / self.side)) + 1
        at = ((np.arange(-self.band, self.band + 1)[:, None] + (_ZEROS + 1) / 2) * self.side).ravel()
        middle = (_ZEROS + 1) / 2 * self.side
        self.kernel = np.exp(-((middle[:, None] - at[None]) ** 2) / (2 * sigma2))

    def _placed(self, x: np.ndarray):
        """(order, box starts, boxes, weights by axis) of points sorted by box."""
        scaled = (x - self.low) / self.side
        box = np.clip(scaled.astype(int), 0, self.boxes - 1)
        key = box[:, 0] * self.boxes[1] + box[:, 1]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        t = (2 * (scaled - box) - 1)[order]
        return order, np.append(first, len(x)), box[order[first]] * NODES, _weights(t[:, 0]), _weights(t[:, 1])

    def spread(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Weights ``w`` (rows by points) moved to the nodes."""
        order, first, corners, u, v = self._placed(x)
        out, w = np.zeros((len(w), *(self.boxes * NODES))), w[:, order]
        for lo, hi, (a, b) in zip(first, first[1:], corners.tolist(), strict=False):
            out[:, a : a + NODES, b : b + NODES] += (u[lo:hi].T * w[:, None, lo:hi]) @ v[lo:hi]
        return out

    def blurred(self, g: np.ndarray) -> np.ndarray:
        """Kernel sums at the nodes."""
        for axis in (1, 2):
            n, out = int(self.boxes[axis - 1]), np.empty_like(g)
            for b in range(n):
                lo, hi = max(0, b - self.band), min(n, b + self.band + 1)
                part = self.kernel[:, (lo - b + self.band) * NODES : (hi - b + self.band) * NODES]
                own, met = slice(b * NODES, (b + 1) * NODES), slice(lo * NODES, hi * NODES)
                if axis == 1:
                    out[:, own] = part @ g[:, met]
                else:
                    out[:, :, own] = g[:, :, met] @ part.T
            g = out
        return g

    def at(self, field: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Kernel sums at ``x``, rows by points."""
        order, first, corners, u, v = self._placed(x)
        out = np.empty((len(field), len(x)))
        for lo, hi, (a, b) in zip(first, first[1:], corners.tolist(), strict=False):
            out[:, order[lo:hi]] = ((u[lo:hi] @ field[:, a : a + NODES, b : b + NODES]) * v[lo:hi]).sum(axis=2)
        return out

    def begin(self, weights: np.ndarray) -> None:
        self.weights, self.back = weights, 0.0
        self.field = self.blurred(self.spread(self.y, weights[None]))

    def add(self, x: np.ndarray, constant: float) -> np.ndarray:
        """Each point's posterior mass."""
        sums = np.maximum(self.at(self.field, x)[0], 0.0)
        q = 1.0 / (sums + constant)
        self.back = self.back + self.spread(x, np.vstack([q, q * x.T]))
        return sums * q

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        """(mass, mass-weighted targets) of each moving point."""
        if np.ndim(self.back) == 0:
            return np.zeros(len(self.y)), np.zeros(self.y.shape)
        back = self.at(self.blurred(self.back), self.y) * self.weights
        return np.maximum(back[0], 0.0), back[1:].T


def _cells(x: np.ndarray, low: np.ndarray, side: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return np.clip(((x - low) / side).astype(int), 0, shape - 1)


class Near:
    def __init__(self, y: np.ndarray, sigma2: float, low: np.ndarray, high: np.ndarray, reach: float):
        self.y, self.sigma2, self.low = y, sigma2, low
        # Cells of some tens of points at least, on average; a single one where coordinates are not finite.
        width = np.where(np.isfinite(high - low), high - low, 0.0)
        self.side = np.maximum(np.maximum(reach, width * (64 / max(1, len(y))) ** (1 / len(low))), np.finfo(float).tiny)
        self.whole = not (np.isfinite(low).all() and np.isfinite(high).all() and np.isfinite(y).all())
        self.shape = np.ones(len(low), int) if self.whole else np.maximum(1, np.minimum(1 << 20, np.ceil(width / self.side)).astype(int))
        self.side = np.maximum(self.side, width / self.shape)
        cell = np.zeros(y.shape, int) if self.whole else _cells(y, low, self.side, self.shape)
        key = np.ravel_multi_index(tuple(cell.T), self.shape) if len(y) else np.zeros(0, int)
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]
        self.sorted = y[self.order]

    def pairs(self) -> float:
        """Pairs of moving points in neighbouring cells."""
        found, count = np.unique(self.key, return_counts=True)
        cells = np.column_stack(np.unravel_index(found, self.shape)) if len(found) else np.zeros((0, len(self.shape)), int)
        return float(sum(n * sum(hi - lo for lo, hi in self._met(c)) for n, c in zip(count.tolist(), cells, strict=True)))

    def _met(self, cell: np.ndarray) -> list[tuple[int, int]]:
        """Runs of the sorted moving points in a cell and its neighbours; along the last axis cells follow each other."""
        out = []
        last = int(self.shape[-1])
        a, b = max(0, int(cell[-1]) - 1), min(last - 1, int(cell[-1]) + 1)
        for move in product((-1, 0, 1), repeat=len(cell) - 1):
            near = [int(c) + m for c, m in zip(cell[:-1], move, strict=True)]
            if all(0 <= c < n for c, n in zip(near, self.shape[:-1].tolist(), strict=True)):
                base = 0
                for c, n in zip(near, self.shape[:-1].tolist(), strict=True):
                    base = base * n + c
                lo, hi = np.searchsorted(self.key, [base * last + a, base * last + b + 1])
                if hi > lo:
                    out.append((int(lo), int(hi)))
        return out

    def begin(self, weights: np.ndarray) -> None:
        self.weights = weights[self.order]
        self.mass, self.target = np.zeros(len(self.y)), np.zeros(self.y.shape)

    def add(self, x: np.ndarray, constant: float) -> np.ndarray:
        out = np.zeros(len(x))
        if not len(x):
            return out
        cell = np.zeros(x.shape, int) if self.whole else _cells(x, self.low, self.side, self.shape)
        key = np.ravel_multi_index(tuple(cell.T), self.shape)
        order = np.argsort(key, kind="stable")
        first = np.append(np.flatnonzero(np.diff(key[order], prepend=-1)), len(x))
        for lo, hi in zip(first, first[1:], strict=False):
            runs = self._met(cell[order[lo]])
            if not runs:
                continue
            met = self.sorted[runs[0][0] : runs[0][1]] if len(runs) == 1 else np.concatenate([self.sorted[a:b] for a, b in runs])
            w = np.concatenate([self.weights[a:b] for a, b in runs])
            step = max(1, TILE // len(met))
            for i in range(lo, hi, step):
                part = x[order[i : min(hi, i + step)]]
                k = np.zeros((len(part), len(met)))
                for axis in range(x.shape[1]):
                    by = part[:, axis, None] - met[None, :, axis]
                    by *= by
                    k += by
                k *= -0.5 / self.sigma2
                np.exp(k, out=k)
                sums = k @ w
                q = 1.0 / (sums + constant)
                out[order[i : min(hi, i + step)]] = sums * q
                back = np.vstack([q, q * part.T]) @ k * w
                at = 0
                for a, b in runs:
                    self.mass[a:b] += back[0, at : at + b - a]
                    self.target[a:b] += back[1:, at : at + b - a].T
                    at += b - a
        return out

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        mass, target = np.empty_like(self.mass), np.empty_like(self.target)
        mass[self.order], target[self.order] = self.mass, self.target
        return mass, target


def chosen(y: np.ndarray, n: int, sigma2: float, constant: float, low: np.ndarray, high: np.ndarray) -> tuple[type, float]:
    """(form, reach) for ``n`` points against ``y``. Beyond the reach all kernels together are under rounding beside the least denominator."""
    reach = float(np.sqrt(2 * sigma2 * (33 + max(0.0, np.log(max(1, len(y)) / max(constant, 1e-290))))))
    if len(low) == 2 and len(y) and np.isfinite(low).all() and np.isfinite(high).all() and np.isfinite(y).all():
        nodes = np.ceil((high - low) / (SIDE * np.sqrt(sigma2))) * NODES
        # Seconds of a core, about: 8 ns a pair; grids of four fields, 0.2 ns a node and node of its band, and 1 us a point.
        if nodes.max() <= WIDEST:
            grid = 4 * nodes.prod() * 2 * NODES * min(nodes.max() / NODES, 2 * reach / (SIDE * np.sqrt(sigma2)) + 3) * 0.2e-9 + 1e-6 * (len(y) + n)
            if grid < 8e-9 * Near(y, sigma2, low, high, reach).pairs() * n / len(y):
                return Grid, reach
    return Near, reach
