"""Hashed n-gram counts of whole texts, vectorised over blocks of documents."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_rng = np.random.default_rng(31)
_MIX = _rng.integers(1, 1 << 63, (8, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(1)
def letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for anything that is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, and offsets by document in code points."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, lead[offsets]


def gram_ids(points: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every n-gram of ``points``; n-grams don't cross documents."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    p = points.astype(np.uint64)
    docs, features = [], []
    for n in orders:
        m = len(p) - n + 1
        if m <= 0:
            continue
        h = np.full(m, _MIX[n, 7], np.uint64)
        for k in range(n):
            h += p[k : k + m] * _MIX[n, k]
        h ^= h >> np.uint64(29)
        h *= _MIX[0, 0]
        whole = owner[:m] == owner[n - 1 :]
        docs.append(owner[:m][whole])
        features.append((h >> np.uint64(64 - bits)).astype(np.int64)[whole])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(features)


def count_matrix(docs: np.ndarray, features: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Documents x features counts."""
    return np.bincount((docs << bits) | features, minlength=n << bits).reshape(n, 1 << bits)
