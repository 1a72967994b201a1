"""Quality classification by naive Bayes support vectors.

Features are indicators of hashed n-grams of a whole text: case-sensitive character 1- to 3-grams, and word n-grams
reduced to whether neighbouring words are equal (runs of a repeated word). Class counts of every indicator cover all
labelled learning documents and give log-count ratios; a document's indicators are scaled by them and to unit
length. A linear hinge-loss model is fitted by dual coordinate descent on a bounded sample of ``most`` labelled
documents chosen by hash; a logistic curve over held-out fifths' margins turns margins into scores.

Defined cases: a null text counts as empty; an empty text has no indicator and gets the score of the bias alone; without labels,
or with one class only, every score is that class's smoothed share; repeated label rows of a document count each;
null labels and ids teach nothing; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, byte_class, hashed_words, row_blocks, staged, utf8_views
from .ngrams import code_points, count_matrix, gram_ids

ORDERS = (1, 2, 3)


@dataclass
class QualityModel:
    bits: int
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, present: np.ndarray) -> np.ndarray:
        margin = unit(present, self.ratios) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def unit(present: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Indicators scaled by the ratios, then to unit length."""
    x = present * ratios
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(norm, 1e-12)[:, None]


#: Lengths of runs of equal words that are features of their own.
RUNS = ((2, 2), (3, 3), (4, 7), (8, 1 << 60))


def columns(bits: int) -> int:
    """How many indicators a document has."""
    return (1 << bits) + len(RUNS)


def _blocks(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row ranges with their indicator matrices; behind the n-grams' columns those of runs of 2, 3, 4-7 and 8 equal words."""
    data, offsets = utf8_views(batch.column("text"))
    spaces = byte_class("nonspace")
    for i, j in row_blocks(offsets):
        for a in range(i, j, 32):
            b = min(j, a + 32)
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            points, pat = code_points(part, at)
            docs, features = gram_ids(points, pat, ORDERS, bits)
            present = np.concatenate([count_matrix(docs, features, b - a, bits) > 0, np.zeros((b - a, len(RUNS)), bool)], axis=1)
            words, _, _, rows = hashed_words(part, at, spaces)
            if len(words):
                owner = np.repeat(np.arange(b - a), np.diff(rows))
                same = np.append(False, (words[1:] == words[:-1]) & (owner[1:] == owner[:-1]))
                starts = np.flatnonzero(~same)
                run = np.diff(np.append(starts, len(words)))
                for k, (lo, hi) in enumerate(RUNS):
                    present[owner[starts[(run >= lo) & (run <= hi)]], (1 << bits) + k] = True
            yield a, b, present


def _evidence(bits: int):
    """mapInArrow over labelled documents: class counts of a task's indicators, and the sampled documents' indicators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, size = np.zeros((2, columns(bits)), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            sampled = batch.column("sampled").to_numpy(zero_copy_only=False)
            ids, labels, rows = [], [], []
            key = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b, present in _blocks(batch, bits):
                for y in (0, 1):
                    counts[y] += present[label[a:b] == y].sum(axis=0)
                    size[y] += int((label[a:b] == y).sum())
                for k in np.flatnonzero(sampled[a:b]):
                    ids.append(int(key[a + k]))
                    labels.append(int(label[a + k]))
                    rows.append(np.flatnonzero(present[k]).astype("<i4").tobytes())
            n = len(ids)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "label": pa.array(labels, pa.int32()), "features": pa.array(rows, pa.binary()), "feature": pa.nulls(n, pa.int32()), "n0": pa.nulls(n, pa.int64()), "n1": pa.nulls(n, pa.int64())})
        at = np.flatnonzero(counts.sum(axis=0))
        n = len(at) + 1
        yield pa.RecordBatch.from_pydict(
            {"doc_id": pa.nulls(n, pa.int64()), "label": pa.nulls(n, pa.int32()), "features": pa.nulls(n, pa.binary()), "feature": pa.array(np.append(at, -1), pa.int32()), "n0": pa.array(np.append(counts[0, at], size[0])), "n1": pa.array(np.append(counts[1, at], size[1]))}
        )

    return run


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, dims: int, cost: np.ndarray, epochs: int = 25, seed: int = 3) -> np.ndarray:
    """Dual coordinate descent for the L1-loss linear SVM over sparse rows; the last weight is the bias."""
    w = np.zeros(dims + 1)
    alpha = np.zeros(len(rows))
    rows = [(np.append(i, dims), np.append(v, 1.0)) for i, v in rows]
    square = np.array([v @ v for _, v in rows])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for k in order.permutation(len(rows)):
            i, v = rows[k]
            g = signs[k] * (v @ w[i]) - 1.0
            if (alpha[k] <= 0 and g >= 0) or (alpha[k] >= cost[k] and g <= 0):
                continue
            worst = max(worst, abs(g))
            new = min(max(alpha[k] - g / square[k], 0.0), cost[k])
            w[i] += (new - alpha[k]) * signs[k] * v
            alpha[k] = new
        if worst < 1e-3:
            break
    return w


def fit_logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of least log loss with smoothed targets (Newton steps)."""
    positive, n = labels.sum(), len(labels)
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (n - positive + 2))
    slope, shift = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -40, 40)))
        d, w = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([d @ margins + 1e-6 * slope, d.sum()])
        h = np.array([[w @ (margins * margins) + 1e-6, w @ margins], [w @ margins, w.sum()]]) + 1e-9 * np.eye(2)
        move = np.linalg.solve(h, g)
        step = min(1.0, 5.0 / max(1e-12, float(np.abs(move).max())))
        slope, shift = slope - step * move[0], shift - step * move[1]
        if np.abs(move).max() < 1e-8:
            break
    return float(slope), float(shift)


def train(documents: DataFrame, labels: DataFrame, most: int = 4000, bits: int = 15, smoothing: float = 1.0, blend: float = 0.25, cost: float = 1.0) -> QualityModel:
    """Fit on ``documents`` (doc_id, text) and ``labels`` (doc_id, label 0/1)."""
    bounded_batches(documents.sparkSession)
    dims = columns(bits)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    share = most / max(1, known.count())
    # Chosen by hash: about ``most`` documents at any size of the table.
    known = known.withColumn("sampled", F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 40)) < int(min(1.0, share) * (1 << 40)))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Labels grow with the corpus: they are merged, never broadcast.
    evidence = staged(texts.join(known.hint("merge"), "doc_id").mapInArrow(_evidence(bits), "doc_id bigint, label int, features binary, feature int, n0 bigint, n1 bigint"), "quality-evidence")
    counts, size = np.zeros((2, dims)), np.zeros(2)
    for r in evidence.where("feature IS NOT NULL").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect():
        if r["feature"] >= 0:
            counts[:, r["feature"]] = r["n0"], r["n1"]
        else:
            size[:] = r["n0"], r["n1"]
    ratios = (np.log((counts[1] + smoothing) / (counts[1].sum() + smoothing * dims)) - np.log((counts[0] + smoothing) / (counts[0].sum() + smoothing * dims))).astype(np.float32)
    got = sorted(evidence.where("feature IS NULL").select("doc_id", "label", "features").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * most).collect(), key=lambda r: (r["doc_id"], r["label"]))
    labels_ = np.array([r["label"] for r in got], np.int64)
    if len(set(labels_.tolist())) < 2:
        p = (size[1] + 1) / (size.sum() + 2)
        return QualityModel(bits, ratios, np.zeros(dims), 0.0, 0.0, float(np.log(p / (1 - p))))
    rows = []
    for r in got:
        i = np.frombuffer(r["features"], "<i4").astype(np.int64)
        v = ratios[i].astype(float)
        rows.append((i, v / max(1e-12, float(np.sqrt(v @ v)))))
    signs = np.where(labels_ == 1, 1.0, -1.0)
    balance = np.where(labels_ == 1, 0.5 * len(got) / labels_.sum(), 0.5 * len(got) / (len(got) - labels_.sum()))

    def blended(train_on: np.ndarray) -> np.ndarray:
        w = fit_svm([rows[k] for k in train_on], signs[train_on], dims, cost * balance[train_on])
        # The published blend of the model with its mean weight.
        w[:dims] = (1 - blend) * np.abs(w[:dims]).mean() + blend * w[:dims] if blend < 1 else w[:dims]
        return w

    everything = np.arange(len(got))
    margins = np.zeros(len(got))
    for f in range(3):
        held = everything % 3 == f
        if held.all() or len(set(labels_[~held].tolist())) < 2:
            continue
        w = blended(everything[~held])
        margins[held] = [rows[k][1] @ w[rows[k][0]] + w[dims] for k in everything[held]]
    slope, shift = fit_logistic(margins, labels_)
    w = blended(everything)
    return QualityModel(bits, ratios, w[:dims].astype(np.float32), float(w[dims]), slope, shift)


def _score(model: QualityModel, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for a, b, present in _blocks(batch, model.bits):
                scores[a:b] = model.scores(present)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in columns} | {"__score": pa.array(scores)})

    return run


def score(documents: DataFrame, model: QualityModel) -> DataFrame:
    """``documents`` (text and any other columns) with ``__score``, the likelihood of label 1."""
    documents = documents.withColumn("text", F.col("text").cast("string"))
    return documents.mapInArrow(_score(model, documents.columns), documents.withColumn("__score", F.lit(0.0)).schema)
