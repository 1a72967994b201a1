"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained with
follow-the-regularised-leader and elastic-net penalties, then calibrated by temperature.

Text is reduced to lower-case letters, anything else is a space; 1- to 3-grams are hashed to ``2**bits`` features. Document
frequencies cover every learning document. The weights are fitted on a bounded sample, ``per_language`` documents of each
language chosen by hash (about ``most`` in all, at least ``least`` of each), of which every fifth is kept for the temperature. All
languages are learned.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any learning document every
text is ``und``; rows without a language or doc_id teach nothing; repeated rows teach and are scored each; other columns are
carried or ignored, never read, but for ``__lang`` and ``__score``, which the results replace.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, row_blocks, utf8_views
from .ngrams import code_points, count_matrix, gram_ids, letters

ORDERS = (1, 2, 3)


@dataclass
class LanguageModel:
    languages: list[str]
    bits: int
    idf: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.weights + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def _blocks(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges with their n-gram counts and whether each text has a letter."""
    table = letters()
    data, offsets = utf8_views(batch.column("text"))
    for i, j in row_blocks(offsets):
        for a in range(i, j, 64):
            b = min(j, a + 64)
            points, at = code_points(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            points = table[points]
            docs, features = gram_ids(points, at, ORDERS, bits)
            seen = np.concatenate([[0], np.cumsum(points != 32)])
            yield a, b, count_matrix(docs, features, b - a, bits), seen[at[1:]] > seen[at[:-1]]


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(norm, 1e-12)[:, None]


def _frequencies(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for a, b, counts, _ in _blocks(batch, bits):
                total += (counts > 0).sum(axis=0)
                n += b - a
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(np.append(at, -1), pa.int64()), "n": pa.array(np.append(total[at], n), pa.int64())})

    return run


def _sparse(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, value = [], []
            for _, _, counts, _ in _blocks(batch, bits):
                for row in counts:
                    at = np.flatnonzero(row)
                    index.append(at.astype(np.int32).tobytes())
                    value.append(row[at].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "features": pa.array(index, pa.binary()), "counts": pa.array(value, pa.binary())})

    return run


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], dims: int, classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4, seed: int = 5
) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-proximally-regularised-leader over sparse rows (features, values, class): weights and bias."""
    z, n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(seed)
    rows = [(np.append(i, dims), np.append(v, 0.3), y) for i, v, y in rows]
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i, v, y = rows[k]
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = v[:, None] * p[None, :]
            g2 = g * g
            z[i] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / alpha * w
            n[i] = ni + g2
    w = weights(z, n)
    return w[:dims], w[dims] * 0.3


def fit_temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    if not len(classes):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(classes)), classes]))

    lo, hi, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(documents: DataFrame, per_language: int = 800, most: int = 20_000, least: int = 20, bits: int = 14) -> LanguageModel:
    """Fit a model on ``documents`` (doc_id, text, lang); rows with a null among them teach nothing. Every language is learned: from about
    ``per_language`` documents, of many languages from fewer, so that all together are about ``most``, yet ``least`` of each."""
    bounded_batches(documents.sparkSession)
    known = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    tally = known.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in tally)
    frequency = np.zeros(1 << bits)
    total = 0
    for r in known.select("text").mapInArrow(_frequencies(bits), "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        if r["feature"] >= 0:
            frequency[r["feature"]] = r["n"]
        else:
            total = r["n"]
    idf = np.log((1 + total) / (1 + frequency)).astype(np.float32) + np.float32(1)
    model = LanguageModel(languages, bits, idf)
    if not languages:
        return model
    # Chosen by hash, about as many documents of each language at any size of the table.
    wanted = min(per_language, max(least, most // len(languages)))
    share = {r["lang"]: min(1.0, wanted / r["count"]) for r in tally}
    limits = F.create_map(*[F.lit(x) for lang, s in share.items() for x in (lang, int(s * (1 << 40)))])
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 40)) < F.coalesce(F.try_element_at(limits, F.col("lang")), F.lit(0)))
    rows, held, number = [], [], {x: k for k, x in enumerate(languages)}
    sparse = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(_sparse(bits), "doc_id bigint, lang string, features binary, counts binary")
    got = sparse.collect()  # about ``most`` rows, or ``least`` of each language
    for k, r in enumerate(sorted(got, key=lambda r: (r["doc_id"], r["lang"]))):
        i = np.frombuffer(r["features"], np.int32).astype(np.int64)
        v = np.log1p(np.frombuffer(r["counts"], np.int32)) * idf[i]
        v = v / max(1e-12, float(np.sqrt(v @ v)))
        (held if k % 5 == 0 and len(got) > 20 else rows).append((i, v, number[r["lang"]]))
    w, b = fit_ftrl(rows, 1 << bits, len(languages))
    model.weights, model.bias = w.astype(np.float32), b
    logits = np.array([v @ w[i] + b for i, v, _ in held]).reshape(len(held), len(languages))
    model.temperature = fit_temperature(logits, np.array([y for _, _, y in held], np.int64))
    return model


def _predict(model: LanguageModel, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if model.languages:
                for a, b, counts, lettered in _blocks(batch, model.bits):
                    p = model.probabilities(tf_idf(counts, model.idf))
                    best = p.argmax(axis=1)
                    for k in np.flatnonzero(lettered):
                        names[a + k] = model.languages[best[k]]
                        scores[a + k] = p[k, best[k]]
            out = {c: batch.column(c) for c in columns} | {"__lang": pa.array(names, pa.string()), "__score": pa.array(np.clip(scores, 0, 1))}
            yield pa.RecordBatch.from_pydict(out)

    return run


def predict(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """``documents`` (text and any other columns) with ``__lang`` and ``__score``."""
    bounded_batches(documents.sparkSession)
    documents = documents.drop("__lang", "__score").withColumn("text", F.col("text").cast("string"))
    schema = documents.withColumns({"__lang": F.lit("").cast("string"), "__score": F.lit(0.0)}).schema
    return documents.mapInArrow(_predict(model, documents.columns), schema)


def fold(column: str, folds: int):
    """crc32 of an id's decimal text, modulo ``folds``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds
