"""Benchmark decontamination by an FM-index for each training shard.

Words are maximal runs of digits, letters a-z (A-Z lower-cased) and non-ASCII code points. A benchmark item's windows
are its runs of ``width`` consecutive words, or the whole item if it is shorter. Each shard of documents (a bounded
number of bytes within a task) gets an FM-index over word ids; all windows are searched backwards through
wavelet-matrix ranks, occurrences are located by sampled suffix positions, and overlapping hits merge into removal spans.

The index's alphabet is the benchmark's vocabulary. A word outside it is in no window, so it becomes a separator, and
so does a run of known words that is shorter than the shortest window: neither can take part in an occurrence.
Words are compared by 64-bit hashes.

The benchmark is read in blocks of at most about ``block_bytes`` of text; each block's windows go to the workers as a
bounded broadcast and the documents pass through all blocks in turn, without a shuffle. Between blocks the documents are
written to the shared folder, so that driver and workers hold one block at a time.

Defined cases: null or empty text has no words and is never contaminated; repeated documents each get a row; a null
``doc_id`` stays null; benchmark rows with a null id or no words are ignored; an item id that is given twice
counts once; an empty benchmark marks nothing. Other columns of either table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, byte_class, hashed_words, release, row_blocks, staged, utf8_views
from .fm_index import FMIndex

_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


class WindowSet:
    """A benchmark block's vocabulary, distinct windows (right-aligned word ids) and the items of each."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        column = pa.array([t for _, t in items], pa.large_string())
        data, offsets = utf8_views(column)
        hashes, _, _, rows = hashed_words(data, offsets, byte_class("alnum"))
        self.vocabulary = np.unique(hashes)
        ids = np.searchsorted(self.vocabulary, hashes) + 1
        names = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(names)}
        found: dict[bytes, set[int]] = {}
        for k, (item, _) in enumerate(items):
            own = ids[rows[k] : rows[k + 1]].astype(np.int64)
            if len(own):
                for i in range(max(1, len(own) - width + 1)):
                    found.setdefault(own[i : i + width].tobytes(), set()).add(number[item])
        self.names = names
        self.windows = np.zeros((len(found), width), np.int64)
        self.lengths = np.zeros(len(found), np.int64)
        owners = []
        for k, (raw, own) in enumerate(found.items()):
            w = np.frombuffer(raw, np.int64)
            self.windows[k, width - len(w) :] = w
            self.lengths[k] = len(w)
            owners.append(sorted(own))
        self.owner_at = np.concatenate([[0], np.cumsum([len(x) for x in owners])]).astype(np.int64)
        self.owners = np.array([x for own in owners for x in own], np.int64)
        self.sigma = len(self.vocabulary) + 1
        self.shortest = int(self.lengths.min()) if len(found) else 0

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids, 0 for words outside the vocabulary."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def search_shard(ids: np.ndarray, rows: np.ndarray, windows: WindowSet, sample: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Hits of a shard whose documents' word ids are ``ids[rows[d]:rows[d+1]]``: for each occurrence its window and the
    global number of its first word."""
    none = np.zeros(0, np.int64)
    known = ids > 0
    if windows.shortest == 0 or not known.any():
        return none, none
    # Runs of known words, cut at documents.
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    cuts = rows[1:-1][rows[1:-1] < len(ids)]
    begins[cuts] = known[cuts]
    ends = known.copy()
    ends[:-1] &= ~known[1:]
    ends[cuts[cuts > 0] - 1] = known[cuts[cuts > 0] - 1]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    kept = b - a >= windows.shortest
    a, b = a[kept], b[kept]
    if not len(a):
        return none, none
    size = b - a + 1  # a separator follows each run
    at = np.concatenate([[0], np.cumsum(size)])
    word = np.arange(at[-1]) + np.repeat(a - at[:-1], size)
    text = np.where(np.arange(at[-1]) == np.repeat(at[1:] - 1, size), 0, ids[np.minimum(word, len(ids) - 1)])
    index = FMIndex(text, windows.sigma, sample)
    lo, hi = index.search(windows.windows, windows.lengths)
    hit = np.flatnonzero(hi > lo)
    count = hi[hit] - lo[hit]
    if not len(hit):
        return none, none
    which = np.repeat(hit, count)
    rows_hit = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[hit], count)
    return which, word[index.locate(rows_hit)]


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of spans that overlap or touch."""
    order = np.argsort(starts, kind="stable")
    out: list[list[int]] = []
    for s, e in zip(starts[order].tolist(), ends[order].tolist(), strict=True):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _pass(windows: WindowSet, last: bool, shard_bytes: int, sample: int, carried: list[str]):
    """A mapInArrow function that adds a block's hits to each document's word spans and items. ``__text`` is what
    it reads; ``carried`` columns pass through."""
    is_word = byte_class("alnum")

    def shard(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8_views(batch.column("__text"))
        n = batch.num_rows
        parts, word_at, byte_starts, byte_ends = [], [np.zeros(1, np.int64)], [], []
        total = 0
        for i, j in row_blocks(offsets):
            h, s, e, r = hashed_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], is_word)
            parts.append(windows.ids(h) if windows.shortest else np.zeros(len(h), np.int64))
            word_at.append(r[1:] + total)
            if last:
                byte_starts.append((s + offsets[i]).astype(np.int64))
                byte_ends.append((e + offsets[i]).astype(np.int64))
            total += len(h)
        rows = np.concatenate(word_at)
        which, word = search_shard(np.concatenate(parts) if parts else np.zeros(0, np.int64), rows, windows, sample)
        spans: list[list[tuple[int, int]]] = [x or [] for x in batch.column("__word_spans").to_pylist()] if "__word_spans" in batch.schema.names else [[] for _ in range(n)]
        spans = [[(x["start"], x["end"]) if isinstance(x, dict) else x for x in own] for own in spans]
        items: list[list[str]] = [x or [] for x in batch.column("__item_ids").to_pylist()] if "__item_ids" in batch.schema.names else [[] for _ in range(n)]
        if len(which):
            doc = np.searchsorted(rows, word, "right") - 1
            order = np.argsort(doc, kind="stable")
            which, word, doc = which[order], word[order], doc[order]
            cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            for i, j in zip(cut, np.append(cut[1:], len(doc)), strict=True):
                d = int(doc[i])
                s = word[i:j] - rows[d]
                old = np.array(spans[d], np.int64).reshape(-1, 2)
                w = np.unique(which[i:j])
                spans[d] = _merged(np.append(s, old[:, 0]), np.append(s + windows.lengths[which[i:j]], old[:, 1]))
                owned = {windows.names[o] for x in w for o in windows.owners[windows.owner_at[x] : windows.owner_at[x + 1]]}
                items[d] = sorted(owned.union(items[d]))
        columns = {c: batch.column(c) for c in carried}
        if not last:
            columns["__text"] = batch.column("__text")
        as_spans = lambda x: pa.array([[{"start": s, "end": e} for s, e in own] for own in x], pa.list_(_SPAN))
        if last:
            starts = np.concatenate(byte_starts) if byte_starts else np.zeros(0, np.int64)
            ends = np.concatenate(byte_ends) if byte_ends else np.zeros(0, np.int64)
            chars: list[list[tuple[int, int]]] = [[] for _ in range(n)]
            for d in (d for d in range(n) if spans[d]):
                lead = np.concatenate([[0], np.cumsum((data[offsets[d] : offsets[d + 1]] & 0xC0) != 0x80)])
                chars[d] = [(int(lead[starts[rows[d] + s] - offsets[d]]), int(lead[ends[rows[d] + e - 1] - offsets[d]])) for s, e in spans[d]]
            columns["__n_words"] = pa.array(np.diff(rows), pa.int64())
            columns["__n_hit"] = pa.array([sum(e - s for s, e in own) for own in spans], pa.int64())
            columns["__spans"] = as_spans(chars)
        columns["__word_spans"] = as_spans(spans)
        columns["__item_ids"] = pa.array(items, pa.list_(pa.string()))
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            _, offsets = utf8_views(batch.column("__text"))
            for i, j in row_blocks(offsets, shard_bytes):
                part = int(offsets[j] - offsets[i])
                if held and size + part > shard_bytes:
                    yield shard(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, size = [], 0
                held.append(batch.slice(i, j - i))
                size += part
        if size or held:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()
            if whole:
                yield shard(whole[0])

    return run


def marked(documents: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 8 << 20, shard_bytes: int = 16 << 20, sample: int = 8) -> DataFrame:
    """``documents`` (text and any other columns) with ``__n_words``, ``__n_hit``, ``__spans`` (code points, end exclusive),
    ``__word_spans`` and ``__item_ids``."""
    bounded_batches(documents.sparkSession)
    asked = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    carried = documents.columns
    out = documents.withColumn("__text", F.col("text").cast("string"))
    spans, items, number = "array<struct<start:bigint,end:bigint>>", "array<string>", "bigint"
    typed = lambda frame, **more: frame.withColumns({k: F.lit(None).cast(v) for k, v in more.items()}).schema
    mid = typed(out, __word_spans=spans, __item_ids=items)
    end = typed(documents, __n_words=number, __n_hit=number, __spans=spans, __word_spans=spans, __item_ids=items)
    for b in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        windows = WindowSet([(r["item_id"], r["text"]) for r in block.toLocalIterator()], width)
        last = b == blocks - 1
        passed = out.mapInArrow(_pass(windows, last, shard_bytes, sample, carried), end if last else mid)
        out, before = passed if last else staged(passed, "benchmark-pass"), out
        release(before if b and not last else None)
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, **parameters: int) -> DataFrame:
    """For each document row: doc_id, n_words, n_hit, spans, word_spans, item_ids. Parameters as of ``marked``."""
    found = marked(documents.select("doc_id", "text"), benchmark, **parameters).drop("text")
    return found.toDF(*[c.removeprefix("__") for c in found.columns])
