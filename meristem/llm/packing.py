"""Sequence packing: shortest-pack-first over the length histogram.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. The histogram of piece lengths (at most
``capacity`` rows) is packed on the driver: lengths from the longest down go to the packs with the most room, as
counts of packing patterns. A pattern's slots then take ranges of ranks within a length, and every piece finds
its slot by its own rank: a piece's rank is its number among pieces of that length in its task, plus the pieces of that
length in earlier tasks. No step gathers the pieces of a length, however common it is.

Defined cases: a null or empty text is the end token alone; repeated documents are packed as often as they occur;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import bounded_batches, staged
from .word_tokens import WordTokenizer

_TOKENIZERS: dict[str, WordTokenizer] = {}


def _pieces(path: str | None, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        where = path or public_tokenizers.path("word_bpe_49k.json")
        tokenizer = _TOKENIZERS.get(where) or _TOKENIZERS.setdefault(where, WordTokenizer(where))
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            columns: list[list[int]] = [[], [], [], [], [], []]
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = (tokenizer.encode(text) if text else b"") + tail
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    size = min(capacity, n - start)
                    row = (k, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, seen[size])
                    seen[size] += 1
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            owner = pa.array(columns[0], pa.int64())
            names = ("start", "length", "ids_crc32", "doc_tokens", "local_rank")
            out = {"doc_id": batch.column("doc_id").take(owner)} | {c: pa.array(x, pa.int64()) for c, x in zip(names, columns[1:], strict=True)}
            yield pa.RecordBatch.from_pydict(out | {"task": pa.array([task] * len(owner), pa.int64())})

    return run


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in the order placed) and how many packs have each."""
    room: list[tuple[int, int, tuple[int, ...], int]] = []  # (-room, tie, pattern, packs)
    full: list[tuple[tuple[int, ...], int]] = []
    tie = 0

    def put(pattern: tuple[int, ...], packs: int, left: int) -> None:
        nonlocal tie
        if left:
            tie += 1
            heapq.heappush(room, (-left, tie, pattern, packs))
        else:
            full.append((pattern, packs))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n > 0:
            if room and -room[0][0] >= length:
                left, _, pattern, packs = heapq.heappop(room)
                take = min(n, packs)
                put((*pattern, length), take, -left - length)
                if packs > take:
                    put(pattern, packs - take, -left)
                n -= take
            else:
                # No pack has room: one is opened and is the shortest until it is full, then the next.
                each = capacity // length
                if n >= each:
                    put((length,) * each, n // each, capacity - each * length)
                if n % each:
                    put((length,) * (n % each), 1, capacity - (n % each) * length)
                n = 0
    return full + [(pattern, packs) for _, _, pattern, packs in sorted(room)]


def slots_of(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Slots sorted by (length, first rank): the first sequence of the slot's pattern and the slot's offset."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for pattern, packs in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], base, offset))
            used[length] += packs
            offset += length
        base += packs
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 44) | table[:, 1], "rank": table[:, 1], "base": table[:, 2], "offset": table[:, 3]}


def _place(slots: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(slots["key"], (batch.column("length").to_numpy() << 44) | rank, "right") - 1
            out = {c: batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            out["sequence_id"] = pa.array(slots["base"][at] + rank - slots["rank"][at])
            out["offset"] = pa.array(slots["offset"][at])
            yield pa.RecordBatch.from_pydict(out)

    return run


def pack(documents: DataFrame, capacity: int = 4096, end_id: int = 2, tokenizer_path: str | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer_path`` defaults to the public tokenizers' word-level vocabulary, as the executors find it.
    """
    bounded_batches(documents.sparkSession)
    id_type = documents.schema["doc_id"].dataType.simpleString()
    numbers = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    text = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    pieces = staged(text.mapInArrow(_pieces(tokenizer_path, end_id, capacity), f"doc_id {id_type}, {numbers}, local_rank bigint, task bigint"), "pieces")
    tallies = staged(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-tallies")
    histogram = {r["length"]: r["n"] for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = slots_of(pack_histogram(histogram, capacity))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = tallies.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    # The tallies grow with the number of tasks, so they are not to be broadcast.
    ranked = pieces.join(offsets.hint("merge"), ["task", "length"]).withColumn("rank", F.col("earlier") + F.col("local_rank"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(_place(slots), f"doc_id {id_type}, {numbers}, sequence_id bigint, offset bigint")
