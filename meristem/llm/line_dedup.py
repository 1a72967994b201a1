"""Line deduplication over levelled sorted runs of line hashes.

``LineStore`` keeps 128-bit hashes of line keys, each with the document that owns it, in runs: tables in the shared folder
that are bucketed and sorted by hash. A batch is pre-aggregated to one row per key, merge-anti-joined with every
run (a run is read in place, without a shuffle of its own), and what is new becomes a run of level 0. When a level holds
``fanout`` runs they are compacted into one run of the next level. Runs are disjoint.

A line's key is the line without the characters 20 and 09-0D at both ends, A-Z lower-cased. ``dedup_lines`` feeds the store
with ``batches`` ranges of ascending doc_id, so a key's owner is the smallest doc_id that holds it; then every document
keeps the keys that it owns. A common key is one row after pre-aggregation, and no step gathers a key's documents.

Defined cases: a null or empty text is one empty line (null stays null); documents with a null doc_id own nothing
and lose nothing; rows that share a doc_id are one document for ownership and each keep their lines; an empty table
gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import bounded_batches, drop_path, scratch_path, staged, utf8_views

_STRIP = b" \t\n\x0b\x0c\r"


def line_key(lowered: bytes, least: int) -> bytes | None:
    """The key of a line whose A-Z are lower-cased, or None if it has under ``least`` code points."""
    key = lowered.strip(_STRIP)
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return key


def key_digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class LineStore:
    """Levelled runs of (h1, h2, doc_id), one row per key."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        drop_path(self.spark, self.paths.pop(run))

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"meristem_lines_{uuid.uuid4().hex}"
        self.paths[name] = scratch_path(self.spark, name)
        rows.write.format("parquet").option("path", self.paths[name]).bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def add(self, keys: DataFrame) -> None:
        """Add a batch of (h1, h2, doc_id): keys that no run has, with their smallest doc_id, become a new run."""
        new = keys.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
        for run in (x for level in self.levels for x in level):
            new = new.join(self.spark.table(run), ["h1", "h2"], "left_anti")
        self._write(new, 0)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            runs = self.levels[level]
            if len(runs) >= self.fanout:
                merged = self.spark.table(runs[0])
                for run in runs[1:]:
                    merged = merged.unionAll(self.spark.table(run))
                self._write(merged.repartition(self.buckets, "h1", "h2"), level + 1)
                for run in runs:
                    self._drop(run)
                self.levels[level] = []
            level += 1

    def owners(self) -> DataFrame:
        """All keys with their owners."""
        out = None
        for run in (x for level in self.levels for x in level):
            rows = self.spark.table(run).select("h1", "h2", "doc_id")
            out = rows if out is None else out.unionAll(rows)
        assert out is not None
        return out

    def drop(self) -> None:
        for run in (x for level in self.levels for x in level):
            self._drop(run)
        self.levels = []


def _keys_of(least: int, bounds: list[int], id_index: pa.DataType):
    """mapInArrow: a row (batch, h1, h2, doc_id) for each distinct key of a document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_views(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            digests: list[bytes] = []
            counts = np.zeros(batch.num_rows, np.int64)
            for k in range(batch.num_rows):
                found = {line_key(x, least) for x in data[offsets[k] : offsets[k + 1]].tobytes().lower().split(b"\n")}
                found.discard(None)
                digests.extend(map(key_digest, found))
                counts[k] = len(found)
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            owner = np.repeat(ids, counts).astype(np.int64)
            yield pa.RecordBatch.from_pydict(
                {"batch": pa.array(np.searchsorted(bounds, owner, "left"), pa.int32()), "h1": pa.array(h[:, 0]), "h2": pa.array(h[:, 1]), "doc_id": pa.array(owner)}
            )

    return run


def _apply(least: int, columns: list[str]):
    """mapInArrow: drop a document's lines whose keys others own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            data, offsets = utf8_views(text)
            null_text, null_id = text.is_null().to_numpy(False), batch.column("doc_id").is_null().to_numpy(False)
            owned = batch.column("__owned")
            own_at = owned.offsets.to_numpy()
            values = owned.flatten() if owned.offset == 0 and not owned.null_count else None
            if values is None:
                lists = owned.to_pylist()
                flat = [x for own in lists for x in own or ()]
                own_at = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
                pairs = np.array([(x["h1"], x["h2"]) for x in flat], np.int64).reshape(-1, 2)
            else:
                pairs = np.stack([values.field("h1").to_numpy(False), values.field("h2").to_numpy(False)], axis=1) if len(values) else np.zeros((0, 2), np.int64)
                own_at = own_at - own_at[0]
            raw = np.ascontiguousarray(pairs).tobytes()
            kept_texts: list[bytes | None] = []
            n_lines, n_dropped = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for k in range(batch.num_rows):
                body = data[offsets[k] : offsets[k + 1]].tobytes()
                lines = body.split(b"\n")
                n_lines[k] = len(lines)
                if not null_id[k]:
                    own = {raw[16 * j : 16 * j + 16] for j in range(own_at[k], own_at[k + 1])}
                    kept = [x for x in lines if (key := line_key(x.lower(), least)) is None or key_digest(key) in own]
                    n_dropped[k] = len(lines) - len(kept)
                    if n_dropped[k]:
                        body = b"\n".join(kept)
                kept_texts.append(None if null_text[k] else body)
            out = {c: batch.column(c) for c in columns if c != "text"}
            out |= {"text": pa.array(kept_texts, pa.binary()).cast(pa.string()), "__n_lines": pa.array(n_lines), "__n_dropped": pa.array(n_dropped)}
            yield pa.RecordBatch.from_pydict({c: out[c] for c in [*columns, "__n_lines", "__n_dropped"]})

    return run


def dedup_lines(documents: DataFrame, least: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``documents`` (doc_id, text and any other columns) with duplicated lines removed from ``text``, and the columns
    ``__n_lines`` (before) and ``__n_dropped``."""
    spark = documents.sparkSession
    bounded_batches(spark)
    known = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shares = [k / batches for k in range(1, batches)]
    bounds = known.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] if shares else []
    bounds = [int(x) for x in bounds or []]
    keys = staged(known.mapInArrow(_keys_of(least, bounds, pa.int64()), "batch int, h1 bigint, h2 bigint, doc_id bigint"), "line-keys")
    store = LineStore(spark, fanout)
    try:
        for b in range(batches):
            store.add(keys.where(F.col("batch") == b))
        owned = store.owners().groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("__owned"))
        owned = staged(owned.withColumnRenamed("doc_id", "__owner"), "line-owners")
    finally:
        store.drop()
    joined = documents.join(owned.hint("merge"), F.col("doc_id").cast("long") == F.col("__owner"), "left").drop("__owner")
    columns = documents.columns
    schema = documents.withColumns({"text": F.col("text").cast("string"), "__n_lines": F.lit(0).cast("long"), "__n_dropped": F.lit(0).cast("long")}).schema
    return joined.mapInArrow(_apply(least, columns), schema)
