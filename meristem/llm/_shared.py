"""Helpers shared by the training-data operators: shared scratch folder, Arrow text access, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step works on; bounds a Python worker's memory.
CHUNK_BYTES = 1 << 17


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows in this session: whole texts and sets pass through workers, whose memory a batch
    must not fill."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Unset, a local session (tests) gets a temporary one; a cluster, whose
    executors can't see such a folder, is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="meristem-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """Hadoop's file system of a path, so that any shared store works, and the path."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends at the latest."""
    path = f"{shared_folder(spark)}/meristem/{name}-{uuid.uuid4().hex}"
    system, found = _hadoop(spark, path)
    system.deleteOnExit(found)
    return path


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder."""
    system, found = _hadoop(spark, path)
    system.delete(found, True)


def release(*frames: DataFrame | None) -> None:
    """Remove the folders of staged frames that nothing reads any more."""
    for df in frames:
        if df is not None:
            for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
                if "/meristem/" in folder:
                    drop_path(df.sparkSession, folder)


def utf8_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and int64 offsets (n+1). Null rows have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return raw[lo:hi], offsets - lo


def row_blocks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each (one row at least)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, for positions 0 .. n-1."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            out[1:] = np.uint64(base)
            np.multiply.accumulate(out, out=out)
            _POWERS[k] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (in a new array)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def byte_class(pattern: str) -> np.ndarray:
    """Which bytes belong to words: ``alnum`` is digits, a-z and every byte of a non-ASCII code point
    (bytes after lower-casing); ``nonspace`` is everything but space and 09-0D."""
    c = np.zeros(256, bool)
    if pattern == "alnum":
        c[48:58] = c[97:123] = c[128:] = True
    elif pattern == "nonspace":
        c[:] = True
        c[9:14] = False
        c[32] = False
    else:
        raise ValueError(pattern)
    return c


def hashed_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of A-Z-lower-cased texts: 64-bit hashes, start and end bytes, and word offsets by row (n+1).

    Words never cross a row. Everything is one vectorised pass: a word's hash is the sum of byte values times
    powers of an odd base, moved back to the word's own start by the inverse power, then mixed.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    word = is_word[low]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    before[firsts] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[firsts[1:] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    rows = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, rows
    up, down = _powers(n)
    value = _BYTE[low]
    value *= up
    value[~word] = 0
    h = np.add.reduceat(value, starts) * down[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * _ODD), starts, ends, rows
