"""Matroska columns: payloads stored as 8-bit PCM tracks, and a parser that turns files into packet tables.

``parse`` reads EBML elements with variable-length ids and sizes (unknown sizes of segments and clusters included), clusters, simple
blocks and block groups, all four lacings, and cues. A packet is a frame: track, timestamp in nanoseconds, byte offset
and size in the file, keyframe flag, lacing. Frames are byte ranges: media bytes are never copied into the table.

Defined cases: a null payload is an empty one; null media have no packets; media that end inside an element or break
the format give the packets before the fault and an ``error`` text; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches

# Element ids of the public EBML and Matroska specifications.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACINGS = ("none", "xiph", "fixed", "ebml")

UNIT = 192  # samples of the shortest frame, 24 ms
RATE = 8000
_FRAMES = ((1,) * 8, (1, 2, 3, 2), (1, 2, 3, 2))  # units of a block's frames, by the block's lacing
_LACING_OF = (2, 1, 3)
_BLOCKS = 16  # blocks of a cluster


def _size(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer of the least width; all ones is kept for the unknown size."""
    width = width or next(w for w in range(1, 9) if n < (1 << (7 * w)) - 1)
    return ((1 << (7 * width)) | n).to_bytes(width, "big")


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(ident: int, value: int) -> bytes:
    return _element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _lace(sizes: list[int], kind: int) -> bytes:
    """Frame count and sizes ahead of a laced block's frames."""
    head = bytes([len(sizes) - 1])
    if kind == 1:
        for n in sizes[:-1]:
            head += b"\xff" * (n // 255) + bytes([n % 255])
    elif kind == 3:
        head += _size(sizes[0])
        for last, n in zip(sizes, sizes[1:-1], strict=False):
            d = n - last
            width = next(w for w in range(1, 9) if abs(d) < (1 << (7 * w - 1)) - 1)
            head += _size(d + (1 << (7 * width - 1)) - 1, width)
    return head


_HEADER = _element(
    EBML,
    _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2),
)
_TRACKS = _element(
    TRACKS,
    _element(
        TRACK_ENTRY,
        _uint(TRACK_NUMBER, 1)
        + _uint(TRACK_UID, 1)
        + _uint(TRACK_TYPE, 2)
        + _element(CODEC_ID, b"A_PCM/INT/LIT")
        + _uint(DEFAULT_DURATION, UNIT * 1_000_000_000 // RATE)
        + _element(AUDIO, _element(SAMPLING_FREQUENCY, np.array([RATE], ">f8").tobytes()) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)),
    ),
)


def mux(payload: bytes) -> bytes:
    """A Matroska file with ``payload`` (a multiple of 192 bytes) as 8-bit samples of one track."""
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, np.array([len(payload) * 1000 / RATE], ">f8").tobytes()) + _element(MUXING_APP, b"meristem") + _element(WRITING_APP, b"meristem"))
    parts, at, position, block, cues = [info, _TRACKS], 0, len(info) + len(_TRACKS), 0, []
    while at < len(payload):
        start = at * 1000 // RATE
        body = [_uint(TIMESTAMP, start)]
        for _ in range(_BLOCKS):
            if at >= len(payload):
                break
            kind = block % 3
            sizes, end = [], at
            for units in _FRAMES[kind]:
                n = min(units * UNIT, len(payload) - end)
                if n:
                    sizes.append(n)
                    end += n
            lacing = _LACING_OF[kind]
            if len(sizes) == 1 or (lacing == 2 and len(set(sizes)) > 1):
                lacing = 0 if len(sizes) == 1 else 1
            grouped = block % 4 == 3
            head = b"\x81" + (at * 1000 // RATE - start).to_bytes(2, "big", signed=True) + bytes([(0 if grouped else 0x80) | lacing << 1])
            data = head + (_lace(sizes, lacing) if lacing else b"") + payload[at:end]
            body.append(_element(BLOCK_GROUP, _element(BLOCK, data) + _uint(BLOCK_DURATION, (end - at) * 1000 // RATE)) if grouped else _element(SIMPLE_BLOCK, data))
            at, block = end, block + 1
        cluster = _element(CLUSTER, b"".join(body))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, start) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, position))))
        parts.append(cluster)
        position += len(cluster)
    parts.append(_element(CUES, b"".join(cues)))
    return _HEADER + _element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)  # track, ns, offset, size, keyframe, lacing
    clusters: list[int] = field(default_factory=list)  # offsets relative to the segment's body
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # ns, track, cluster position
    blocks: int = 0
    scale: int = 1_000_000
    error: str | None = None


_MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
_TOP = {INFO, TRACKS, CLUSTER, CUES}  # elements that end a cluster of unknown size


def _vint(data: bytes, at: int, keep: bool) -> tuple[int, int, bool]:
    """(value, next offset, whether all value bits are ones)."""
    if at >= len(data):
        raise ValueError(f"file ends at {at}")
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"bad variable-length integer at {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    bits = raw & ((1 << 7 * width) - 1)
    return (raw if keep else bits), at + width, bits == (1 << 7 * width) - 1


def _frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block whose body, after its flags, is ``data[at:end]``."""
    if not lacing:
        return [(at, end - at)]
    if at >= end:
        raise ValueError(f"laced block without a frame count at {at}")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                b, at = data[at], at + 1
                size += b
                if b < 255:
                    break
            sizes.append(size)
    elif lacing == 3 and n > 1:
        size, at, _ = _vint(data, at, False)
        sizes.append(size)
        for _ in range(n - 2):
            before = at
            delta, at, _ = _vint(data, at, False)
            size += delta - (1 << (7 * (at - before) - 1)) + 1
            sizes.append(size)
    elif lacing == 2:
        if (end - at) % n:
            raise ValueError(f"fixed lacing of {end - at} bytes into {n} at {at}")
        sizes = [(end - at) // n] * (n - 1)
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    if at > end or any(s < 0 for s in sizes):
        raise ValueError(f"lacing beyond its block at {at}")
    return [*out, (at, end - at)]


#: Masters within masters, as far as a walk follows them; the format needs about seven.
DEEPEST = 64


def parse(data: bytes) -> Media:
    """Packet table, tracks, clusters and cues of a file; a fault ends the walk and is named in ``error``."""
    media = Media()
    state = {"segment": 0, "cluster": 0, "group": None, "track": {}, "cue": {}}
    try:
        ident, at, _ = _vint(data, 0, True)
        if ident != EBML:
            raise ValueError("no EBML header")
        size, at, _ = _vint(data, at, False)
        _walk(data, at + size, len(data), media, state, 0)
    except (ValueError, IndexError, OverflowError) as e:
        media.error = str(e) or type(e).__name__
    return media


def _walk(data: bytes, at: int, end: int, media: Media, state: dict, parent: int, depth: int = 0) -> int:
    if depth > DEEPEST:
        raise ValueError(f"elements at {at} are nested too deeply")
    while at < end:
        begin = at
        ident, at, _ = _vint(data, at, True)
        if parent == CLUSTER and ident in _TOP and state["open"]:
            return begin
        size, at, unknown = _vint(data, at, False)
        stop = end if unknown else at + size
        if stop > end:
            raise ValueError(f"element {ident:x} at {begin} ends beyond its parent")
        if ident in _MASTERS:
            if ident == SEGMENT:
                state["segment"] = at
            elif ident == CLUSTER:
                media.clusters.append(begin - state["segment"])
                state["cluster"], state["open"] = 0, unknown
            elif ident == BLOCK_GROUP:
                state["group"] = {"key": True}
            elif ident == TRACK_ENTRY:
                state["track"] = {}
            elif ident in (CUE_POINT, CUE_TRACK_POSITIONS):
                state["cue"] = {"time": state["cue"].get("time", 0)} if ident == CUE_TRACK_POSITIONS else {}
            at = _walk(data, at, stop, media, state, ident, depth + 1)
            if ident == BLOCK_GROUP:
                if "block" in state["group"]:
                    _block(data, *state["group"]["block"], media, state, state["group"]["key"])
                state["group"] = None
            elif ident == TRACK_ENTRY:
                media.tracks[state["track"].get("number", 0)] = state["track"]
            elif ident == CUE_TRACK_POSITIONS:
                media.cues.append((state["cue"].get("time", 0) * media.scale, state["cue"].get("track", 0), state["cue"].get("position", 0)))
            continue
        if ident == SIMPLE_BLOCK:
            _block(data, at, stop, media, state, None)
        elif ident == BLOCK and state["group"] is not None:
            state["group"]["block"] = (at, stop)
        elif ident == REFERENCE_BLOCK and state["group"] is not None:
            state["group"]["key"] = False
        elif ident == CODEC_ID:
            state["track"]["codec"] = data[at:stop].decode("ascii", "replace")
        elif ident == SAMPLING_FREQUENCY and stop - at in (4, 8):
            state["track"]["rate"] = float(np.frombuffer(data[at:stop], f">f{stop - at}")[0])
        elif ident in (TIMESTAMP_SCALE, TIMESTAMP, TRACK_NUMBER, TRACK_TYPE, CHANNELS, BIT_DEPTH, DEFAULT_DURATION, CUE_TIME, CUE_TRACK, CUE_CLUSTER_POSITION):
            value = int.from_bytes(data[at:stop], "big")
            if ident == TIMESTAMP_SCALE:
                media.scale = value
            elif ident == TIMESTAMP:
                state["cluster"] = value
            elif ident in (CUE_TIME, CUE_TRACK, CUE_CLUSTER_POSITION):
                state["cue"][{CUE_TIME: "time", CUE_TRACK: "track", CUE_CLUSTER_POSITION: "position"}[ident]] = value
            else:
                state["track"][{TRACK_NUMBER: "number", TRACK_TYPE: "type", CHANNELS: "channels", BIT_DEPTH: "bits", DEFAULT_DURATION: "duration"}[ident]] = value
        at = stop
    return at


def _block(data: bytes, at: int, end: int, media: Media, state: dict, key: bool | None) -> None:
    track, at, _ = _vint(data, at, False)
    if at + 3 > end:
        raise ValueError(f"block at {at} is too short")
    relative = int.from_bytes(data[at : at + 2], "big", signed=True)
    flags = data[at + 2]
    lacing = flags >> 1 & 3
    stamp = (state["cluster"] + relative) * media.scale
    about = media.tracks.get(track, {})
    # Nanoseconds of a second's bytes of PCM; a rate that isn't a positive number counts as the format's default.
    rate = about.get("rate", RATE)
    rate = rate if 0 < rate < 1 << 31 else RATE
    second = rate * max(1, about.get("channels", 1)) * max(1, about.get("bits", 8)) / 8
    key = bool(flags & 0x80) if key is None else key
    media.blocks += 1
    for offset, size in _frames(data, at + 3, end, lacing):
        if not -(1 << 63) <= stamp < 1 << 63:
            raise ValueError(f"timestamp of the block at {at} is beyond 64 bits")
        media.packets.append((track, stamp, offset, size, key, lacing))
        # Frames of a lace follow each other; their own length is known for PCM tracks.
        stamp += int(size * 1_000_000_000 / second) if about.get("codec") == "A_PCM/INT/LIT" else about.get("duration", 0)


def payload_of(text: bytes) -> bytes:
    """Bytes 32 up to a positive multiple of 192."""
    return text + b" " * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def _store(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("__payload").to_pylist()
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                media = [mux(payload_of(x or b"")) for x in raw[i : i + 256]]
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in columns} | {"__n_bytes": pa.array([len(x or b"") for x in raw[i : i + 256]], pa.int64()), "__media": pa.array(media, pa.binary())})

    return run


def store(rows: DataFrame, payload: str) -> DataFrame:
    """``rows`` with ``__n_bytes`` and ``__media``, a Matroska file that holds the string or binary column ``payload``."""
    bounded_batches(rows.sparkSession)
    schema = rows.withColumns({"__n_bytes": F.lit(0).cast("long"), "__media": F.lit(None).cast("binary")}).schema
    return rows.withColumn("__payload", F.col(payload).cast("binary")).mapInArrow(_store(rows.columns), schema)


def _packets(column: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows, errors = [], [], []
            for k, data in enumerate(batch.column(column).to_pylist()):
                media = parse(data) if data is not None else Media()
                found = [(*p[:5], LACINGS[p[5]]) for p in media.packets]
                if media.error:
                    found.append((None,) * 6)
                rows += found
                owner += [k] * len(found)
                errors += [None] * len(media.packets) + ([media.error] if media.error else [])
            take = pa.array(owner, pa.int64())
            names = (("track", pa.int64()), ("timestamp_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.string()))
            out = {c: batch.column(c).take(take) for c in columns}
            out |= {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(names)}
            yield pa.RecordBatch.from_pydict(out | {"error": pa.array(errors, pa.string())})

    return run


def packet_table(media: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """A row per packet of the files in binary ``column``, with ``keys``: track, timestamp_ns, offset, size, keyframe, lacing;
    a row with ``error`` alone after the packets of a faulty file."""
    schema = media.select(*keys).withColumns({n: F.lit(None).cast(t) for n, t in (("track", "long"), ("timestamp_ns", "long"), ("offset", "long"), ("size", "long"), ("keyframe", "boolean"), ("lacing", "string"), ("error", "string"))}).schema
    return media.select(*keys, column).mapInArrow(_packets(column, keys), schema)


def describe(data: bytes, n_bytes: int) -> tuple[int, str, int, int, int, str, str]:
    """Payload size and hash as read back, CRCs of its last 16 unpadded bytes and of its last 16, media size and hash, features."""
    media = parse(data)
    if media.error:
        raise ValueError(media.error)
    payload = b"".join([data[o : o + s] for _, _, o, s, _, _ in media.packets])
    samples = np.frombuffer(payload, np.uint8)
    kinds = np.bincount([p[5] for p in media.packets], minlength=4)
    sought = sum(p in media.clusters for _, _, p in media.cues)
    high = int((samples >= 128).sum())
    turns = int(((samples[1:] >= 97) != (samples[:-1] >= 97)).sum())
    feature = (
        f"tracks={len(media.tracks)};clusters={len(media.clusters)};blocks={media.blocks};packets={len(media.packets)};"
        f"lacing={'/'.join(map(str, kinds.tolist()))};cues={sought};last_ms={media.packets[-1][1] // 1_000_000};"
        f"sum={int(samples.sum(dtype=np.int64))};high={high};turns={turns}"
    )
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[:n_bytes][-16:]), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature


def _describe(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [describe(data, n) for data, n in zip(batch.column("__media").to_pylist(), batch.column("__n_bytes").to_pylist(), strict=True)]
            names = (("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("payload_tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()))
            out = {c: batch.column(c) for c in columns} | {"n_bytes": batch.column("__n_bytes")}
            yield pa.RecordBatch.from_pydict(out | {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(names)})

    return run


def features(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Digests and features of files made by ``store``, computed from the packets read back."""
    schema = stored.select(*keys).withColumns({n: F.lit(None).cast(t) for n, t in (("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("payload_tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"))}).schema
    return stored.select(*keys, "__n_bytes", "__media").mapInArrow(_describe(keys), schema)
