"""Media columns: Matroska files in binary columns.

``mux`` writes payloads as Matroska files (one PCM track, 8-bit mono at 8 kHz, laced SimpleBlocks, cues);
``parse`` reads any Matroska file: variable-length EBML elements, known and unknown sizes, SimpleBlocks and BlockGroups,
all four lacings, cues. The packet table has one row per frame with track, timestamp and byte range.

Defined results: a null text is the empty text; a null, foreign or truncated file gives the packets before the damage
and a status that says so; equal texts give equal files; repeated rows are independent; only the named columns are read,
so others may have any name. Everything is local to a row: no shuffle, and Python holds one bounded Arrow batch.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, session, text_or_empty

UNIT = 64
RATE_PER_MS = 8  # samples of one byte
FRAME = 512  # bytes, 64 ms
LACED = 8  # frames a block at most
BLOCKS = 24  # blocks a cluster at most: 12.3 s, within the 16-bit block time
OUT_BYTES = 8 * 1024 * 1024

# Element IDs of the Matroska and EBML specifications (RFC 8794, RFC 9559).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x4286, 0x42F7, 0x42F2, 0x42F3
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
DEFAULT_DURATION, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
CONTAINERS = {SEGMENT, TRACK_ENTRY, AUDIO, TRACKS, INFO, CUES, CUE_POINT, CUE_POSITIONS}
TOP_LEVEL = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1941A469, 0x1043A770}
LACINGS = ("none", "xiph", "fixed", "ebml")


# ---- writing


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def _vint(n: int) -> bytes:
    width = next(w for w in range(1, 9) if n < (1 << (7 * w)) - 1)
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def _element(n: int, body: bytes) -> bytes:
    return _id(n) + _vint(len(body)) + body


def _uint(n: int, value: int) -> bytes:
    return _element(n, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _float(n: int, value: float) -> bytes:
    return _element(n, np.array(value, ">f8").tobytes())


def _laced(frames: list[bytes], kind: int) -> bytes:
    """Frame count and sizes as the lacing stores them, then the frames."""
    if kind == 0:
        return frames[0]
    head = bytearray([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == 1:
        for n in sizes[:-1]:
            head += b"\xff" * (n // 255) + bytes([n % 255])
    elif kind == 3:
        head += _vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            head += _signed(b - a)
    return bytes(head) + b"".join(frames)


def _signed(n: int) -> bytes:
    width = next(w for w in range(1, 9) if abs(n) < (1 << (7 * w - 1)) - 1)
    return (n + (1 << (7 * width - 1)) - 1 | 1 << (7 * width)).to_bytes(width, "big")


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """Bytes 0 up to a positive multiple of the unit."""
    return data + b"\0" * (max(unit, -(-len(data) // unit) * unit) - len(data))


def mux(payload: bytes) -> bytes:
    """A Matroska file that holds the payload as 8-bit PCM samples; frames of 512 bytes, the last may be shorter."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    header = _element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ_VERSION, 2))
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _float(DURATION, len(payload) / RATE_PER_MS) + _element(MUXING_APP, b"citemill") + _element(WRITING_APP, b"citemill"))
    audio = _element(AUDIO, _float(SAMPLING, 1000.0 * RATE_PER_MS) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    track = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _uint(DEFAULT_DURATION, FRAME // RATE_PER_MS * 1_000_000) + _element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    head = info + _element(TRACKS, _element(TRACK_ENTRY, track))
    body, cues, block = [head], [], 0
    at, step = len(head), FRAME // RATE_PER_MS
    for c in range(0, len(frames), LACED * BLOCKS):
        parts = [_uint(TIMESTAMP, c * step)]
        for b in range(c, min(c + LACED * BLOCKS, len(frames)), LACED):
            group = frames[b : b + LACED]
            even = len(group[-1]) == len(group[0])
            kind = 0 if len(group) == 1 else (1, 2 if even else 1, 3)[block % 3]
            block += 1
            parts.append(_element(SIMPLE_BLOCK, _vint(1) + ((b - c) * step).to_bytes(2, "big") + bytes([0x80 | kind << 1]) + _laced(group, kind)))
        cluster = _element(CLUSTER, b"".join(parts))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, c * step) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(_element(CUES, b"".join(cues)))
    return header + _element(SEGMENT, b"".join(body))


# ---- reading


class Damaged(ValueError):
    pass


@dataclass
class Parsed:
    status: str = "ok"
    scale: int = 1_000_000
    tracks: list[dict] = field(default_factory=list)
    #: track, timestamp_ns, duration_ns (-1: not known), offset, size, keyframe, lacing, cluster, block, frame
    packets: list[tuple] = field(default_factory=list)
    #: time_ns, track, byte offset of the cluster in the file
    cues: list[tuple] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    blocks: int = 0


def _read_id(data: bytes, at: int) -> tuple[int, int]:
    if at >= len(data) or not data[at] or at + (width := 9 - data[at].bit_length()) > len(data) or width > 4:
        raise Damaged(f"no element at {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def _read_vint(data: bytes, at: int, end: int | None = None) -> tuple[int | None, int, int]:
    """Value (None: all bits set, that is unknown), what follows it, width."""
    if at >= (len(data) if end is None else end) or not data[at] or at + (width := 9 - data[at].bit_length()) > len(data):
        raise Damaged(f"no variable-length integer at {at}")
    value = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return None if value == (1 << 7 * width) - 1 else value, at + width, width


def _elements(data: bytes, at: int, end: int, stop: set[int] = frozenset()) -> Iterator[tuple[int, int, int, bool]]:
    """(id, start of the body, its end, whole). An unknown size lasts to the parent's end or the next element of stop."""
    while at < end:
        n, body = _read_id(data, at)
        if n in stop:
            return
        length, body, _ = _read_vint(data, body)
        last = end if length is None else body + length
        yield n, body, min(last, end), length is not None and last <= end
        at = _unknown_end(data, n, body, end) if length is None else last


def _unknown_end(data: bytes, n: int, at: int, end: int) -> int:
    stop = {SEGMENT, EBML} if n == SEGMENT else TOP_LEVEL
    while at < end:
        inner, body = _read_id(data, at)
        if inner in stop:
            return at
        length, body, _ = _read_vint(data, body)
        at = end if length is None else body + length
    return end


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def parse(data: bytes | None) -> Parsed:
    out = Parsed()
    if not data:
        out.status = "empty"
        return out
    try:
        kinds = []
        for n, a, b, whole in _elements(data, 0, len(data)):
            kinds.append(n)
            if n == SEGMENT:
                _segment(data, a, b if whole else len(data), out)
            if not whole and n != SEGMENT:
                raise Damaged("cut short")
            if n == SEGMENT and not whole and out.status == "ok" and _declared(data, a) is not None:
                raise Damaged("cut short")
        if EBML not in kinds[:1] or SEGMENT not in kinds:
            out.status = "not matroska"
    except Damaged as e:
        out.status = f"damaged: {e}"
    return out


def _declared(data: bytes, body: int) -> int | None:
    """The size that stands right before a body, None where unknown; widths are found by their marker bit."""
    for width in range(1, 9):
        if body >= width and data[body - width].bit_length() == 9 - width:
            return _read_vint(data, body - width)[0]
    return None


def _segment(data: bytes, start: int, end: int, out: Parsed) -> None:
    raw_cues = []
    for n, a, b, whole in _elements(data, start, end):
        if n == INFO:
            for m, c, d, _ in _elements(data, a, b):
                if m == TIMESTAMP_SCALE:
                    out.scale = _number(data, c, d)
        elif n == TRACKS:
            out.tracks += [_track(data, c, d) for m, c, d, _ in _elements(data, a, b) if m == TRACK_ENTRY]
        elif n == CLUSTER:
            _cluster(data, a, b, out)
        elif n == CUES:
            for m, c, d, _ in _elements(data, a, b):
                if m == CUE_POINT:
                    raw_cues.append(_cue(data, c, d))
        if not whole and n != CLUSTER:
            raise Damaged("cut short")
        if n == CLUSTER and not whole and b == end and _declared(data, a) is not None:
            raise Damaged("cut short")
    out.cues += [(t * out.scale, track, start + pos) for t, track, pos in raw_cues]


def _track(data: bytes, a: int, b: int) -> dict:
    names = {TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_duration", CHANNELS: "channels", BIT_DEPTH: "bit_depth"}
    out = {"number": 0, "type": 0, "codec": "", "default_duration": 0}
    for n, c, d, _ in _elements(data, a, b):
        if n == AUDIO:
            for m, e, f, _ in _elements(data, c, d):
                if m in names:
                    out[names[m]] = _number(data, e, f)
                elif m == SAMPLING:
                    out["sampling"] = float(np.frombuffer(data[e:f], f">f{f - e}")[0]) if f - e in (4, 8) else 0.0
        elif n in names:
            out[names[n]] = _number(data, c, d)
        elif n == CODEC_ID:
            out["codec"] = data[c:d].decode("ascii", "replace")
    return out


def _cue(data: bytes, a: int, b: int) -> tuple[int, int, int]:
    time = track = pos = 0
    for n, c, d, _ in _elements(data, a, b):
        if n == CUE_TIME:
            time = _number(data, c, d)
        elif n == CUE_POSITIONS:
            for m, e, f, _ in _elements(data, c, d):
                track, pos = (_number(data, e, f) if m == CUE_TRACK else track), (_number(data, e, f) if m == CUE_CLUSTER else pos)
    return time, track, pos


def _cluster(data: bytes, a: int, b: int, out: Parsed) -> None:
    time, number = 0, len(out.clusters)
    out.clusters.append(a)
    for n, c, d, whole in _elements(data, a, b, stop=TOP_LEVEL):
        if n == TIMESTAMP:
            time = _number(data, c, d)
        elif n == SIMPLE_BLOCK:
            _block(data, c, d, time, number, bool(_flags(data, c, d) & 0x80), None, out)
        elif n == BLOCK_GROUP:
            inner = {m: (e, f) for m, e, f, _ in _elements(data, c, d)}
            if BLOCK in inner:
                lasts = _number(data, *inner[BLOCK_DURATION]) if BLOCK_DURATION in inner else None
                _block(data, *inner[BLOCK], time, number, REFERENCE not in inner, lasts, out)
        if not whole:
            raise Damaged("cut short")


def _flags(data: bytes, a: int, b: int) -> int:
    _, at, _ = _read_vint(data, a, b)
    return data[at + 2] if at + 2 < b else 0


def _block(data: bytes, a: int, b: int, time: int, cluster: int, key: bool, lasts: int | None, out: Parsed) -> None:
    track, at, _ = _read_vint(data, a, b)
    if at + 3 > b:
        raise Damaged(f"short block at {a}")
    start = (time + int.from_bytes(data[at : at + 2], "big", signed=True)) * out.scale
    kind, at = data[at + 2] >> 1 & 3, at + 3
    sizes = _sizes(data, at, b, kind)
    at = b - sum(sizes)
    each = next((t["default_duration"] for t in out.tracks if t["number"] == track), 0)
    if lasts is not None:
        each = lasts * out.scale // len(sizes)
    for i, n in enumerate(sizes):
        out.packets.append((track, start + i * each, each or -1, at, n, key, LACINGS[kind], cluster, out.blocks, i))
        at += n
    out.blocks += 1


def _sizes(data: bytes, at: int, end: int, kind: int) -> list[int]:
    if kind == 0:
        return [end - at]
    if at >= end:
        raise Damaged(f"no lacing at {at}")
    count, at, sizes = data[at] + 1, at + 1, []
    if kind == 2:
        if (end - at) % count:
            raise Damaged(f"uneven fixed lacing at {at}")
        return [(end - at) // count] * count
    for i in range(count - 1):
        if kind == 1:
            n = 0
            while at < end and data[at] == 255:
                n, at = n + 255, at + 1
            if at >= end:
                raise Damaged(f"short lacing at {at}")
            n, at = n + data[at], at + 1
        else:
            value, at, width = _read_vint(data, at, end)
            value = (1 << 7 * width) - 1 if value is None else value
            n = value if i == 0 else sizes[-1] + value - ((1 << 7 * width - 1) - 1)
        sizes.append(n)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Damaged(f"lacing beyond its block at {at}")
    return sizes


def payload_of(data: bytes, parsed: Parsed, track: int = 1) -> bytes:
    """The track's frames, joined in time order."""
    own = sorted((p for p in parsed.packets if p[0] == track), key=lambda p: p[1])
    return b"".join(data[p[3] : p[3] + p[4]] for p in own)


def features(payload: bytes, parsed: Parsed) -> str:
    """Canonical JSON: structure of the file, and level, spread and zero crossings of the samples read back."""
    x = np.frombuffer(payload, np.uint8)
    levels, low = np.bincount(x, minlength=256), x < 128
    value = np.arange(256)
    kinds = Counter(p[6] for p in parsed.packets)
    starts = {a - w for a in parsed.clusters for w in range(5, 13)}
    return json.dumps({
        "status": parsed.status, "codec": parsed.tracks[0]["codec"] if parsed.tracks else "", "clusters": len(parsed.clusters), "blocks": parsed.blocks, "packets": len(parsed.packets), "cues": len(parsed.cues),
        "cues_hit": sum(c[2] in starts for c in parsed.cues), "lacing": {k: kinds[k] for k in LACINGS if k in kinds}, "duration_ms": len(x) // RATE_PER_MS,
        "sum": int((levels * value).sum()), "energy": int((levels * (value - 128) ** 2).sum()), "crossings": int(np.count_nonzero(low[1:] != low[:-1])), "peak": int(levels.nonzero()[0].max(initial=0)),
    }, sort_keys=True, separators=(",", ":"))


# ---- DataFrame operators

PACKET = "struct<track:long,timestamp_ns:long,duration_ns:long,offset:long,size:long,keyframe:boolean,lacing:string,cluster:int,block:int,frame:int>"
_PACKET_ARROW = pa.struct([("track", pa.int64()), ("timestamp_ns", pa.int64()), ("duration_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.string()), ("cluster", pa.int32()), ("block", pa.int32()), ("frame", pa.int32())])
_NAMES = [f.name for f in _PACKET_ARROW]


_CUE_ARROW = pa.struct([("time_ns", pa.int64()), ("track", pa.int64()), ("offset", pa.int64())])
#: What can be asked of a stored file, with its types in SQL and Arrow; file, its packets, and the track's payload are given.
FIELDS: dict[str, tuple[str, pa.DataType, Callable[[bytes, Parsed, bytes], object]]] = {
    "media": ("binary", pa.binary(), lambda data, got, payload: data),
    "status": ("string", pa.string(), lambda data, got, payload: got.status),
    "payload": ("binary", pa.binary(), lambda data, got, payload: payload),
    "feature": ("string", pa.string(), lambda data, got, payload: features(payload, got)),
    "packets": (f"array<{PACKET}>", pa.list_(_PACKET_ARROW), lambda data, got, payload: [dict(zip(_NAMES, p, strict=True)) for p in got.packets]),
    "cues": ("array<struct<time_ns:long,track:long,offset:long>>", pa.list_(_CUE_ARROW), lambda data, got, payload: [dict(zip(("time_ns", "track", "offset"), c, strict=True)) for c in got.cues]),
    "n_packets": ("long", pa.int64(), lambda data, got, payload: len(got.packets)),
    "payload_bytes": ("long", pa.int64(), lambda data, got, payload: len(payload)),
    "payload_sha256": ("string", pa.string(), lambda data, got, payload: hashlib.sha256(payload).hexdigest()),
    "tail_crc32": ("long", pa.int64(), lambda data, got, payload: zlib.crc32(payload[-UNIT:])),
    "media_bytes": ("long", pa.int64(), lambda data, got, payload: len(data or b"")),
    "media_sha256": ("string", pa.string(), lambda data, got, payload: hashlib.sha256(data or b"").hexdigest()),
}
OUTPUTS = ("media", "status", "payload", "feature", "packets", "cues")
_LARGE = {"media": 1, "payload": 1, "packets": 2}  # bytes that a field takes for each byte of the file, about


def _read(df: DataFrame, key: str, source: Column, track: int, fields: tuple[str, ...], stored: Callable[[bytes], bytes] | None) -> DataFrame:
    """key, n_bytes (of the source) and the fields; stored makes the file of the source where that is not the file already."""
    session(df.sparkSession)
    schema = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), *((f, FIELDS[f][1]) for f in fields)])
    share = sum(_LARGE.get(f, 0) for f in fields)

    def row(k: int | None, raw: bytes | None) -> tuple[dict, int]:
        data = stored(raw) if stored else raw
        got = parse(data)
        payload = payload_of(data, got, track) if data else b""
        return {"key": k, "n_bytes": len(raw or b""), **{f: FIELDS[f][2](data, got, payload) for f in fields}}, 256 + share * len(data or b"")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for b in batches:
            for k, raw in zip(b.column(0), b.column(1), strict=True):
                made, n = row(k.as_py(), raw.as_py())
                kept.append(made)
                held += n
                if held >= OUT_BYTES:
                    yield pa.RecordBatch.from_pylist(kept, schema)
                    kept, held = [], 0
        if kept:
            yield pa.RecordBatch.from_pylist(kept, schema)

    ddl = "key long, n_bytes long" + "".join(f", {f} {FIELDS[f][0]}" for f in fields)
    return df.select(F.col(key).cast("long").alias("key"), source.alias("source")).mapInArrow(run, ddl).withColumnRenamed("key", key)


def store_texts(df: DataFrame, key: str = "doc_id", text: str = "text", fields: tuple[str, ...] = OUTPUTS) -> DataFrame:
    """key, n_bytes (of the text) and the fields: each text as UTF-8, padded, in a Matroska file that is read back, in one pass."""
    return _read(df, key, F.encode(text_or_empty(text), "UTF-8"), 1, fields, lambda raw: mux(padded(raw)))


def media_table(df: DataFrame, key: str = "doc_id", media: str = "media", track: int = 1, fields: tuple[str, ...] = OUTPUTS) -> DataFrame:
    """key, n_bytes (of the file) and the fields of each Matroska file."""
    return _read(df, key, F.col(media), track, fields, None)


def packet_table(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per frame: key, track, timestamp_ns, duration_ns, offset, size, keyframe, lacing, cluster, block, frame."""
    return media_table(df, key, media, fields=("packets",)).select(key, F.inline("packets"))


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "status", "n_packets")
    return store_texts(documents(spark, sf_dir, "doc_id", "text"), fields=fields)
