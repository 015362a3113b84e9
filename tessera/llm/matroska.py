"""Matroska media columns: a writer for 8-bit PCM and a parser of any file into a packet table.

The parser reads variable-length EBML elements (unknown sizes of segments and clusters included), simple blocks and
block groups with any lacing, and cues.  Element ids are those of the public Matroska specification.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches

#: Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
ENTRY, NUMBER, UID, KIND, CODEC, LACING, AUDIO, RATE, CHANNELS, DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE, GROUP, BLOCK, REFERENCE, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x9B
POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_AT = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, ENTRY, AUDIO, GROUP, POINT, POSITIONS}
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

HERTZ = 8000
UNIT = 64
FRAME = 1024  # samples in a frame: 128 ms
LACE = 8  # frames in a block
BLOCKS = 30  # blocks in a cluster
DEPTH_LIMIT = 16  # elements within elements; the format needs 6
LARGEST = 1 << 63  # numbers from here on fit no column


class Packet(NamedTuple):
    track: int
    timestamp: int
    keyframe: bool
    offset: int
    size: int


class Media(NamedTuple):
    tracks: dict[int, dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # time, track, byte position in the file
    scale: int


def size_bytes(n: int) -> bytes:
    """n as a variable-length size; all ones means unknown, so the largest value of a length is left out."""
    for width in range(1, 9):
        if n < (1 << 7 * width) - 1:
            return (n | 1 << 7 * width).to_bytes(width, "big")
    raise ValueError(n)


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def read_size(data: bytes, at: int, end: int) -> tuple[int | None, int]:
    """The variable-length number at a place, None if it stands for unknown, and the place after it."""
    if at >= end:
        raise ValueError("cut off")
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > end:
        raise ValueError("bad length")
    n = int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1)
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def read_id(data: bytes, at: int, end: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > end:
        raise ValueError("bad id")
    return int.from_bytes(data[at : at + width], "big"), at + width


def write_pcm(payload: bytes) -> bytes:
    """A file with one mono track of unsigned 8-bit PCM at 8 kHz: fixed-size frames in EBML-laced blocks, with cues."""
    header = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    info = element(INFO, number(SCALE, 1_000_000) + element(MUXER, b"tessera") + element(WRITER, b"tessera") + element(DURATION, struct.pack(">d", len(payload) * 1000 / HERTZ)))
    audio = element(AUDIO, element(RATE, struct.pack(">d", HERTZ)) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(TRACKS, element(ENTRY, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    parts, points, at = [info, tracks], [], len(info) + len(tracks)
    step = FRAME * LACE
    for start in range(0, len(payload), step * BLOCKS):
        time = start * 1000 // HERTZ
        blocks = [number(TIMESTAMP, time)]
        for i in range(start, min(start + step * BLOCKS, len(payload)), step):
            frames = [payload[j : j + FRAME] for j in range(i, min(i + step, len(payload)), FRAME)]
            head = b"\x81" + struct.pack(">h", i * 1000 // HERTZ - time)
            if len(frames) == 1:
                blocks.append(element(SIMPLE, head + b"\x80" + frames[0]))
            else:
                sizes = size_bytes(len(frames[0])) + b"".join(_signed(len(b) - len(a)) for a, b in zip(frames, frames[1:-1]))
                blocks.append(element(SIMPLE, head + b"\x86" + bytes([len(frames) - 1]) + sizes + b"".join(frames)))
        cluster = element(CLUSTER, b"".join(blocks))
        points.append(element(POINT, number(CUE_TIME, time) + element(POSITIONS, number(CUE_TRACK, 1) + number(CUE_AT, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(points)))
    return header + element(SEGMENT, b"".join(parts))


def _signed(n: int) -> bytes:
    for width in range(1, 9):
        half = (1 << (7 * width - 1)) - 1
        if -half < n <= half:
            return ((n + half) | 1 << 7 * width).to_bytes(width, "big")
    raise ValueError(n)


def _laced(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block's body."""
    if kind == 0:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        if (end - at) % n:
            raise ValueError("bad lace")
        sizes = [(end - at) // n] * n
    elif kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        size, at = read_size(data, at, end)
        sizes.append(size or 0)
        for _ in range(n - 2):
            width = 9 - data[at].bit_length()
            delta, at = int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1), at + width
            sizes.append(sizes[-1] + delta - ((1 << (7 * width - 1)) - 1))
        sizes = sizes[: n - 1]
    if kind != 2:
        sizes.append(end - at - sum(sizes))
    out = []
    for size in sizes:
        if size < 0 or at + size > end:
            raise ValueError("bad lace")
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Media:
    """Packets in file order with their timestamps (in the file's scale, 1 ms by default) and byte ranges.

    Frames of a lace get timestamps from the track's sample rate where it is 8-bit PCM, else the block's.  A file that
    ends early or is damaged gives the packets before that place; data that is no Matroska file, none.  Elements nested
    deeper than DEPTH_LIMIT, numbers wider than eight bytes or from LARGEST on, and frames past the end are damage.
    """
    tracks: dict[int, dict] = {}
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    state = {"scale": 1_000_000, "time": 0, "segment": 0}

    def block(at: int, end: int, keyframe: bool | None) -> None:
        track, at = read_size(data, at, end)
        rel, flags = struct.unpack_from(">hB", data, at)
        time = state["time"] + rel
        t = tracks.get(track or 0, {})
        per_ms = t.get("rate", 0) * t.get("channels", 1) * t.get("depth", 0) / 8000 if t.get("codec", "").startswith("A_PCM") else 0
        ahead = 0
        for offset, size in _laced(data, at + 3, end, flags >> 1 & 3):
            due = time + (int(ahead / per_ms) if per_ms else 0)
            if due >= LARGEST:
                raise ValueError("late")
            packets.append(Packet(track or 0, due, bool(flags & 0x80) if keyframe is None else keyframe, offset, size))
            ahead += size

    def uint(at: int, end: int) -> int:
        if end - at > 8 or end > len(data) or (n := int.from_bytes(data[at:end], "big")) >= LARGEST:
            raise ValueError("wide number")
        return n

    def fields(at: int, end: int) -> dict[int, tuple[int, int]]:
        out = {}
        while at < end:
            ident, at = read_id(data, at, end)
            n, at = read_size(data, at, end)
            if n is None or at + n > end:
                raise ValueError("cut off")
            out[ident] = (at, at + n)
            at += n
        return out

    def hertz(raw: bytes) -> float:
        rate = struct.unpack(">d" if len(raw) == 8 else ">f", raw)[0] if raw else 8000.0
        if not 1 <= rate < 1e9:
            raise ValueError("bad rate")
        return rate

    def walk(at: int, end: int, inside: int, depth: int = 0) -> int:
        """Read elements up to end; where inside has an unknown size, up to an element that can't be in it."""
        if depth > DEPTH_LIMIT:
            raise ValueError("too deep")
        while at < end:
            ident, body = read_id(data, at, end)
            if inside == -CLUSTER and (ident in TOP or ident == SEGMENT):
                return at
            n, body = read_size(data, body, end)
            stop = end if n is None else min(body + n, end)
            if n is None and ident not in (SEGMENT, CLUSTER):
                raise ValueError("unknown size")
            if ident == SEGMENT:
                state["segment"] = body
            if ident == SCALE:
                state["scale"] = uint(body, stop)
            elif ident == TIMESTAMP:
                state["time"] = uint(body, stop)
            elif ident == SIMPLE:
                if n is not None and body + n <= end:
                    block(body, stop, None)
            elif ident == GROUP:
                inner = fields(body, stop)
                if BLOCK in inner:
                    block(*inner[BLOCK], REFERENCE not in inner)
            elif ident == ENTRY:
                f = fields(body, stop)
                a = fields(*f[AUDIO]) if AUDIO in f else {}
                tracks[uint(*f[NUMBER])] = {
                    "type": uint(*f[KIND]) if KIND in f else 0,
                    "codec": data[slice(*f[CODEC])].decode("ascii", "replace") if CODEC in f else "",
                    "rate": hertz(data[slice(*a[RATE])] if RATE in a else b""),
                    "channels": uint(*a[CHANNELS]) if CHANNELS in a else 1,
                    "depth": uint(*a[DEPTH]) if DEPTH in a else 0,
                }
            elif ident == POINT:
                f = fields(body, stop)
                p = fields(*f[POSITIONS])
                cues.append((uint(*f[CUE_TIME]), uint(*p[CUE_TRACK]), state["segment"] + uint(*p[CUE_AT])))
            elif ident in MASTERS:
                stop = walk(body, stop, -CLUSTER if n is None and ident == CLUSTER else ident, depth + 1)
            at = stop
        return at

    try:
        if data[:4] == EBML.to_bytes(4, "big"):
            walk(0, len(data), 0)
    except (ValueError, IndexError, struct.error, KeyError, TypeError):
        pass
    return Media(tracks, packets, cues, state["scale"])


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[p.offset : p.offset + p.size] for p in media.packets if p.track == track)


def pad(raw: bytes, unit: int = UNIT) -> bytes:
    """raw with zero bytes up to a positive multiple of unit."""
    return raw + bytes(-len(raw) % unit if raw else unit)


def features(payload: bytes, media: Media) -> str:
    """Packets, length, mean, power, zero crossings about the middle value and peak of 8-bit samples; whole numbers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    n = max(1, len(x))
    total, power = int(x.sum(dtype=np.int64)), int((x.astype(np.int32) ** 2).sum(dtype=np.int64))
    return f"packets={len(media.packets)};ms={len(x) * 1000 // HERTZ};mean={total * 1000 // n};power={power // n};crossings={crossings};peak={int(np.abs(x).max(initial=0))}"


def to_media(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """docs with media_col, the file that holds the text's UTF-8 bytes (null: none) padded to whole units.

    Null and empty texts give a file of one unit of zero bytes, equal texts equal files, a row each; an empty table gives
    an empty result.  A column of that name is replaced; all others pass through."""
    names = [c for c in docs.columns if c != media_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        media = [write_pcm(pad((t.as_py() or "").encode("utf-8", "surrogatepass"))) for t in batch.column(text_col)]
        return pa.record_batch([*(batch.column(c) for c in names), pa.array(media, pa.binary())], names=[*names, media_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != media_col)
    return map_batches(docs.select(*names), run, f"{schema}, `{media_col}` binary")


def packet_table(df: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """(id_col, track, timestamp, keyframe, offset, size): one row for each packet; null or foreign media have none.

    Rows that repeat, or whose id is null, give their packets again; other columns are ignored.  See parse() for damage."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, *p) for i, m in zip(batch.column(0).to_pylist(), batch.column(1)) if m.is_valid for p in parse(m.as_py()).packets]
        cols = list(zip(*rows)) if rows else [[]] * 6
        types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "track", "timestamp", "keyframe", "offset", "size"])

    return map_batches(df.select(id_col, media_col), run, f"id {kind}, track long, timestamp long, keyframe boolean, offset long, size long").withColumnRenamed("id", id_col)


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as media, read the stored bytes back through the parser, and describe both.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.  Null and
    empty texts are one unit of zero bytes.  Equal texts give equal values; repeated rows and null ids stay; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t in batch.column(1):
            raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
            stored = write_pcm(pad(raw))
            media = parse(stored)
            back = payload_of(stored, media)
            out.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), features(back, media)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col), run, schema)
