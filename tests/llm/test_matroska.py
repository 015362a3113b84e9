import hashlib
import struct
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import matroska as M

from .data import DOCS, frame


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 600_000), st.integers(0, 255))
def test_round_trip(n, seed):
    raw = bytes((i * 31 + seed) & 255 for i in range(n))
    stored = M.write_pcm(M.pad(raw))
    media = M.parse(stored)
    assert M.payload_of(stored, media) == M.pad(raw)
    assert [p.timestamp for p in media.packets] == [i * 128 for i in range(len(media.packets))]
    assert all(stored[at : at + 4] == M.CLUSTER.to_bytes(4, "big") for _, _, at in media.cues)


def test_lacings_groups_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 5, b"c" * 255, b"d"]
    xiph = bytes([3]) + b"\xff\x2d" + b"\x05" + b"\xff\x00" + b"".join(frames)
    fixed = bytes([2]) + b"xxyyzz"
    blocks = M.element(M.SIMPLE, b"\x82\x00\x05\x82" + xiph) + M.element(M.GROUP, M.element(M.BLOCK, b"\x82\xff\xff\x04" + fixed) + M.number(M.REFERENCE, 1))
    cluster = M.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + M.number(M.TIMESTAMP, 100) + blocks
    data = M.element(M.EBML, b"") + M.SEGMENT.to_bytes(4, "big") + b"\xff" + M.element(M.INFO, M.number(M.SCALE, 500)) + cluster + cluster
    media = M.parse(data)
    assert media.scale == 500 and len(media.packets) == 14
    assert [data[p.offset : p.offset + p.size] for p in media.packets[:7]] == [*frames, b"xx", b"yy", b"zz"]
    assert media.packets[0] == (2, 105, True, media.packets[0].offset, 300) and media.packets[4].timestamp == 99 and not media.packets[4].keyframe


def test_foreign_and_cut_off_data():
    assert M.parse(b"RIFF....").packets == [] and M.parse(b"").packets == []
    stored = M.write_pcm(bytes(50_000))
    assert 0 < len(M.parse(stored[:30_000]).packets) < len(M.parse(stored).packets)


@given(st.integers(0, (1 << 56) - 3))
def test_sizes(n):
    coded = M.size_bytes(n)
    assert M.read_size(coded, 0, len(coded)) == (n, len(coded))


def test_digest(spark):
    rows = {str(r.doc_id): r for r in M.media_digest(frame(spark)).collect()}
    for i, t, _ in DOCS:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = rows[str(i)]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_bytes > r.payload_bytes
    packets = M.packet_table(M.to_media(frame(spark)), "doc_id")
    assert packets.where("doc_id = 12").count() == 1 and packets.where("doc_id = 10").count() > 50
    assert M.media_digest(frame(spark, [])).collect() == []
    assert struct.calcsize(">d") == 8


def test_damaged_files_give_what_stands_before():
    stored = M.write_pcm(bytes(range(256)) * 40)
    whole = M.parse(stored).packets
    nested = b""
    for _ in range(3000):
        nested = M.element(M.SEGMENT, nested)
    assert M.parse(M.element(M.EBML, b"") + nested).packets == []
    body = stored[len(M.element(M.EBML, b"")) :]
    assert M.parse(stored + nested).packets == whole and body
    wide = M.element(M.CLUSTER, M.element(M.TIMESTAMP, b"\xff" * 9) + M.element(M.SIMPLE, b"\x81\x00\x00\x80abc"))
    huge = M.element(M.CLUSTER, M.element(M.TIMESTAMP, b"\xff" * 8) + M.element(M.SIMPLE, b"\x81\x00\x00\x80abc"))
    late = M.element(M.CLUSTER, M.element(M.TIMESTAMP, b"\x7f" + b"\xff" * 7) + M.element(M.SIMPLE, b"\x81\x7f\xff\x80abc"))
    for bad in (wide, huge, late):
        assert M.parse(stored + bad).packets == whole


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_any_bytes_parse(data):
    """Changed, cut and inserted bytes never raise, and every packet lies in the file with numbers that fit a long."""
    raw = bytearray(M.write_pcm(bytes(range(256)) * data.draw(st.integers(1, 80))))
    for _ in range(data.draw(st.integers(1, 8))):
        at = data.draw(st.integers(0, min(len(raw) - 1, 300) if data.draw(st.booleans()) else len(raw) - 1))
        raw[at : at + data.draw(st.integers(0, 3))] = data.draw(st.binary(max_size=6))
        if not raw:
            return
    media = M.parse(bytes(raw))
    for p in media.packets:
        assert 0 <= p.offset <= p.offset + p.size <= len(raw) and -(1 << 63) <= p.timestamp < 1 << 63


def test_packet_table_of_hostile_media(spark):
    nested = b""
    for _ in range(3000):
        nested = M.element(M.SEGMENT, nested)
    wide = M.element(M.CLUSTER, M.element(M.TIMESTAMP, b"\xff" * 9))
    rows = [(1, bytearray(M.element(M.EBML, b"") + nested)), (2, bytearray(M.write_pcm(bytes(64)) + wide)), (3, None), (4, bytearray(b""))]
    df = spark.createDataFrame(rows, "id long, media binary")
    assert [r.id for r in M.packet_table(df, "id").collect()] == [2]
