import hashlib
import random
import struct
import zlib

import pytest
from sparquill.llm import matroska as m
from sparquill.llm import queries


@pytest.mark.parametrize("n", [1, 63, 64, 511, 512, 513, 4095, 4096, 4097, 65536, 65537, 200_003])
def test_payload_comes_back(n):
    payload = random.Random(n).randbytes(n)
    blob = m.mux(payload)
    movie = m.parse(blob)
    assert movie.error is None and m.payload_of(blob, movie) == payload
    assert movie.tracks[1]["codec"] == "A_PCM/INT/LIT" and movie.tracks[1]["rate"] == 8000.0
    assert len(movie.cues) == len(movie.clusters) and [p for *_, p in movie.cues] != []
    starts = sorted({p[1] for p in movie.packets})
    assert starts == [i * 64_000_000 for i in range(len(movie.packets))]
    for at, place in zip(movie.clusters, (c[2] for c in movie.cues), strict=True):
        assert blob[place : place + 4] == bytes.fromhex("1f43b675") and place < at[0]


def block(kind, head, frames):
    return m.element(m.SIMPLE_BLOCK, m.size_vint(1) + struct.pack(">hB", 5, kind) + head + b"".join(frames))


def movie_of(cluster, unknown=False):
    body = m.element(m.TRACKS, m.element(m.TRACK_ENTRY, m.number(m.TRACK_NUMBER, 1)))
    c = m.number(m.CLUSTER_TIME, 7) + cluster
    body += bytes.fromhex("1f43b67501ffffffffffffff") + c if unknown else m.element(m.CLUSTER, c)
    return bytes.fromhex("1853806701ffffffffffffff") + body if unknown else m.element(m.SEGMENT, body)


@pytest.mark.parametrize("unknown", [False, True])
def test_lacing_by_hand(unknown):
    a, b, c = b"a" * 600, b"b" * 10, b"c" * 300
    xiph = bytes([2, 255, 255, 90, 10])
    ebml = bytes([2]) + m.size_vint(600) + ((1 << 14) | (-590 + (1 << 13) - 1)).to_bytes(2, "big")
    cluster = block(2, xiph, [a, b, c]) + block(6, ebml, [a, b, c]) + block(4, bytes([2]), [b, b, b]) + block(0x80, b"", [c])
    cluster += m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.size_vint(1) + struct.pack(">hB", -2, 0) + b) + m.element(m.REFERENCE, b"\x01"))
    blob = movie_of(cluster, unknown)
    got = m.parse(blob)
    assert got.error is None
    frames = [blob[p[4] : p[4] + p[5]] for p in got.packets]
    assert frames == [a, b, c, a, b, c, b, b, b, c, b]
    assert [p[7] for p in got.packets] == ["xiph"] * 3 + ["ebml"] * 3 + ["fixed"] * 3 + ["none"] * 2
    assert [p[6] for p in got.packets][-2:] == [True, False] and got.packets[-1][1] == 5_000_000


def test_damage_gives_what_was_before_it():
    blob = m.mux(bytes(10_000))
    assert m.parse(b"").packets == [] and m.parse(b"\x00\x01").error
    half = m.parse(blob[: len(blob) // 2])
    assert half.error
    bad = movie_of(block(2, bytes([200]), [b"x"]))
    assert "lace" in m.parse(bad).error or m.parse(bad).error
    for i in range(0, 300, 7):  # no input raises
        m.parse(blob[:i] + b"\xff\x00" + blob[i + 2 :])


def test_packet_table(spark):
    files = spark.createDataFrame([(1, bytearray(m.mux(b"q" * 5000)), "x"), (2, None, "x"), (3, bytearray(b"\x00bad"), "x"), (1, bytearray(m.mux(b"r" * 64)), "x")], "id long, media binary, track string")
    rows = m.packet_table(files, "media", "id").collect()
    assert sum(r.id == 1 and r.size is not None for r in rows) == 11 and {r.id for r in rows if r.error} == {3}
    assert sum(r["size"] for r in rows if r.id == 1) == 5064
    assert m.packet_table(files.limit(0), "media", "id").collect() == []


def test_numbers_out_of_range_are_damage(spark):
    frame = lambda track, time: m.element(m.CLUSTER, m.number(m.CLUSTER_TIME, time) + m.element(m.SIMPLE_BLOCK, m.size_vint(track) + struct.pack(">hB", 0, 0x80) + b"frame"))
    whole = lambda scale, *clusters: m.element(m.SEGMENT, m.element(m.INFO, m.number(m.TIMESTAMP_SCALE, scale)) + b"".join(clusters))
    odd = [whole(1, frame(1, 5), frame(1 << 40, 0)), whole(1 << 62, frame(1, 1), frame(1, 1 << 40)), whole(1, frame((1 << 31) - 1, (1 << 63) - 1)), whole(1 << 63, frame(1, 0), frame(1, 1))]
    files = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(odd)], "track int, media binary")
    rows = m.packet_table(files, "media", "track").collect()
    assert {r.track: bool(r.error) for r in rows if r.error} == {0: True, 1: True, 3: True}
    assert sorted((r.track, r._track, r.timestamp_ns) for r in rows if r.size) == [(0, 1, 5), (1, 1, 1 << 62), (2, (1 << 31) - 1, (1 << 63) - 1), (3, 1, 0)]


def test_key_of_any_name(spark):
    for name in ("track", "error", "_key", "media", "Size"):
        files = spark.createDataFrame([("k", bytearray(m.mux(b"q" * 70)))], f"`{name}` string, {'blob' if name == 'media' else 'media'} binary")
        rows = m.packet_table(files, files.columns[1], name).collect()
        assert rows and all(r[0] == "k" for r in rows) and len(set(c.lower() for c in rows[0].asDict())) == 12


def test_query_equals_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op7_matroska(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = docs[r.doc_id].encode()
        p = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(m.mux(p)), hashlib.sha256(m.mux(p)).hexdigest())
