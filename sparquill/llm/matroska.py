"""Media columns: Matroska files as binary values, and their packet tables.

``parse`` walks variable-length EBML elements (known and unknown sizes), clusters,
simple blocks and block groups, undoes Xiph, EBML and fixed-size lacing, and reads
cues. It gives one packet for each frame, with track, timestamp in nanoseconds and
byte range. ``mux`` writes payloads as 8-bit PCM in clusters of laced blocks.

Defined results: a null or empty value has no packets; a damaged file gives the packets
before the damage and says where it is in ``error``, and so does one with numbers that
a packet table can't hold (tracks beyond 31 bits, times beyond 63 bits of nanoseconds);
an empty payload can't be muxed as a block and gives a file without clusters. Repeated
rows give their packets each. The key may have any name; packet columns of that name
begin with an underscore.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from .common import fresh, small_batches

# Fixed values of the format (element ids).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS, EBML}
TOP = {INFO, TRACKS, CLUSTER, CUES}
LACINGS = {0: "none", 2: "xiph", 4: "fixed", 6: "ebml"}

RATE = 8000
FRAME = 512
LACED = 8
BLOCKS_PER_CLUSTER = 16


# -- writing ---------------------------------------------------------------


def size_vint(n: int, width: int = 0) -> bytes:
    width = width or max(1, -(-(n + 1).bit_length() // 7))
    if n >= (1 << 7 * width) - 1:
        width += 1
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def element(ident: int, body: bytes, width: int = 0) -> bytes:
    return ident.to_bytes(-(-ident.bit_length() // 8), "big") + size_vint(len(body), width) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, -(-n.bit_length() // 8)), "big"))


def _xiph(sizes: list[int]) -> bytes:
    return b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])


def _ebml_sizes(sizes: list[int]) -> bytes:
    out = size_vint(sizes[0])
    for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
        d, width = b - a, 1
        while not -(1 << 7 * width - 1) < d < (1 << 7 * width - 1):
            width += 1
        out += ((1 << 7 * width) | (d + (1 << 7 * width - 1) - 1)).to_bytes(width, "big")
    return out


def simple_block(track: int, time: int, frames: list[bytes], odd: bool) -> bytes:
    """Equal frames are laced with fixed size, others by the Xiph or the EBML scheme."""
    sizes = [len(x) for x in frames]
    if len(frames) == 1:
        flags, lace = 0x80, b""
    else:
        kind = 4 if len(set(sizes)) == 1 else 2 if odd else 6
        flags = 0x80 | kind
        lace = bytes([len(frames) - 1]) + (b"" if kind == 4 else _xiph(sizes) if kind == 2 else _ebml_sizes(sizes))
    return element(SIMPLE_BLOCK, size_vint(track) + struct.pack(">hB", time, flags) + lace + b"".join(frames))


def mux(payload: bytes) -> bytes:
    """A Matroska file whose one PCM track has the bytes of ``payload`` as 8-bit samples."""
    step = FRAME * LACED
    frame_ms = FRAME * 1000 // RATE
    clusters, cues = [], []
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"sparquill") + element(WRITING_APP, b"sparquill") + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", float(RATE))) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + number(DEFAULT_DURATION, frame_ms * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    at = len(info) + len(tracks)
    for begin in range(0, len(payload), step * BLOCKS_PER_CLUSTER):
        time = begin // FRAME * frame_ms
        body = [number(CLUSTER_TIME, time)]
        for k, b in enumerate(range(begin, min(len(payload), begin + step * BLOCKS_PER_CLUSTER), step)):
            frames = [payload[i : i + FRAME] for i in range(b, min(b + step, len(payload)), FRAME)]
            body.append(simple_block(1, k * LACED * frame_ms, frames, (b // step) % 2 == 1))
        clusters.append(element(CLUSTER, b"".join(body)))
        cues.append(element(CUE_POINT, number(CUE_TIME, time) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        at += len(clusters[-1])
    head = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
    return head + element(SEGMENT, b"".join([info, tracks, *clusters, element(CUES, b"".join(cues)) if cues else b""]), 8)


# -- reading ---------------------------------------------------------------


@dataclass
class Movie:
    scale: int = 1_000_000
    duration: float | None = None
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: list[tuple[int, int, int]] = field(default_factory=list)
    packets: list[tuple] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    error: str | None = None


class Damage(ValueError):
    pass


def vint(data: memoryview, at: int, end: int, marker: bool) -> tuple[int, int, bool]:
    """Value, next position and whether all value bits are set; ``marker`` keeps the length bit (ids)."""
    if at >= end or not data[at]:
        raise Damage(f"no variable-length number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Damage(f"a number at byte {at} ends beyond its parent")
    n = int.from_bytes(data[at : at + width], "big")
    bare = n & ((1 << 7 * width) - 1)
    return n if marker else bare, at + width, bare == (1 << 7 * width) - 1


def elements(data: memoryview, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """Id, start, body and end of each element; one of unknown size reaches to ``end``."""
    while at < end:
        ident, body, _ = vint(data, at, end, True)
        size, body, unknown = vint(data, body, end, False)
        stop = end if unknown else body + size
        if stop > end:
            raise Damage(f"the element at byte {at} ends beyond its parent")
        yield ident, at, body, stop
        at = stop


def _uint(data: memoryview, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: memoryview, a: int, b: int) -> float:
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b - a in (4, 8) else 0.0


def lace_sizes(data: memoryview, at: int, end: int, kind: int) -> tuple[int, list[int]]:
    """Where the frames begin, and their sizes."""
    if kind == 0:
        return at, [end - at]
    if at >= end:
        raise Damage(f"a lace at byte {at} has no count")
    frames, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 4:
        if (end - at) % frames:
            raise Damage(f"frames of fixed size at byte {at} don't fill their block")
        return at, [(end - at) // frames] * frames
    for k in range(frames - 1):
        if kind == 2:
            n = 0
            while True:
                if at >= end:
                    raise Damage(f"a lace ends early at byte {at}")
                n, at, more = n + data[at], at + 1, data[at] == 255
                if not more:
                    break
        else:
            begin = at
            n, at, _ = vint(data, at, end, False)
            if k:
                n += sizes[-1] - ((1 << 7 * (at - begin) - 1) - 1)
        sizes.append(n)
    rest = end - at - sum(sizes)
    if rest < 0 or min(sizes, default=0) < 0:
        raise Damage(f"a lace before byte {at} is longer than its block")
    return at, [*sizes, rest]


def _block(m: Movie, data: memoryview, a: int, b: int, time: int, key: bool | None) -> None:
    track, at, _ = vint(data, a, b, False)
    if at + 3 > b:
        raise Damage(f"the block at byte {a} has no header")
    rel, flags = struct.unpack(">hB", data[at : at + 3])
    at, sizes = lace_sizes(data, at + 3, b, flags & 6)
    each = m.tracks.get(track, {}).get("default_duration") or 0
    stamp = (time + rel) * m.scale
    if track >= 1 << 31 or max(abs(stamp), abs(stamp + len(sizes) * each)) >= 1 << 63:
        raise Damage(f"the block at byte {a} has a track or a time out of range")
    for k, n in enumerate(sizes):
        m.packets.append((track, stamp + k * each, len(m.clusters) - 1, k, at, n, bool(flags & 0x80) if key is None else key, LACINGS[flags & 6]))
        at += n


def _cluster(m: Movie, data: memoryview, head: int, a: int, b: int) -> int:
    """Reads a cluster (of clusters: body, time, start); returns where it ends, which an unknown size leaves to its contents."""
    time = 0
    m.clusters.append((a, 0, head))
    for ident, start, body, stop in elements(data, a, b):
        if ident in TOP:
            return start
        if ident == CLUSTER_TIME:
            time = _uint(data, body, stop)
            m.clusters[-1] = (a, time, head)
        elif ident == SIMPLE_BLOCK:
            _block(m, data, body, stop, time, None)
        elif ident == BLOCK_GROUP:
            inner = list(elements(data, body, stop))
            for i, _, x, y in inner:
                if i == BLOCK:
                    _block(m, data, x, y, time, all(j != REFERENCE for j, *_ in inner))
    return b


def _segment(m: Movie, data: memoryview, a: int, b: int) -> None:
    at = a
    while at < b:
        ident, _, body, stop = next(elements(data, at, b))
        if ident == CLUSTER:
            stop = _cluster(m, data, at, body, stop)
        elif ident == INFO:
            for i, _, x, y in elements(data, body, stop):
                if i == TIMESTAMP_SCALE:
                    m.scale = _uint(data, x, y)
                elif i == DURATION:
                    m.duration = _float(data, x, y)
        elif ident == TRACKS:
            for i, _, x, y in elements(data, body, stop):
                if i == TRACK_ENTRY:
                    t: dict = {}
                    for j, _, p, q in elements(data, x, y):
                        if j == CODEC_ID:
                            t["codec"] = bytes(data[p:q]).decode("ascii", "replace")
                        elif j in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
                            t[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_duration"}[j]] = _uint(data, p, q)
                        elif j == AUDIO:
                            for k, _, c, d in elements(data, p, q):
                                t[{SAMPLING: "rate", CHANNELS: "channels", BIT_DEPTH: "bits"}.get(k, "other")] = _float(data, c, d) if k == SAMPLING else _uint(data, c, d)
                    m.tracks[t.get("number", 0)] = t
        elif ident == CUES:
            for i, _, x, y in elements(data, body, stop):
                if i == CUE_POINT:
                    time = track = place = 0
                    for j, _, p, q in elements(data, x, y):
                        if j == CUE_TIME:
                            time = _uint(data, p, q)
                        elif j == CUE_POSITIONS:
                            for k, _, c, d in elements(data, p, q):
                                track, place = (_uint(data, c, d), place) if k == CUE_TRACK else (track, _uint(data, c, d)) if k == CUE_CLUSTER else (track, place)
                    m.cues.append((time, track, a + place))
        at = stop


def parse(blob: bytes | memoryview) -> Movie:
    m, data = Movie(), memoryview(blob).cast("B")
    try:
        for ident, _, body, stop in elements(data, 0, len(data)):
            if ident == SEGMENT:
                _segment(m, data, body, stop)
    except Damage as e:
        m.error = str(e)
    return m


def packet_rows(m: Movie) -> list[tuple]:
    """The packets of a file as rows of the packet table, without ``error``."""
    cued = {place for *_, place in m.cues}
    starts = [head for *_, head in m.clusters]
    return [(p[0], m.tracks.get(p[0], {}).get("codec"), *p[1:], starts[p[2]] in cued) for p in m.packets]


def payload(blob: bytes, rows: list[tuple], track: int = 1) -> bytes:
    """The byte ranges of a track's packets, in order of their timestamps."""
    own = sorted((r for r in rows if r[0] == track), key=lambda r: (r[2], r[5]))
    return b"".join(blob[r[5] : r[5] + r[6]] for r in own)


def payload_of(blob: bytes, m: Movie, track: int = 1) -> bytes:
    return payload(blob, packet_rows(m), track)


PACKETS = {
    "track": pa.int32(), "codec": pa.string(), "timestamp_ns": pa.int64(), "cluster": pa.int32(), "frame": pa.int32(), "offset": pa.int64(), "size": pa.int64(), "keyframe": pa.bool_(), "lacing": pa.string(), "cue": pa.bool_(), "error": pa.string()
}


def packet_table(files: DataFrame, media: str, key: str) -> DataFrame:
    """One row for each packet of each binary value, and one with ``error`` for each damaged value."""
    small_batches(files.sparkSession)
    names = fresh([key], *PACKETS)
    kinds = [T.StructField(n, from_arrow_type(t)) for n, t in zip(names, PACKETS.values(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, blob in zip(batch.column("_key"), batch.column("_media"), strict=True):
                m = parse(blob.as_buffer()) if blob.is_valid else Movie()
                rows = [(*r, None) for r in packet_rows(m)]
                rows += [(*[None] * (len(PACKETS) - 1), m.error)] if m.error else []
                if rows:
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PACKETS.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(rows), batch.column("_key").type), *cols], names=[key, *names])

    return files.select(F.col(key).alias("_key"), F.col(media).alias("_media")).mapInArrow(run, T.StructType([T.StructField(key, files.schema[key].dataType), *kinds]))
