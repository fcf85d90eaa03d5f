"""Media columns in Matroska: writing byte payloads as 8-bit samples and parsing files into packet tables.

parse() reads the variable-length EBML elements of a file: Info and Tracks,
Clusters with SimpleBlocks and BlockGroups, all four kinds of lacing, and Cues.
Each frame becomes a packet with its track, timestamp and byte range in the
file; payloads are read back through those ranges.

A null or empty text gives one frame of zero bytes. A file that isn't valid
raises ValueError in parse(); packets() turns null files into no rows.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import map_batches, table

# Element ids of the Matroska specification (RFC 9559).
EBML, VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, NUMBER, UID, KIND, LACING, CODEC, AUDIO, RATE, CHANNELS, DEPTH, FRAME_NS = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

UNIT = 64  #: payloads are padded to a multiple of this
HZ = 8000  #: samples a second
FRAME = 1024  #: samples of a frame; 128 ms
LACE = 8  #: frames of a block
BLOCKS = 4  #: blocks of a cluster


def vint(value: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones is reserved for an unknown size."""
    if not width:
        width = 1
        while value >= (1 << 7 * width) - 1:
            width += 1
    return (1 << 7 * width | value).to_bytes(width, "big")


def _id(element: int) -> bytes:
    return element.to_bytes((element.bit_length() + 7) // 8, "big")


def element(kind: int, *body: bytes) -> bytes:
    data = b"".join(body)
    return _id(kind) + vint(len(data)) + data


def uint(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """(lacing flag, block data): none for one frame, fixed for equal sizes, Xiph for small ones, else EBML."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if len(set(sizes)) == 1:
        return 2, b"".join((head, *frames))
    if max(sizes) < 255:
        return 1, b"".join((head, *(bytes([s]) for s in sizes[:-1]), *frames))
    out = [head, vint(sizes[0])]
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        width = 1
        while abs(b - a) > (1 << 7 * width - 1) - 1:
            width += 1
        out.append((1 << 7 * width | b - a + (1 << 7 * width - 1) - 1).to_bytes(width, "big"))
    return 3, b"".join((*out, *frames))


@lru_cache(maxsize=1)
def _head() -> tuple[bytes, bytes]:
    head = element(EBML, uint(VERSION, 1), uint(READ_VERSION, 1), uint(MAX_ID, 4), uint(MAX_SIZE, 8), element(DOC_TYPE, b"matroska"), uint(DOC_VERSION, 4), uint(DOC_READ, 2))
    audio = element(AUDIO, element(RATE, struct.pack(">d", HZ)), uint(CHANNELS, 1), uint(DEPTH, 8))
    return head, element(TRACKS, element(TRACK, uint(NUMBER, 1), uint(UID, 1), uint(KIND, 2), uint(LACING, 1), uint(FRAME_NS, FRAME * 10**9 // HZ), element(CODEC, b"A_PCM/INT/LIT"), audio))


def mux(payload: bytes) -> bytes:
    """A file with the payload as unsigned 8-bit samples of one audio track, and a cue for each cluster."""
    head, tracks = _head()
    info = element(INFO, uint(TIMESTAMP_SCALE, 10**6), element(DURATION, struct.pack(">d", len(payload) * 1000 / HZ)), element(MUXER, b"skein"), element(WRITER, b"skein"))
    frames = [payload[k : k + FRAME] for k in range(0, len(payload), FRAME)]
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    for first in range(0, len(frames), LACE * BLOCKS):
        start = first * FRAME * 1000 // HZ
        blocks = []
        for k in range(first, min(first + LACE * BLOCKS, len(frames)), LACE):
            flag, data = lace(frames[k : k + LACE])
            blocks.append(element(SIMPLE_BLOCK, b"\x81", struct.pack(">hB", k * FRAME * 1000 // HZ - start, 0x80 | flag << 1), data))
        cluster = element(CLUSTER, uint(TIMESTAMP, start), *blocks)
        cues.append(element(CUE, uint(CUE_TIME, start), element(CUE_POSITIONS, uint(CUE_TRACK, 1), uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, *parts, element(CUES, *cues))


@dataclass
class Packet:
    track: int
    ns: int
    keyframe: bool
    lacing: int
    cluster: int
    start: int
    end: int


@dataclass
class Movie:
    doc_type: str
    scale: int
    duration: float
    tracks: dict[int, dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # (ns, track, byte position of the cluster)


def _vint(data: bytes, at: int, end: int, keep: bool = False) -> tuple[int, int]:
    """(value, width); keep: with the marker, as in ids. All value bits set: -1, a size that isn't known."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"cut off at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if keep:
        return value, width
    value &= (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), width


#: Elements that hold a cluster or stand beside it end one of unknown size.
_TOP = {SEGMENT, CLUSTER, CUES, INFO, TRACKS, EBML}


def _elements(data: bytes, at: int, end: int):
    """(id, body start, body end) of the children; an unknown size lasts to the next element of the upper levels."""
    while at < end:
        kind, width = _vint(data, at, end, keep=True)
        at += width
        size, width = _vint(data, at, end)
        at += width
        if size >= 0:
            stop = at + size
        elif kind == CLUSTER:
            stop = at
            while stop < end:
                k, w = _vint(data, stop, end, keep=True)
                if k in _TOP:
                    break
                s, w2 = _vint(data, stop + w, end)
                stop += w + w2 + max(s, 0)
        else:
            stop = end
        if stop > end:
            raise ValueError(f"element {kind:X} runs over its parent's end")
        yield kind, at, stop
        at = stop


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    return 0.0 if a == b else struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0]


def _frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if not lacing:
        return [(at, end)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % n:
            raise ValueError("fixed lacing of unequal frames")
        sizes = [(end - at) // n] * n
    elif lacing == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                b = data[at]
                at += 1
                size += b
                if b < 255:
                    break
            sizes.append(size)
    else:
        for k in range(n - 1):
            value, width = _vint(data, at, end)
            if value < 0:
                value = (1 << 7 * width) - 1
            sizes.append(value if not k else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
            at += width
    if lacing != 2:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing beyond the block's end")
    out = []
    for s in sizes:
        out.append((at, at + s))
        at += s
    return out


def parse(data: bytes) -> Movie:
    """The packet table of a file."""
    movie = Movie("", 10**6, 0.0, {}, [], [])
    segment = None
    for kind, a, b in _elements(data, 0, len(data)):
        if kind == EBML:
            movie.doc_type = next((data[x:y].decode("ascii", "replace") for k, x, y in _elements(data, a, b) if k == DOC_TYPE), "matroska")
        elif kind == SEGMENT:
            segment = (a, b)
    if segment is None:
        raise ValueError("no segment")
    blocks: list[tuple[int, int, int, int, bool | None, int]] = []
    clusters = 0
    for kind, a, b in _elements(data, *segment):
        if kind == INFO:
            for k, x, y in _elements(data, a, b):
                if k == TIMESTAMP_SCALE:
                    movie.scale = _uint(data, x, y)
                elif k == DURATION:
                    movie.duration = _float(data, x, y)
        elif kind == TRACKS:
            for _, x, y in _elements(data, a, b):
                track = {"codec": "", "kind": 0, "frame_ns": 0, "rate": 0.0, "channels": 1, "depth": 0}
                number = 0
                for k, p, q in _elements(data, x, y):
                    if k == NUMBER:
                        number = _uint(data, p, q)
                    elif k == CODEC:
                        track["codec"] = data[p:q].decode("ascii", "replace")
                    elif k == KIND:
                        track["kind"] = _uint(data, p, q)
                    elif k == FRAME_NS:
                        track["frame_ns"] = _uint(data, p, q)
                    elif k == AUDIO:
                        for k2, p2, q2 in _elements(data, p, q):
                            if k2 == RATE:
                                track["rate"] = _float(data, p2, q2)
                            elif k2 in (CHANNELS, DEPTH):
                                track["channels" if k2 == CHANNELS else "depth"] = _uint(data, p2, q2)
                movie.tracks[number] = track
        elif kind == CLUSTER:
            time = 0
            for k, x, y in _elements(data, a, b):
                if k == TIMESTAMP:
                    time = _uint(data, x, y)
                elif k == SIMPLE_BLOCK:
                    blocks.append((x, y, time, clusters, None, 0))
                elif k == BLOCK_GROUP:
                    parts = {k2: (p, q) for k2, p, q in _elements(data, x, y)}
                    if BLOCK in parts:
                        blocks.append((*parts[BLOCK], time, clusters, REFERENCE not in parts, _uint(data, *parts[BLOCK_DURATION]) if BLOCK_DURATION in parts else 0))
            clusters += 1
        elif kind == CUES:
            for _, x, y in _elements(data, a, b):
                time, spots = 0, []
                for k, p, q in _elements(data, x, y):
                    if k == CUE_TIME:
                        time = _uint(data, p, q)
                    elif k == CUE_POSITIONS:
                        spot = {k2: _uint(data, p2, q2) for k2, p2, q2 in _elements(data, p, q)}
                        spots.append((spot.get(CUE_TRACK, 0), segment[0] + spot.get(CUE_CLUSTER, 0)))
                movie.cues += [(time, track, at) for track, at in spots]
    movie.cues = [(t * movie.scale, track, at) for t, track, at in movie.cues]
    for a, b, time, cluster, key, ticks in blocks:
        track, width = _vint(data, a, b)
        a += width
        if b - a < 3:
            raise ValueError("a block without its head")
        offset, flags = struct.unpack(">hB", data[a : a + 3])
        lacing = flags >> 1 & 3
        ranges = _frames(data, a + 3, b, lacing)
        step = movie.tracks.get(track, {}).get("frame_ns") or ticks * movie.scale // len(ranges)
        for k, (x, y) in enumerate(ranges):
            movie.packets.append(Packet(track, (time + offset) * movie.scale + k * step, bool(flags & 0x80) if key is None else key, lacing, cluster, x, y))
    return movie


def read_back(data: bytes, movie: Movie, track: int = 1) -> bytes:
    """A track's frames in the order of their timestamps."""
    own = sorted((p for p in movie.packets if p.track == track), key=lambda p: p.ns)
    return b"".join(data[p.start : p.end] for p in own)


def features(movie: Movie, payload: bytes) -> str:
    """Packets by lacing, clusters, cues, duration, and the level, mean and sign changes of the samples around the middle."""
    x = np.frombuffer(payload, np.uint8)
    centred = x.astype(np.int64) - 128
    laced = [sum(p.lacing == k for p in movie.packets) for k in range(4)]
    return f"packets={len(movie.packets)};lacing={'/'.join(map(str, laced))};clusters={1 + max((p.cluster for p in movie.packets), default=-1)};cues={len(movie.cues)};ms={movie.duration:g};mean={int(x.sum())}/{len(x)};power={int((centred**2).sum())};crossings={int((np.diff(centred >= 0) != 0).sum())};peak={int(x.max(initial=0))}"


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % UNIT if raw else UNIT)


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (of the text) and media (the file that holds it) of each row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [padded(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_pydict({id_col: batch.column(0), "n_bytes": pa.array([n for n, _ in made], pa.int64()), "media": pa.array([mux(p) for _, p in made], pa.binary())})

    return map_batches(df, [id_col, text_col], run, f"`{id_col}` {kind}, n_bytes bigint, media binary")


def read(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id, the file, its payload and feature; those of a null file are null."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        payloads, found = [], []
        for data in batch.column(2).to_pylist():
            if data is None:
                payloads.append(None)
                found.append(None)
                continue
            movie = parse(data)
            payload = read_back(data, movie)
            payloads.append(payload)
            found.append(features(movie, payload))
        return pa.RecordBatch.from_pydict({id_col: batch.column(0), "n_bytes": batch.column(1), "media": batch.column(2), "payload": pa.array(payloads, pa.binary()), "feature": pa.array(found, pa.string())})

    return map_batches(df, [id_col, "n_bytes", media_col], run, f"`{id_col}` {kind}, n_bytes bigint, media binary, payload binary, feature string")


def packets(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each packet: id, track, ns, keyframe, lacing, cluster and byte range [start, end) in the file."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, rows = [], []
        for k, data in enumerate(batch.column(1).to_pylist()):
            if data is not None:
                some = parse(data).packets
                rows += some
                at += [k] * len(some)
        cols = {c: pa.array([getattr(p, c) for p in rows], t) for c, t in (("track", pa.int64()), ("ns", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.int32()), ("cluster", pa.int32()), ("start", pa.int64()), ("end", pa.int64()))}
        return pa.RecordBatch.from_pydict({id_col: batch.column(0).take(pa.array(at, pa.int64())), **cols})

    return map_batches(df, [id_col, media_col], run, f"`{id_col}` {kind}, track bigint, ns bigint, keyframe boolean, lacing int, cluster int, `start` bigint, `end` bigint")


def crc32(payload: bytes) -> int:
    return zlib.crc32(payload) & 0xFFFFFFFF


def op7_matroska(spark, sf_dir: str) -> DataFrame:
    got = read(store(table(spark, sf_dir, "documents")))
    return got.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
