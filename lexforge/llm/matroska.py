"""Op 1, media columns: texts as 8-bit PCM in Matroska, parsed back into packet tables.

``mux`` writes a payload as one audio track: EBML header, Segment, Info, Tracks, Clusters of SimpleBlocks
(unlaced, Xiph-, fixed- or EBML-laced) and Cues. ``parse`` reads any such file, also with elements of
unknown size, BlockGroups and several tracks, and gives tracks, packets and cue points.

Defined results: a null or empty text is a payload of 64 zero bytes; null media, or media that is no
EBML, has no packets and a status that says so; what a truncated file still holds whole is returned.
Equal texts have equal files; repeated rows have a row each. A very long text has more clusters. An empty table has an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, tidy

RATE = 8000
FRAME = 512  # bytes; 64 ms at 8 bits and 8000 Hz
LACE = 8  # frames in a block
BLOCKS = 16  # blocks in a cluster

EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_AT = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0x1F43B675, 0xA0, 0x1C53BB6B, 0xBB, 0xB7
TIMECODE, SIMPLE, BLOCK, DURATION, REFERENCE, SCALE = 0xE7, 0xA3, 0xA1, 0x9B, 0xFB, 0x2AD7B1
NUMBER, KIND, CODEC, DEFAULT, FREQUENCY, CHANNELS, DEPTH = 0xD7, 0x83, 0x86, 0x23E383, 0xB5, 0x9F, 0x6264
CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xB3, 0xF7, 0xF1
LACING = ("none", "xiph", "fixed", "ebml")


class Damaged(ValueError):
    """An element that ends after its parent, or bytes that are no element."""


# ---- writing -----------------------------------------------------------------------------------------


def vint(n: int, width: int = 0) -> bytes:
    """``n`` as an EBML size; all ones is kept for "unknown"."""
    w = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * w).to_bytes(w, "big")


def uint(n: int) -> bytes:
    return n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")


def element(key: int, body: bytes) -> bytes:
    return uint(key) + vint(len(body)) + body


def laced(frames: list[bytes], how: int) -> bytes:
    """The lace head and the frames; ``how`` is 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if how == 0:
        return frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if how == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif how == 3:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            w = next(w for w in range(1, 9) if abs(b - a) < 1 << (7 * w - 1))
            head += vint(b - a + (1 << (7 * w - 1)) - 1, w)
    return head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """The payload, a multiple of 8 bytes, as a Matroska file; equal payloads give equal files."""
    head = element(EBML, element(0x4286, b"\1") + element(0x42F7, b"\1") + element(0x42F2, b"\4") + element(0x42F3, b"\x08") + element(0x4282, b"matroska") + element(0x4287, b"\4") + element(0x4285, b"\2"))
    seconds = np.array([len(payload) * 1000 / RATE], ">f8").tobytes()
    body = element(INFO, element(SCALE, uint(1_000_000)) + element(0x4489, seconds) + element(0x4D80, b"lexforge") + element(0x5741, b"lexforge"))
    audio = element(AUDIO, element(FREQUENCY, np.array([RATE], ">f4").tobytes()) + element(CHANNELS, b"\1") + element(DEPTH, b"\x08"))
    body += element(TRACKS, element(TRACK, element(NUMBER, b"\1") + element(0x73C5, b"\1") + element(KIND, b"\2") + element(0x9C, b"\1") + element(DEFAULT, uint(FRAME * 1_000_000_000 // RATE)) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    parts, at, cues = [body], len(body), []
    step = FRAME * LACE
    for c in range(0, len(payload), step * BLOCKS):
        start = c * 1000 // RATE
        blocks = [element(TIMECODE, uint(start))]
        for b in range(c, min(c + step * BLOCKS, len(payload)), step):
            frames = [payload[i : i + FRAME] for i in range(b, min(b + step, len(payload)), FRAME)]
            whole = len(frames[-1]) == FRAME
            how = 0 if len(frames) == 1 else (2, 1, 3)[b // step % 3] if whole else (1, 3)[b // step % 2]
            blocks.append(element(SIMPLE, b"\x81" + (b * 1000 // RATE - start).to_bytes(2, "big", signed=True) + bytes([0x80 | how << 1]) + laced(frames, how)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE, element(CUE_TIME, uint(start)) + element(CUE_AT, element(CUE_TRACK, b"\1") + element(CUE_CLUSTER, uint(at)))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    segment = b"".join(parts)
    return head + uint(SEGMENT) + vint(len(segment), 8) + segment


# ---- reading -----------------------------------------------------------------------------------------


@dataclass
class Media:
    tracks: dict[int, dict] = field(default_factory=dict)
    #: track, cluster, block, lace index, lacing, keyframe, timestamp in ns, offset, size
    packets: list[tuple] = field(default_factory=list)
    #: time in ns, track, offset of the cluster in the file
    cues: list[tuple] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    status: str = "ok"


def _size(data: bytes, at: int) -> tuple[int, int]:
    """An EBML size at ``at`` and where it ends; -1 is "unknown"."""
    first = data[at]
    if not first:
        raise Damaged("size of more than 8 bytes")
    w = 9 - first.bit_length()
    if at + w > len(data):
        raise Damaged("ends in a size")
    n = int.from_bytes(data[at : at + w], "big") ^ 1 << 7 * w
    return (-1 if n == (1 << 7 * w) - 1 else n), at + w


def elements(data: bytes, at: int, end: int):
    """(id, start of the element, start and end of its body, whether its size is known)."""
    while at < end:
        first = data[at]
        w = 9 - first.bit_length()
        if not first or w > 4 or at + w >= end:
            raise Damaged("no element id")
        key = int.from_bytes(data[at : at + w], "big")
        n, body = _size(data, at + w)
        stop = end if n < 0 else body + n
        yield key, at, body, stop, n >= 0
        if stop > end:
            raise Damaged("an element ends after its parent")
        at = stop


def _lace(data: bytes, at: int, end: int, how: int) -> list[tuple[int, int]]:
    """(offset, size) of each frame."""
    if not how:
        return [(at, end - at)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if how == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif how == 3 and n > 1:
        size, at = _size(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            start = at
            d, at = _size(data, at)
            sizes.append(sizes[-1] + d - ((1 << (7 * (at - start) - 1)) - 1))
    elif how == 2:
        if (end - at) % n:
            raise Damaged("fixed lacing of unequal frames")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Damaged("laced frames are longer than their block")
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    return out


def parse(data: bytes | None) -> Media:
    """Tracks, packets with byte ranges, and cues; ``status`` says what was wrong."""
    m = Media()
    if data is None:
        m.status = "null"
        return m
    scale, base, pending = [1_000_000], [0], []
    num = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: float(np.frombuffer(data[a:b], ">f8" if b - a == 8 else ">f4")[0]) if b > a else 0.0

    def block(a: int, b: int, when: int, simple: bool, key: bool, duration: int | None) -> None:
        track, p = _size(data, a)
        if p + 3 > b:
            raise Damaged("ends in a block head")
        t, flags = when + int.from_bytes(data[p : p + 2], "big", signed=True), data[p + 2]
        how = flags >> 1 & 3
        frames = _lace(data, p + 3, b, how)
        each = m.tracks.get(track, {}).get("default_ns") or (duration or 0) * scale[0] // len(frames)
        number = len(m.packets) and m.packets[-1][2] + 1
        key = bool(flags & 0x80) if simple else key
        m.packets.extend((track, len(m.clusters) - 1, number, i, LACING[how], key, t * scale[0] + i * each, o, s) for i, (o, s) in enumerate(frames))

    def cluster(a: int, b: int) -> int:
        when = 0
        for key, start, x, y, _ in elements(data, a, b):
            if key in (CLUSTER, CUES, SEGMENT, TRACKS, INFO):  # ends a cluster of unknown size
                return start
            if y > b:
                raise Damaged("ends in a cluster")
            if key == TIMECODE:
                when = num(x, y)
            elif key == SIMPLE:
                block(x, y, when, True, True, None)
            elif key == GROUP:
                inner = {k: (p, q) for k, _, p, q, _ in elements(data, x, y)}
                if BLOCK in inner:
                    block(*inner[BLOCK], when, False, REFERENCE not in inner, num(*inner[DURATION]) if DURATION in inner else None)
        return b

    def segment(a: int, b: int) -> None:
        at = a
        while at < b:
            key, start, x, y, known = next(elements(data, at, b))
            if y > b and key != CLUSTER:
                raise Damaged("ends in an element")
            if key == INFO:
                scale[0] = next((num(p, q) for k, _, p, q, _ in elements(data, x, y) if k == SCALE), scale[0])
            elif key == TRACKS:
                for k, _, p, q, _ in elements(data, x, y):
                    if k == TRACK:
                        f = {k2: (p2, q2) for k2, _, p2, q2, _ in elements(data, p, q)}
                        sound = {k2: (p2, q2) for k2, _, p2, q2, _ in elements(data, *f[AUDIO])} if AUDIO in f else {}
                        m.tracks[num(*f[NUMBER])] = {"kind": num(*f[KIND]) if KIND in f else 0, "codec": data[slice(*f[CODEC])].decode("ascii", "replace") if CODEC in f else "", "default_ns": num(*f[DEFAULT]) if DEFAULT in f else 0, "rate": real(*sound[FREQUENCY]) if FREQUENCY in sound else 0.0, "bits": num(*sound[DEPTH]) if DEPTH in sound else 0}
            elif key == CLUSTER:
                m.clusters.append(start)
                end = cluster(x, min(y, b))
                if y > b:
                    raise Damaged("ends in a cluster")
                at = y if known else end
                continue
            elif key == CUES:
                for k, _, p, q, _ in elements(data, x, y):
                    if k == CUE:
                        inner = list(elements(data, p, q))
                        when = next((num(c, d) for e, _, c, d, _ in inner if e == CUE_TIME), 0)
                        for e, _, c, d, _ in inner:
                            if e == CUE_AT:
                                f = {k2: num(p2, q2) for k2, _, p2, q2, _ in elements(data, c, d)}
                                pending.append((when, f.get(CUE_TRACK, 0), base[0] + f.get(CUE_CLUSTER, 0)))
            at = y

    try:
        top = list(elements(data, 0, len(data))) if data else []
    except (Damaged, IndexError):
        top = []
        try:
            for x in elements(data, 0, len(data)):
                top.append(x)
        except (Damaged, IndexError):
            pass
        m.status = "damaged"
    if not top or top[0][0] != EBML:
        m.status = "not EBML"
        return m
    try:
        for key, _, x, y, _ in top:
            if key == SEGMENT:
                base[0] = x
                segment(x, min(y, len(data)))
    except (Damaged, IndexError):
        m.status = "damaged"
    m.cues = [(when * scale[0], track, at) for when, track, at in pending]
    return m


def payload_of(data: bytes, m: Media) -> bytes:
    """The bytes of the packets, in their order."""
    return b"".join([data[p[7] : p[7] + p[8]] for p in m.packets])


# ---- DataFrames --------------------------------------------------------------------------------------

PACKETS = "track int, cluster int, block int, lace int, lacing string, keyframe boolean, timestamp_ns long, offset long, size long, cue_offset long, status string"


def packet_table(df: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """One row per packet of each media value, with the cluster offset that its cue names (null: none).

    A value without packets has one row, with nulls and its status.
    """
    id_type = df.schema[id_column].dataType.simpleString()
    kinds = pa.schema([("track", pa.int32()), ("cluster", pa.int32()), ("block", pa.int32()), ("lace", pa.int32()), ("lacing", pa.string()), ("keyframe", pa.bool_()), ("timestamp_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int64())])

    def run(batches):
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                m = parse(value.as_py())
                cue = {at: at for _, _, at in m.cues}
                rows = m.packets or [(None,) * 9]
                columns = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), kinds, strict=True)]
                cues = [cue.get(m.clusters[p[1]]) if p[1] is not None else None for p in rows]
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(rows), batch.schema.field(0).type), *columns, pa.array(cues, pa.int64()), pa.array([m.status] * len(rows))], names=[batch.schema.names[0], *kinds.names, "cue_offset", "status"])

    return df.select(id_column, media_column).mapInArrow(tidy(run), f"`{id_column}` {id_type}, {PACKETS}")


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or 64 * (not text))


def to_matroska(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, media binary): each text's padded payload as a Matroska file."""
    id_type = df.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                media = [mux(padded((t.as_py() or "").encode())) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], names=[batch.schema.names[0], "media"])

    return df.select(id_column, text_column).mapInArrow(tidy(run), f"`{id_column}` {id_type}, media binary")


def digest(text: str | None) -> tuple:
    """What op1 returns of one text, but for its id; read back from the stored form."""
    raw = (text or "").encode()
    media = mux(padded(raw))
    m = parse(media)
    back = payload_of(media, m)
    samples = np.frombuffer(back, np.uint8)
    indexed = {at for _, _, at in m.cues}
    laces = {k: 0 for k in LACING}
    for p in m.packets:
        if p[3] == 0:
            laces[p[4]] += 1
    feature = f"{m.status};tracks={len(m.tracks)};clusters={len(m.clusters)};cued={sum(c in indexed for c in m.clusters)};packets={len(m.packets)};" + ";".join(f"{k}={n}" for k, n in laces.items()) + f";last_ns={m.packets[-1][6]};first_byte={m.packets[0][7]};sum={int(samples.sum(dtype=np.int64))};turns={int(np.count_nonzero(np.diff(samples)))}"
    return (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)


def media_digests(df: DataFrame) -> DataFrame:
    """One row per document: store, read back, compute (see ``digest``)."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            rows = [digest(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    return df.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
