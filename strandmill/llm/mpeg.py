"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, exact durations and seek offsets.

``parse`` walks a stream of MPEG 1, 2 or 2.5 audio: it skips ID3v2 and ID3v1 tags, follows frame
headers, looks for the next two matching headers where one is damaged, reads Xing, Info and
VBRI tables, and verifies the CRC-16 of frames that carry one. Free-format frames aren't frames to it.
``wrap`` stores bytes losslessly in such a stream: silent Layer III frames whose
space behind the side information, which decoders ignore, holds the bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, materialize

# Fixed values of the MPEG audio standards (ISO/IEC 11172-3 and 13818-3), kbit/s by header index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
OWNER = b"strandmill.bytes\0"


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbps: int
    rate: int
    channels: int
    size: int
    samples: int
    side: int  # bytes that the CRC covers behind it


@lru_cache(maxsize=4096)
def header(raw: bytes) -> Header | None:
    """The frame header in 4 bytes, or None if they are none (free-format frames aren't supported)."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(raw[1] >> 3 & 3)
    layer = 4 - (raw[1] >> 1 & 3)
    index, rate, padding = raw[2] >> 4, raw[2] >> 2 & 3, raw[2] >> 1 & 1
    if version is None or layer == 4 or index in (0, 15) or rate == 3 or raw[3] & 3 == 2:
        return None
    kbps = BITRATES[1 if version == 1 else 2, layer][index]
    hertz = RATES[version][rate]
    channels = 1 if raw[3] >> 6 == 3 else 2
    if layer == 1:
        size, samples, side = (12000 * kbps // hertz + padding) * 4, 384, 16 * channels
        bound = 4 * ((raw[3] >> 4 & 3) + 1) if raw[3] >> 6 == 1 else 32
        side = (4 * (bound * channels + 32 - bound) + 7) // 8
    elif layer == 2:
        size, samples, side = 144000 * kbps // hertz + padding, 1152, 0
    else:
        samples = 1152 if version == 1 else 576
        size = samples * 125 * kbps // hertz + padding
        side = {(1, 1): 17, (1, 2): 32}.get((version, channels), 9 if channels == 1 else 17)
    return Header(version, layer, not raw[1] & 1, kbps, hertz, channels, size, samples, side)


def _table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _table()


@lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 0x8005, start 0xFFFF."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


def _rest(c: int, byte: int, bits: int) -> int:
    """``c`` taken on by the first ``bits`` bits of a byte."""
    for i in range(7, 7 - bits, -1):
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15 ^ byte >> i) & 1 else 0)
    return c


def _allocation(h: Header) -> list[int]:
    """Bits of a Layer II frame's bit allocation by subband, as the standards' tables give them."""
    each = h.kbps // h.channels
    if h.version != 1:
        return [4] * 4 + [3] * 7 + [2] * 19
    if each <= 48:
        return [4] * 2 + [3] * (10 if h.rate == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (7 if each >= 96 and h.rate != 48000 else 4)


def checksum(frame: bytes, h: Header) -> int:
    """The CRC-16 that a protected frame should carry: over half its header and its side information, in Layer II over allocation and
    scale factor selection.
    """
    if h.layer != 2:
        return crc16(frame[2:4] + frame[6 : 6 + h.side])
    bits, at, chosen = int.from_bytes(frame[6:], "big"), len(frame[6:]) * 8, 0
    total = at
    bound = 4 * ((frame[3] >> 4 & 3) + 1) if frame[3] >> 6 == 1 else 32
    for band, width in enumerate(_allocation(h)):
        for _ in range(h.channels if band < bound else 1):
            at -= width
            if bits >> at & (1 << width) - 1:
                chosen += 1 if band < bound else h.channels
    used = total - at + 2 * chosen
    whole = frame[6 : 6 + used // 8]
    return _rest(crc16(frame[2:4] + whole), frame[6 + used // 8], used % 8) if used % 8 else crc16(frame[2:4] + whole)


def _safe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def _unsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def id3v2(data: bytes, at: int = 0) -> tuple[int, dict[str, bytes]]:
    """(bytes of the tag, frames by name); 0 and nothing where there is none. Damaged frames end the list."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return 0, {}
    major, flags, size = data[at + 3], data[at + 5], _unsafe(data[at + 6 : at + 10])
    total = 10 + size + (10 if flags & 0x10 else 0)
    found: dict[str, bytes] = {}
    p, end = at + 10, min(len(data), at + 10 + size)
    if flags & 0x40 and p + 4 <= end:  # extended header
        p += _unsafe(data[p : p + 4]) if major == 4 else int.from_bytes(data[p : p + 4], "big") + 4
    while major >= 3 and p + 10 <= end and data[p : p + 4].isalnum():
        n = _unsafe(data[p + 4 : p + 8]) if major == 4 else int.from_bytes(data[p + 4 : p + 8], "big")
        if p + 10 + n > end:
            break
        found.setdefault(data[p : p + 4].decode("latin-1"), data[p + 10 : p + 10 + n])
        p += 10 + n
    return total, found


@dataclass
class Stream:
    tags: dict[str, bytes] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    first: Header | None = None
    samples: int = 0
    kbps: int = 0  # sum over frames
    good: int = 0  # checksums
    bad: int = 0
    resyncs: int = 0
    skipped: int = 0
    vbr: dict | None = None

    @property
    def duration_us(self) -> int:
        return self.samples * 1_000_000 // self.first.rate if self.first else 0


def vbr_table(frame: bytes, h: Header) -> dict | None:
    """What a Xing, Info or VBRI table in a stream's first frame says: kind, frames, bytes and seek points."""
    at = 4 + 2 * h.protected + h.side
    kind = frame[at : at + 4]
    if kind in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags = int.from_bytes(frame[at + 4 : at + 8], "big")
        p, out = at + 8, {"kind": kind.decode(), "frames": None, "bytes": None, "toc": []}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(frame[p : p + 4], "big")
                p += 4
        if flags & 4:
            out["toc"] = list(frame[p : p + 100])
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames = struct.unpack(">II", frame[46:54])
        entries, scale, width, _ = struct.unpack(">HHHH", frame[54:62])
        toc = [scale * int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") for i in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc}
    return None


def _like(a: Header, b: Header | None) -> bool:
    return b is not None and (a.version, a.layer, a.rate) == (b.version, b.layer, b.rate)


def parse(data: bytes | None) -> Stream:
    """Frames of a stream. Null, empty and frameless input gives a stream of no frames."""
    data = data or b""
    out = Stream()
    at, end = 0, len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        raw = data[end + 3 : end + 128]
        out.tags |= {"v1.title": raw[:30].rstrip(b"\0 "), "v1.artist": raw[30:60].rstrip(b"\0 ")}
    while (n := id3v2(data, at))[0]:
        out.tags = n[1] | out.tags
        at += n[0]
    lost = False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        fits = h is not None and at + h.size <= end
        if fits and (lost or not out.offsets):  # a chance match isn't followed by another
            after = at + h.size
            fits = after >= end or _like(h, header(data[after : after + 4]))
        elif fits:
            fits = _like(out.first, h)
        if not fits:
            if not lost and out.offsets:
                out.resyncs += 1
            lost = True
            step = data.find(b"\xff", at + 1, end)
            out.skipped += (step if step >= 0 else end) - at
            at = step if step >= 0 else end
            continue
        lost = False
        if h.protected:
            ok = checksum(data[at : at + h.size], h) == int.from_bytes(data[at + 4 : at + 6], "big")
            out.good += ok
            out.bad += not ok
        if out.first is None:
            out.first = h
            out.vbr = vbr_table(data[at : at + h.size], h)
            if out.vbr:  # the table's frame is no sound
                at += h.size
                continue
        out.offsets.append(at)
        out.sizes.append(h.size)
        out.samples += h.samples
        out.kbps += h.kbps
        at += h.size
    out.skipped += max(0, end - at)
    return out


_INDEX = {kbps: i for i, kbps in enumerate(BITRATES[1, 3])}
_OVERHEAD = 4 + 2 + 17
_ROOM = [(3 * kbps - _OVERHEAD, kbps) for kbps in BITRATES[1, 3][1:]]  # at 48 kHz a frame has 3 bytes for each kbit/s


@lru_cache(maxsize=32)
def _start(kbps: int) -> bytes:
    """Header, CRC and zeroed side information of a silent mono frame at 48 kHz."""
    head = bytes((0xFF, 0xFA, _INDEX[kbps] << 4 | 1 << 2, 0xC0))
    return head + crc16(head[2:] + bytes(17)).to_bytes(2, "big") + bytes(17)


def wrap(payload: bytes, note: bytes = b"") -> bytes:
    """A stream that holds ``payload``: an ID3v2 tag with its length and CRC-32 and ``note``, a Xing frame, then frames.

    Where the frames would end like an ID3v1 tag, an empty tag of that kind follows them.
    """
    private = OWNER + struct.pack(">QI", len(payload), zlib.crc32(payload)) + note
    tag = b"PRIV" + _safe(len(private)) + b"\0\0" + private
    big, kbps = _ROOM[-1]
    frames = [_start(kbps) + payload[i : i + big] for i in range(0, len(payload) - big + 1, big)]
    rest = payload[len(frames) * big :]
    if rest:
        room, kbps = next(r for r in _ROOM if r[0] >= len(rest))
        frames.append(_start(kbps) + rest + bytes(room - len(rest)))
    body = b"".join(frames)
    first = 3 * 64
    total = first + len(body)
    sizes = 3 * _ROOM[-1][1]
    toc = bytes(min(255, 256 * (first + min(len(body), sizes * (len(frames) * i // 100))) // total) for i in range(100))
    table = _start(64) + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    closing = b"TAG" + bytes(125) if body[-128:-125] == b"TAG" else b""
    return b"ID3\x04\0\0" + _safe(len(tag)) + tag + table + bytes(first - len(table)) + body + closing


def unwrap(media: bytes, stream: Stream | None = None) -> tuple[bytes, bytes]:
    """(payload, note) of a stream that ``wrap`` made; an error if it is damaged."""
    stream = stream or parse(media)
    private = stream.tags.get("PRIV", b"")
    if not private.startswith(OWNER):
        raise ValueError("no payload in this stream")
    size, crc = struct.unpack(">QI", private[len(OWNER) : len(OWNER) + 12])
    payload = b"".join([media[a + _OVERHEAD : a + n] for a, n in zip(stream.offsets, stream.sizes)])[:size]
    if len(payload) != size or zlib.crc32(payload) != crc or stream.bad:
        raise ValueError("the stream is damaged")
    return payload, private[len(OWNER) + 12 :]


def feature(s: Stream) -> str:
    if s.first is None:
        return "none"
    n = len(s.offsets)
    table = "none" if s.vbr is None else f"{s.vbr['kind']}:{s.vbr['frames']}:{'ok' if s.vbr['frames'] in (None, n) else 'differs'}"
    return f"mpeg{s.first.version:g}-{s.first.layer};hz={s.first.rate};ch={s.first.channels};frames={n};samples={s.samples};us={s.duration_us};kbps={s.kbps // n if n else 0};crc={s.good}/{s.good + s.bad};resync={s.resyncs};vbr={table}"


def describe(media: DataFrame, column: str = "media", every: int = 1) -> DataFrame:
    """Every column but ``column``, and what its streams hold: frames, samples, rate, duration_us, checksums, resyncs, skipped bytes, table, seek.

    ``_seek`` has the byte offset of every ``every``-th frame. Null and damaged streams get
    what frames can be found, possibly none. A column of ``media`` with the name of one of these is an error.
    """
    kept = [f for f in media.schema.fields if f.name != column]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    more = "_frames long, _samples long, _rate int, _duration_us long, _crc_good long, _crc_bad long, _resyncs long, _skipped long, _table string, _seek array<long>"

    if clash := {f.name for f in kept} & {c.split()[0] for c in more.split(", ")}:
        raise ValueError(f"columns of these names are there already: {sorted(clash)}")

    def run(batches):
        for batch in arrow_batches(batches, 64, column):
            found = [parse(x) for x in batch.column(column).to_pylist()]
            columns = [
                pa.array([len(s.offsets) for s in found], pa.int64()),
                pa.array([s.samples for s in found], pa.int64()),
                pa.array([s.first.rate if s.first else None for s in found], pa.int32()),
                pa.array([s.duration_us for s in found], pa.int64()),
                pa.array([s.good for s in found], pa.int64()),
                pa.array([s.bad for s in found], pa.int64()),
                pa.array([s.resyncs for s in found], pa.int64()),
                pa.array([s.skipped for s in found], pa.int64()),
                pa.array([s.vbr and s.vbr["kind"] for s in found], pa.string()),
                pa.array([s.offsets[::every] for s in found], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], names=[*(f.name for f in kept), *(c.split()[0] for c in more.split(", "))])

    return media.mapInArrow(run, f"{schema}, {more}" if schema else more)


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, media): every whole text's UTF-8 bytes, padded to a positive multiple of 64, in MPEG audio. Null is empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in arrow_batches(batches, 256, "text"):
            out = []
            for text in batch.column("text").to_pylist():
                data = (text or "").encode()
                out.append(wrap(data + bytes(-len(data) % 64 if data else 64), struct.pack(">Q", len(data))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "media"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, media binary")


def digests(media: DataFrame) -> DataFrame:
    """Digests and features of stored rows; the payload comes from the frames of the stored bytes."""
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seek"]

    def run(batches):
        for batch in arrow_batches(batches, 64, "media"):
            rows = []
            for raw in batch.column("media").to_pylist():
                s = parse(raw)
                payload, note = unwrap(raw, s)
                rows.append((struct.unpack(">Q", note)[0], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(s), s.offsets))
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seek array<long>")


def op9_mpeg(spark, sf_dir: str) -> DataFrame:
    return digests(materialize(stored(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media"))
