"""Media columns: payloads in MPEG audio streams, and a reader for such streams.

The writer stores a payload in the frame bodies of an MPEG-1 layer III stream (44.1 kHz,
mono, checksum on, side information of zeros): an ID3v2 tag with the payload's length and
CRC-32, a frame with a Xing table (frames, bytes, 100 seek points), then frames of the
largest size that the rest fills, the last of the smallest that holds it. The format's unit
is the body byte; the bytes are stored as they are.

The reader takes any bytes: it skips ID3v2, ID3v1 and APE tags, finds frames of layers I to III
by their headers, resyncs at the next header that is followed by another, a tag or the end,
parses a Xing, Info or VBRI table, verifies checksums (of layers I and III; layer II's covers a
number of bits that only its decoder knows, so these frames count as unchecked), and gives
exact duration (samples over rate), frame offsets and what it skipped.

Defined results: a NULL payload is empty; an empty one is 64 zero bytes; equal payloads give
equal streams; damaged streams give what frames are left, with counts of skipped bytes and
failed checksums. Each row is coded by itself, in Arrow batches; memory is a few times the
largest batch.
"""

from __future__ import annotations

import binascii
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

# Fixed values of the MPEG audio format: kbit/s by layer of MPEG-1 and MPEG-2, and rates by version.
KBITS_1 = {
    1: [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    2: [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    3: [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
}
KBITS_2 = {
    1: [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    2: [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    3: [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
HEAD = 4 + 2 + 17  # header, checksum, side information of a mono MPEG-1 frame
UNIT, ROWS = 64, 256
NAMES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "duration", "frame_offsets"]
_SYNC = re.compile(rb"\xff[\xe0-\xff]|ID3|APETAGEX|TAG")


def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """Polynomial 0x8005, start 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


@lru_cache(maxsize=1024)
def parse_header(raw: bytes) -> tuple[int, int, int, int, bool, int] | None:
    """(frame size, rate, samples, bytes after the checksum that it covers, has checksum, layer) of a header; None if it isn't one."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer, protected = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3), not raw[1] & 1
    index, rate = raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3 or raw[3] & 3 == 2:
        return None
    mode, pad, hz = raw[3] >> 6, raw[2] >> 1 & 1, RATES[version][rate]
    kbits = (KBITS_1 if version == 3 else KBITS_2)[layer][index]
    if layer == 1:
        bound = 4 * (raw[3] >> 4 & 3) + 4 if mode == 1 else 32  # joint stereo shares the bits of upper bands
        return (12 * kbits * 1000 // hz + pad) * 4, hz, 384, (32 + (bound if mode != 3 else 0)) // 2, protected, layer
    samples = 1152 if version == 3 or layer == 2 else 576
    side = ((17 if mode == 3 else 32) if version == 3 else (9 if mode == 3 else 17)) if layer == 3 else 0
    return samples // 8 * kbits * 1000 // hz + pad, hz, samples, side, protected, layer


@lru_cache(maxsize=64)
def _frame_head(index: int, pad: int) -> tuple[bytes, int]:
    """Header, checksum and side information of a written frame, and its body's size."""
    raw = bytes((0xFF, 0xFA, index << 4 | pad << 1, 0xC0))
    side = bytes(17)
    return raw + struct.pack(">H", crc16(raw[2:] + side)) + side, parse_header(raw)[0] - HEAD


@lru_cache(maxsize=1)
def _sizes() -> list[tuple[int, int, int]]:
    return sorted((_frame_head(i, p)[1], i, p) for i in range(1, 15) for p in (0, 1))


def _synchsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def encode(payload: bytes) -> bytes:
    """The payload as a stream."""
    sizes = _sizes()
    most = sizes[-1]
    frames, at = [], 0
    while at < len(payload):
        rest = len(payload) - at
        body, index, pad = most if rest >= most[0] else next(s for s in sizes if s[0] >= rest)
        part = payload[at : at + body]
        frames.append(_frame_head(index, pad)[0] + part + bytes(body - len(part)))
        at += len(part)
    offsets, total = [], 0
    for f in frames:
        offsets.append(total)
        total += len(f)
    head, body = _frame_head(9, 0)
    first = len(head) + body
    toc = bytes(min(255, (first + (offsets[i * len(offsets) // 100] if offsets else 0)) * 256 // (first + total)) for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), first + total) + toc
    note = b"\x00payload\x00" + f"{len(payload)}:{zlib.crc32(payload)}".encode()
    tag = b"TXXX" + struct.pack(">I", len(note)) + b"\x00\x00" + note
    return b"ID3\x03\x00\x00" + _synchsafe(len(tag)) + tag + head + xing + bytes(body - len(xing)) + b"".join(frames)


def _tag(data: bytes, at: int) -> int:
    """The end of the tag that starts here; 0 if none does."""
    n = len(data)
    if data[at : at + 3] == b"ID3" and at + 10 <= n and max(data[at + 6 : at + 10]) < 128:
        a, b, c, d = data[at + 6 : at + 10]
        return min(n, at + 10 + (a << 21 | b << 14 | c << 7 | d) + (10 if data[at + 5] & 16 else 0))
    if data[at : at + 8] == b"APETAGEX" and at + 32 <= n:
        size, flags = struct.unpack_from("<I", data, at + 12)[0], struct.unpack_from("<I", data, at + 20)[0]
        return min(n, at + 32 + (size if flags >> 29 & 1 else 0))
    return n if data[at : at + 3] == b"TAG" and at + 128 == n else 0


def _vbri(data: bytes, at: int, end: int) -> dict | None:
    """Frames, bytes and seek table of a VBRI header."""
    if at + 26 > end:
        return None
    size, frames = struct.unpack_from(">II", data, at + 10)
    entries, scale, width, step = struct.unpack_from(">HHHH", data, at + 18)
    if width not in (1, 2, 3, 4) or at + 26 + entries * width > end:
        return {"frames": frames, "bytes": size}
    toc = [int.from_bytes(data[at + 26 + i * width : at + 26 + (i + 1) * width], "big") * scale for i in range(entries)]
    return {"frames": frames, "bytes": size, "toc": toc, "step": step}


def _xing(data: bytes, at: int, end: int) -> dict:
    flags = struct.unpack_from(">I", data, at + 4)[0] if at + 8 <= end else 0
    here, table = at + 8, {}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit and here + 4 <= end:
            table[name] = struct.unpack_from(">I", data, here)[0]
            here += 4
    if flags & 4:
        table["toc"] = list(data[here : min(here + 100, end)])
    return table


def decode(data: bytes) -> dict:
    """payload, frames, samples, rates, failed and unchecked checksums, skipped bytes, seek offsets, tags and table of a stream."""
    at, n, tags, note = 0, len(data), 0, None
    bodies, offsets, rates = [], [], {}
    samples = bad = unchecked = skipped = 0
    table = None
    synced = False
    while at < n:
        if (end := _tag(data, at)) and data[at : at + 1] in b"IAT":
            k = data.find(b"\x00payload\x00", at, end)
            note = data[k + 9 : end].split(b"\x00")[0].decode("ascii", "replace") if k >= 0 else note
            at, tags = end, tags + 1
            continue
        h = parse_header(data[at : at + 4])
        end = at + h[0] if h else 0
        if h and h[0] >= 4 and end <= n and (synced or end == n or parse_header(data[end : end + 4]) or _tag(data, end)):
            synced = True
            size, hz, count, side, protected, layer = h
            body = min(end, at + 4 + 2 * protected + (side if layer == 3 else 0))
            if protected and layer == 2:
                unchecked += 1
            elif protected and (end < at + 6 + side or struct.unpack_from(">H", data, at + 4)[0] != crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + side])):
                bad += 1
            if not offsets and table is None and layer == 3 and data[body : body + 4] in (b"Xing", b"Info"):
                table = _xing(data, body, end)
            elif not offsets and table is None and layer == 3 and data[at + 36 : at + 40] == b"VBRI":
                table = _vbri(data, at + 36, end)
            else:
                offsets.append(at)
                bodies.append(data[body:end])
                samples += count
                rates[hz] = rates.get(hz, 0) + count
            at = end
        else:
            synced = False
            k = _SYNC.search(data, at + 1)
            k = k.start() if k else n
            skipped += k - at
            at = k
    payload = b"".join(bodies)
    if note and note.split(":")[0].isdigit():
        payload = payload[: int(note.split(":")[0])]
    seconds = sum(c / hz for hz, c in rates.items())
    agrees = note is not None and note == f"{len(payload)}:{zlib.crc32(payload)}"
    return {"payload": payload, "frames": len(offsets), "samples": samples, "rates": rates, "seconds": seconds, "bad": bad, "unchecked": unchecked, "skipped": skipped, "offsets": offsets, "table": table, "tags": tags, "agrees": agrees}


def feature(x: dict) -> str:
    """A line that describes a decoded stream."""
    seek = binascii.hexlify(zlib.crc32(b"".join(struct.pack(">Q", o) for o in x["offsets"])).to_bytes(4, "big")).decode()
    t = x["table"] or {}
    table = f"{t.get('frames')}/{t.get('bytes')}" if x["table"] is not None else "none"
    rate = "+".join(f"{n}/{hz}" for hz, n in sorted(x["rates"].items())) or "0"
    return f"frames={x['frames']};duration={rate};badcrc={x['bad']};skipped={x['skipped']};vbr={table};seek={seek};intact={int(x['agrees'])}"


def store(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds the stream of each text as a binary column, and n_bytes (columns of these names are replaced, others carried)."""
    raw_name = fresh(docs, "_raw")
    names = [f.name for f in docs.schema.fields if f.name.lower() not in (media.lower(), "n_bytes")]
    raw = docs.select(*[F.col(f"`{n}`") for n in names], F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias(raw_name))
    schema = docs.select(*[F.col(f"`{n}`") for n in names]).schema.add("n_bytes", "long").add(media, "binary")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                data = b.column(raw_name).to_pylist()
                more = [pa.array([len(x) for x in data], pa.int64()), pa.array([encode(padded(x)) for x in data], pa.binary())]
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *more], names=[*names, "n_bytes", media])

    return raw.mapInArrow(coded, schema)


def describe(stored: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """key, n_bytes, and what the stored streams hold: payload and media digests, a feature line, samples, exact duration as a fraction of seconds (samples over rate, for each rate), and frame offsets."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                rows = []
                for m in b.column(media).to_pylist():
                    x = decode(m or b"")
                    p = x["payload"]
                    times = [{"samples": n, "rate": hz} for hz, n in sorted(x["rates"].items())]
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(m or b""), hashlib.sha256(m or b"").hexdigest(), feature(x), x["seconds"], times, x["offsets"]))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("samples", pa.int64()), ("rate", pa.int32())])), pa.list_(pa.int64())]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)]
                yield pa.RecordBatch.from_arrays([b.column(key), b.column("n_bytes"), *columns], names=[key, "n_bytes", *NAMES])

    kind = stored.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, duration array<struct<samples:bigint,rate:int>>, frame_offsets array<bigint>"
    return stored.select(F.col(f"`{key}`"), "n_bytes", F.col(f"`{media}`")).mapInArrow(read, schema)
