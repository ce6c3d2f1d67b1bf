"""The stream reader on streams that other writers make: layers, tags, tables, damage; and op8's columns recomputed."""

import hashlib
import random
import struct
import zlib

from tallystream.llm import audio_media as A
from tallystream.llm import queries


def frame(version, layer, index, rate, pad=0, mode=3, fill=0x55, crc=False):
    """A frame built from the format's own formulas."""
    hz = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}[version][rate]
    kbits = (A.KBITS_1 if version == 3 else A.KBITS_2)[layer][index] * 1000
    size = (12 * kbits // hz + pad) * 4 if layer == 1 else (144 if version == 3 or layer == 2 else 72) * kbits // hz + pad
    head = bytes((0xFF, 0xE0 | version << 3 | (4 - layer) << 1 | (not crc), index << 4 | rate << 2 | pad << 1, mode << 6))
    body = bytearray([fill]) * (size - 4)
    if crc:
        covered = {1: 16 if mode == 3 else 32, 3: {(3, True): 17, (3, False): 32}.get((version, mode == 3), 9 if mode == 3 else 17)}[layer]
        body[:2] = struct.pack(">H", A.crc16(head[2:] + bytes(body[2 : 2 + covered])))
    return head + bytes(body)


def test_layers_and_rates():
    for layer in (1, 2, 3):
        for version in (3, 2, 0):
            for index, rate, pad in ((1, 0, 0), (5, 1, 1), (14, 2, 0)):
                f = frame(version, layer, index, rate, pad)
                x = A.decode(f * 5)
                n = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
                hz = A.RATES[version][rate]
                assert (x["frames"], x["samples"], x["rates"], x["skipped"], x["offsets"]) == (5, 5 * n, {hz: 5 * n}, 0, [k * len(f) for k in range(5)])


def test_checksums():
    for layer, mode in ((1, 3), (1, 0), (3, 3), (3, 0)):
        f = frame(3, layer, 9, 0, mode=mode, crc=True)
        broken = bytearray(f)
        broken[9] ^= 4
        x = A.decode(f + bytes(broken) + f)
        assert (x["frames"], x["bad"], x["unchecked"]) == (3, 1, 0)
    assert A.decode(frame(3, 2, 9, 0) * 2)["unchecked"] == 0


def test_tags_and_tables():
    f = frame(3, 3, 9, 0)
    id3 = b"ID3\x04\x00\x10" + bytes((0, 0, 1, 2)) + b"\xff\xfb" * 65 + b"3DI\x04\x00\x10" + bytes((0, 0, 1, 2))
    ape = b"APETAGEX" + struct.pack("<IIII", 2000, 5 + 32, 1, 0xA0000000) + bytes(8) + b"\xff\xfb\x90\xc0\x00" + b"APETAGEX" + struct.pack("<IIII", 2000, 5 + 32, 1, 0x80000000) + bytes(8)
    old = b"TAG" + b"title\xff\xfb".ljust(125, b"\0")
    x = A.decode(id3 + f * 4 + ape + old)
    assert (x["frames"], x["tags"], x["skipped"]) == (4, 3, 0) and x["offsets"][0] == len(id3)
    xing = bytearray(f)
    xing[21 : 21 + 8 + 8] = b"Info" + struct.pack(">III", 3, 4, 999)
    assert A.decode(bytes(xing) + f * 4)["table"] == {"frames": 4, "bytes": 999}
    vbri = bytearray(f)
    vbri[36 : 36 + 26 + 4] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 5 * len(f), 4, 2, 1, 2, 2) + struct.pack(">HH", 834, 835)
    x = A.decode(bytes(vbri) + f * 4)
    assert x["table"] == {"frames": 4, "bytes": 5 * len(f), "toc": [834, 835], "step": 2} and x["frames"] == 4
    for cut in (b"", b"ID3", b"TAG", b"APETAGEX", bytes(vbri)[:40], b"\xff" * 9000, b"ID3" * 3000, b"TAG" * 3000):
        A.decode(cut)


def test_resync_after_damage():
    f = frame(3, 3, 9, 0)
    x = A.decode(f * 3 + b"junk\xff\xfbjunk" + f * 3 + f[:50])
    assert x["frames"] == 6 and x["skipped"] == 10 + 50 and x["offsets"][3] == 3 * len(f) + 10


def test_columns(spark):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate([None, "", "x" * 64, "é" * 31, *("".join(chr(rng.randrange(32, 900)) for _ in range(n)) for n in (1, 63, 500, 4000, 30000))])]
    stored = A.store(spark.createDataFrame(rows, "doc_id long, text string"))
    media = {r.doc_id: bytes(r.media) for r in stored.collect()}
    for r in A.describe(stored).collect():
        b = (rows[r.doc_id][1] or "").encode()
        padded = b + bytes(64 if not b else -len(b) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        m = media[r.doc_id]
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
        # frames are walked by the size formula alone; the first holds the table
        at, places = m.index(b"\xff\xfa"), []
        while at < len(m):
            places.append(at)
            at += 144 * A.KBITS_1[3][m[at + 2] >> 4] * 1000 // 44100 + (m[at + 2] >> 1 & 1)
        assert r.frame_offsets == places[1:] and [tuple(d) for d in r.duration] == [(1152 * (len(places) - 1), 44100)] and abs(r.seconds - 1152 * (len(places) - 1) / 44100) < 1e-9
        assert b"".join(m[a + 23 : b_] for a, b_ in zip(places[1:], [*places[2:], len(m)]))[: len(padded)] == padded
        seek = zlib.crc32(b"".join(struct.pack(">Q", o) for o in places[1:]))
        assert r.feature == f"frames={len(places) - 1};duration={1152 * (len(places) - 1)}/44100;badcrc=0;skipped=0;vbr={len(places) - 1}/{len(m) - places[0]};seek={seek:08x};intact=1"
    assert "op8_media_columns" in queries.queries()
