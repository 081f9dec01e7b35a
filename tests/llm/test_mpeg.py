import hashlib
import random
import struct
import zlib

import pytest

from strandmill.llm.mpeg import checksum, crc16, describe, digests, header, id3v2, op9_mpeg, parse, stored, unwrap, vbr_table, wrap

SCHEMA = "doc_id long, text string, lang string, media string, seek int"


def frame(head, rng, side=17):
    """A frame with random content and a right CRC."""
    h = header(head)
    body = bytes(rng.randrange(256) for _ in range(h.size - 6)).replace(b"\xff", b"\xfe")
    return head + crc16(head[2:] + body[: h.side]).to_bytes(2, "big") + body


def test_headers():
    h = header(b"\xff\xfb\x90\x00")  # MPEG 1 Layer III, 128 kbit/s, 44.1 kHz, stereo, no CRC
    assert (h.version, h.layer, h.protected, h.kbps, h.rate, h.channels, h.size, h.samples) == (1, 3, False, 128, 44100, 2, 417, 1152)
    assert header(b"\xff\xfb\x92\x00").size == 418
    h = header(b"\xff\xf3\x40\xc0")  # MPEG 2 Layer III, 32 kbit/s, 22.05 kHz, mono
    assert (h.version, h.kbps, h.rate, h.size, h.samples, h.side) == (2, 32, 22050, 104, 576, 9)
    assert header(b"\xff\xff\x10\x00").layer == 1 and header(b"\xff\xfd\x10\x00").layer == 2 and header(b"\xff\xe3\x40\xc0").version == 2.5
    for bad in (b"\xff\xfb\xf0\x00", b"\xff\xfb\x00\x00", b"\xff\xfb\x9c\x00", b"\xff\xe8\x90\x00", b"\xff\xf9\x90\x00", b"\xfe\xfb\x90\x00", b"\xff\xfb\x90\x02", b"\xff"):
        assert header(bad) is None, bad


def test_crc_by_long_division():
    data = b"\x14\xc0" + bytes(17)
    c = 0xFFFF
    for byte in data:
        for bit in range(7, -1, -1):
            top = (c >> 15) ^ (byte >> bit & 1)
            c = (c << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    assert crc16(data) == c


def test_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 64, 73, 74, 936, 937, 938, 1874, 5000, 100_000):
        payload = rng.randbytes(n)
        media = wrap(payload, b"note")
        assert unwrap(media) == (payload, b"note")
        s = parse(media)
        assert s.vbr["kind"] == "Xing" and s.vbr["frames"] == len(s.offsets) == -(-n // 937)
        assert s.vbr["bytes"] == len(media) - id3v2(media)[0]
        assert s.resyncs == s.skipped == s.bad == 0 and s.good == len(s.offsets) + 1
        assert s.duration_us == len(s.offsets) * 24_000


def test_payload_that_looks_like_a_tag_before_the_end():
    for n in (64 * 15, 64 * 44, 937, 2 * 937, 3 * 937 + 75, 3 * 937 + 40):
        bare = len(wrap(bytes(n)))
        hits = 0
        for at in range(max(0, n - 1100), n - 2):
            payload = bytearray(b"x" * n)
            payload[at : at + 3] = b"TAG"
            media = wrap(bytes(payload), b"note")
            hits += media[bare + 4 - 128 :][:3] == b"TAG"
            assert unwrap(media) == (bytes(payload), b"note"), (n, at)
            s = parse(media)
            assert s.skipped == s.resyncs == s.bad == 0 and s.vbr["frames"] == len(s.offsets)
        assert hits == 1, n


def test_false_headers_inside_the_payload_do_no_harm():
    payload = (b"\xff\xfa\xe4\xc0" * 700 + b"ID3\x04TAG")[: 64 * 43]
    assert unwrap(wrap(payload))[0] == payload


def test_resynchronises_and_finds_damage():
    rng = random.Random(3)
    head = b"\xff\xfa\x94\xc0"
    frames = [frame(head, rng) for _ in range(10)]
    tag = b"ID3\x03\0\0\0\0\0\x0fTIT2" + struct.pack(">I", 5) + b"\0\0" + b"\0Name"
    tail = b"TAG" + b"Old title".ljust(30, b"\0") + bytes(95)
    good = tag + b"".join(frames) + tail
    s = parse(good)
    assert (len(s.offsets), s.good, s.bad, s.resyncs, s.skipped, s.vbr) == (10, 10, 0, 0, 0, None)
    assert s.tags["TIT2"] == b"\0Name" and s.tags["v1.title"] == b"Old title"
    assert s.offsets == [len(tag) + i * len(frames[0]) for i in range(10)]
    junk = b"\xff\xfbjunk" * 7
    s = parse(tag + b"".join(frames[:4]) + junk + b"".join(frames[4:]) + tail)
    assert (len(s.offsets), s.good, s.resyncs, s.skipped) == (10, 10, 1, len(junk))
    hurt = bytearray(good)
    hurt[len(tag) + 3 * len(frames[0]) + 8] ^= 1
    s = parse(bytes(hurt))
    assert (len(s.offsets), s.good, s.bad) == (10, 9, 1)
    media = bytearray(wrap(b"x" * 3000))
    media[-500] ^= 1
    with pytest.raises(ValueError):
        unwrap(bytes(media))


def test_vbri_table():
    h = header(b"\xff\xfb\x90\x00")
    raw = bytearray(h.size)
    raw[36:40] = b"VBRI"
    raw[46:54] = struct.pack(">II", 1000, 7)
    raw[54:62] = struct.pack(">HHHH", 2, 3, 2, 1)
    raw[62:66] = struct.pack(">HH", 5, 6)
    assert vbr_table(bytes(raw), h) == {"kind": "VBRI", "frames": 7, "bytes": 1000, "toc": [15, 18]}


def test_column_of_streams(spark):
    rng = random.Random(3)
    stream = b"".join(frame(b"\xff\xfa\x94\xc0", rng) for _ in range(40))
    rows = [(1, stream), (2, None), (3, b""), (4, b"no audio \xff\xfb at all"), (5, stream[:1000])]
    got = {r.id: r for r in describe(spark.createDataFrame(rows, "id long, media binary")).collect()}
    assert got[1]._frames == 40 and got[1]._duration_us == 40 * 24_000 and got[1]._seek == [i * len(stream) // 40 for i in range(40)]
    assert [got[i]._frames for i in (2, 3, 4)] == [0, 0, 0] and got[5]._frames == 1000 // len(stream[: len(stream) // 40])


def test_layer_two_checksums():
    rng = random.Random(6)
    heads = [b"\xff\xfc" + bytes((index << 4 | rate << 2, mode << 6 | ext << 4)) for index in range(1, 15) for rate in range(3) for mode, ext in ((0, 0), (1, 0), (1, 2), (3, 0))] + [b"\xff\xf4\x84\x00", b"\xff\xf4\x84\xc0"]
    for head in heads:
        h = header(head)
        if h is None or h.size < 110:
            continue
        body = bytearray(rng.randrange(256) for _ in range(h.size - 6))
        # By the definition, a bit at a time.
        bits = "".join(f"{b:08b}" for b in body)
        each, lsf = h.kbps // h.channels, h.version != 1
        widths = [4] * 4 + [3] * 7 + [2] * 19 if lsf else [4, 4] + [3] * (10 if h.rate == 32000 else 6) if each <= 48 else [4] * 11 + [3] * 12 + [2] * (7 if each >= 96 and h.rate != 48000 else 4)
        at, chosen = 0, 0
        for band, width in enumerate(widths):
            joint = head[3] >> 6 == 1 and band >= 4 * ((head[3] >> 4 & 3) + 1)
            for _ in range(1 if joint else h.channels):
                chosen += (h.channels if joint else 1) * (int(bits[at : at + width], 2) > 0)
                at += width
        c = 0xFFFF
        for bit in "".join(f"{b:08b}" for b in head[2:4]) + bits[: at + 2 * chosen]:
            c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ int(bit) else 0)
        made = head + c.to_bytes(2, "big") + bytes(body)
        assert checksum(made, h) == c
        s = parse(made * 3)
        assert (len(s.offsets), s.good, s.bad) == (3, 3, 0)
        hurt = bytearray(made * 3)
        hurt[len(made) + 6 + (at - 1) // 8] ^= 0x80 >> (at - 1) % 8
        assert parse(bytes(hurt)).bad == 1


def test_clashing_names_are_an_error(spark):
    with pytest.raises(ValueError):
        describe(spark.createDataFrame([(b"", 1)], "media binary, _frames int"))


@pytest.mark.parametrize("kind", ["int", "string"])
def test_texts_that_look_like_tags_and_frames_come_back(spark, kind):
    rows = []
    for sign in ("TAG", "ID3\x04\0\0\0\0\0\x10", "ÿúäÀ", "Xing", "VBRI", "TAG+"):
        rows += [f"{'x' * at}{sign * 24}" for at in range(0, 140, 1 if sign == "TAG" else 9)]
        rows += ["y" * (937 - 64 + at) + sign + "z" * 100 for at in range(-70, 70, 7)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    got = {int(r.doc_id): r for r in digests(stored(docs)).collect()}
    for d, t in enumerate(rows):
        data = t.encode()
        payload = data + bytes(-len(data) % 64)
        assert (got[d].n_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len(data), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_texts(spark):
    rows = [(1, "abc", "x", "y", 1), (1, "abc", "x", "y", 1), (2, None, None, None, None), (None, "", "x", "y", 1), (3, "é" * 100_000, "x", "y", 1), (4, "a" * 64, "x", "y", 1)]
    got = digests(stored(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for d, t, *_ in rows:
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        r = by[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = wrap(payload, struct.pack(">Q", len(data)))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert digests(stored(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query_on_the_small_tables(spark):
    import duckdb

    rows = dict(duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall())
    got = op9_mpeg(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    for r in got:
        data = rows[r.doc_id].encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_sha256) == (len(data), hashlib.sha256(payload).hexdigest())
