import hashlib
import zlib

import pytest

from shelfmark.llm import mpeg_audio as M
from shelfmark.llm.queries import op9_media_columns


@pytest.mark.parametrize("n", [0, 64, 1408, 1417, 1418, 1472, 9984, 100_032])
def test_round_trip_and_exact_duration(n):
    payload = bytes(i * 7 % 251 for i in range(n))
    got = M.walk(M.packed(payload))
    assert b"".join(got["main"])[:n] == payload and got["tags"] == {"payload_bytes": str(n)}
    assert got["crc_errors"] == got["skipped"] == 0 and got["crc_checked"] == got["n_frames"] == got["vbr_frames"] == -(-n // M.frame_room(14))
    assert got["duration_num"] * 32000 == got["samples"] * got["duration_den"] == got["n_frames"] * 1152 * got["duration_den"]


def test_crc_against_bit_by_bit_division():
    def slow(data):
        c = 0xFFFF
        for b in data:
            for k in range(7, -1, -1):
                top = (c >> 15) ^ (b >> k & 1)
                c = (c << 1 & 0xFFFF) ^ (0x8005 if top else 0)
        return c

    for data in (b"", b"\0", b"123456789", bytes(range(200))):
        assert M.crc16(data) == slow(data)


def test_resync_damage_and_other_layers():
    media = M.packed(bytes(5000))
    clean = M.walk(media)
    first = clean["offsets"][1]
    dirty = media[:first] + b"\xff\xfa\xff garbage \xff\xe2" + media[first:] + b"TAG" + b"Song".ljust(30, b"\0") + bytes(95)
    got = M.walk(dirty)
    assert got["n_frames"] == clean["n_frames"] and got["skipped"] == 14 and got["tags"]["title"] == "Song"
    broken = bytearray(media)
    broken[clean["offsets"][0] + 10] ^= 1
    assert M.walk(bytes(broken))["crc_errors"] == 1
    assert M.walk(media[:-5])["n_frames"] == clean["n_frames"] - 1
    for raw, layer, length, samples in ((b"\xff\xfd\x10\x00", 2, 104, 1152), (b"\xff\xff\x10\x00", 1, 32, 384), (b"\xff\xf3\x40\xc0", 3, 104, 576), (b"\xff\xe3\x40\xc0", 3, 208, 576)):
        h = M.Header(raw)
        assert (h.valid, h.layer, h.length, h.samples) == (True, layer, length, samples)
        assert M.walk((raw.ljust(length, b"\1")) * 3)["samples"] == 3 * samples
    assert not M.Header(b"\xff\xff\xff\xff").valid and M.walk(b"\xff" * 1000)["n_frames"] == 0


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, bytearray(b""), "x"), (3, bytearray(M.packed(b"a" * 64)), "x"), (3, bytearray(M.packed(b"a" * 64)), "x"), (None, bytearray(b"no audio"), None)]
    frame = spark.createDataFrame(rows, "id long, media binary, tags string")
    got = M.inspect(frame).collect()
    assert len(got) == 5 and [r.n_frames for r in got] == [None, 0, 1, 1, 0]
    assert got[2].tags == {"payload_bytes": "64"} and got[2].offsets == [len(rows[2][1]) - 144] and got[1].duration_den == 1
    assert M.inspect(frame.filter("false")).count() == 0
    assert [None if r.payload is None else bytes(r.payload) for r in M.unpacked(frame).collect()] == [None, None, b"a" * 64, b"a" * 64, None]


def test_query_against_plain_python(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in op9_media_columns(spark, folder).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(M.packed(payload)).hexdigest() and r.media_bytes == len(M.packed(payload))
        h = M.walk(M.packed(payload))
        seek = hashlib.sha256(",".join(map(str, h["offsets"])).encode()).hexdigest()
        assert r.feature == f"1;3;32000;1;{h['n_frames']};{h['duration_num']}/{h['duration_den']};{h['n_frames']};0;{seek}"


def frames3(n, table=b"", at=0):
    """Layer III frames of 144 bytes without checksums, the first with a table at an offset."""
    first = bytearray(b"\xff\xfb\x18\xc0".ljust(144, b"\0"))
    first[at : at + len(table)] = table
    return bytes(first[:144]) + b"\xff\xfb\x18\xc0".ljust(144, b"\0") * n


def test_damaged_tables_and_tags_stop_nothing(spark):
    one = b"\xff\xf3\x14\xc0"  # 24 bytes a frame and more
    length = M.Header(one).length
    rows = [b"".join([one.ljust(length, b"\0")])[:36].ljust(36, b"\0") + b"VBRI" + bytes(k) for k in range(20)]
    rows += [frames3(3, b"VBRI" + b"\xff" * 22, 36), frames3(3, b"Xing" + b"\xff" * 10, 4 + 17), b"ID3", b"ID3\x04\0\xff\x7f\x7f\x7f\x7f", b"ID3\x03\0\x40\0\0\0\x04\xff\xff\xff\xff"]
    text = b"\0payload_bytes\0abc"
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    rows.append(b"ID3\x03\0\0" + M.syncsafe(len(tag)) + tag + frames3(2))
    got = M.unpacked(spark.createDataFrame([(bytearray(r),) for r in rows], "media binary")).collect()
    assert len(got) == len(rows) and all(r.payload is None for r in got) and got[-1].tags == {"payload_bytes": "abc"} and got[-1].n_frames == 3


def test_seek_tables():
    toc = bytes(i * 2 for i in range(100))
    xing = M.walk(M.packed(bytes(50_000)))
    assert len(xing["vbr_seek"]) == 100 and xing["vbr_seek"] == sorted(xing["vbr_seek"]) and xing["vbr_seek"][99] < xing["vbr_bytes"]
    vbri = b"VBRI" + bytes(6) + (500).to_bytes(4, "big") + (3).to_bytes(4, "big") + (3).to_bytes(2, "big") + (2).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + b"".join(x.to_bytes(2, "big") for x in (72, 72, 50))
    got = M.walk(frames3(3, vbri, 36))
    assert (got["vbr_frames"], got["vbr_bytes"], got["vbr_seek"], got["n_frames"]) == (3, 500, [0, 144, 288], 3)
    assert M.vbr_table(b"\xff\xfb\x18\xc0" + bytes(17) + b"Info" + (4).to_bytes(4, "big") + toc, M.Header(b"\xff\xfb\x18\xc0"))[2] == [0] * 100


def test_tags_of_each_version():
    def tag(major, flags, body):
        return b"ID3" + bytes((major, 0, flags)) + M.syncsafe(len(body)) + body

    two = tag(2, 0, b"TT2" + (5).to_bytes(3, "big") + b"\0Song")
    extended = tag(3, 0x40, (6).to_bytes(4, "big") + bytes(6) + b"TIT2" + (5).to_bytes(4, "big") + b"\0\0" + b"\0Song")
    unsynced = tag(3, 0x80, b"TIT2" + (4).to_bytes(4, "big") + b"\0\0" + b"\0a\xff\0b")
    four = tag(4, 0x40, M.syncsafe(6) + b"\1\0" + b"TIT2" + M.syncsafe(5) + b"\0\2" + b"\0\xff\0bc")
    assert [M.id3v2(t, 0) for t in (two, extended, unsynced, four)] == [(len(two), {"TT2": "Song"}), (len(extended), {"TIT2": "Song"}), (len(unsynced), {"TIT2": "aÿb"}), (len(four), {"TIT2": "ÿbc"})]


@pytest.mark.parametrize(("second", "third", "mode"), [(0xFE, 0x44, 0xC0), (0xFE, 0x44, 0x50), (0xFC, 0x44, 0xC0), (0xFC, 0xA4, 0x00), (0xFC, 0xA4, 0x60), (0xFC, 0x88, 0x10), (0xF4, 0x44, 0xC0)])
def test_checksums_of_the_other_layers(second, third, mode):
    head = bytes((0xFF, second, third, mode))
    h = M.Header(head)
    body = bytes(i * 37 % 256 for i in range(h.length - 6))
    bits = "".join(f"{b:08b}" for b in body)
    at, used = 0, 0
    for band, size in enumerate(M.subband_bits(h)):
        both = h.channels == 2 and band < h.stereo_to
        for _ in range(2 if both else 1):
            used += (1 if both else h.channels) * (int(bits[at : at + size], 2) > 0)
            at += size
    c = 0xFFFF
    for b in f"{third:08b}{mode:08b}" + bits[: at + (2 * used if h.layer == 2 else 0)]:
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) != int(b) else 0)
    frame = head + c.to_bytes(2, "big") + body
    got = M.walk(frame * 3)
    assert (got["layer"], got["n_frames"], got["crc_checked"], got["crc_errors"]) == (h.layer, 3, 3, 0)
    assert M.walk(frame + head + bytes(2) + body + frame)["crc_errors"] == 1


def test_free_format():
    frame = b"\xff\xfb\x08\xc0".ljust(200, b"\1")
    padded = b"\xff\xfb\x0a\xc0".ljust(201, b"\1")
    got = M.walk(b"junk" + frame + padded + frame + frame)
    assert (got["n_frames"], got["skipped"], got["offsets"], got["samples"]) == (4, 4, [4, 204, 405, 605], 4 * 1152)
    assert M.walk(frame)["n_frames"] == 0
