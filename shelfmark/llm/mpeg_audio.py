"""MPEG audio in binary columns.

``inspect`` walks the frames of each stream: it reads ID3 tags at both ends (versions 2.2 to 2.4, with
extended headers and unsynchronisation), resynchronises after foreign bytes (a header counts if another
one, or the end, follows at the frame's length), reads Xing, Info and VBRI tables with their seek points,
verifies the checksums of frames of all three layers that have one, and gives the exact duration as a
fraction of seconds and the byte offset of every frame. The length of frames of free format is the distance
to the next header like theirs. ``store`` packs bytes losslessly into the main data of Layer III frames, and
``unpacked`` gets them back.

Defined results: null media gives nulls; empty media and media without frames have 0 frames and duration
0/1; a frame cut off by the end is not counted; a table or tag that its frame or the stream cuts short, or
that states no number where one belongs, is passed over, so damaged media never stops a job; of tags of one
name the last one stays, those at the front over those at the end; media of any length is read whole, one
value at a time; repeated rows give repeated rows; an empty table gives an empty table; further columns are
kept, unless they have the name of a result: then the result replaces them.
"""

from __future__ import annotations

import re
import struct
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import named, unused
from .arrow_text import cached, mapped

# kbit/s by bitrate index from 1, for (MPEG 1?, layer); Hz by version bits and index.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}


# Bits of the allocation of Layer II subbands, as (bits, subbands) in order.
ALLOCATION = {
    "most": ((4, 11), (3, 12), (2, 4)),
    "more": ((4, 11), (3, 12), (2, 7)),
    "few": ((4, 2), (3, 6)),
    "some": ((4, 2), (3, 10)),
    "half": ((4, 4), (3, 7), (2, 19)),
}


class Header:
    """What the four bytes of a frame header say; valid is False if they are none. Frames of free format have length 0."""

    __slots__ = ("channels", "checked", "free", "kbits", "layer", "length", "pad", "rate", "samples", "side", "stereo_to", "valid", "version")

    def __init__(self, raw: bytes):
        self.valid = False
        if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
            return
        version, layer, index, rate = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3), raw[2] >> 4, raw[2] >> 2 & 3
        if version == 1 or layer == 4 or index == 15 or rate == 3:
            return
        one = version == 3
        self.free = index == 0
        self.kbits = 0 if self.free else BITRATES[one, layer][index - 1]
        self.version, self.layer, self.rate = VERSIONS[version], layer, RATES[version][rate]
        self.pad = (raw[2] >> 1 & 1) * (4 if layer == 1 else 1)
        self.samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
        bits = self.kbits * 1000
        self.length = (12 * bits // self.rate * 4 if layer == 1 else self.samples // 8 * bits // self.rate) + self.pad
        mode = raw[3] >> 6
        self.channels = 1 if mode == 3 else 2
        self.stereo_to = 4 * (raw[3] >> 4 & 3) + 4 if mode == 1 else 32  # from this subband on both channels share bits
        self.checked = not raw[1] & 1
        self.side = 0 if layer != 3 else (17 if self.channels == 1 else 32) if one else (9 if self.channels == 1 else 17)
        self.valid = self.free or self.length > 4 + 2 * self.checked + self.side


def header(raw: bytes) -> Header:
    known = cached("mpeg headers", dict)
    if raw not in known:
        if len(known) > 50_000:
            known.clear()
        known[raw] = Header(raw)
    return known[raw]


def crc16(data: bytes) -> int:
    """The CRC of MPEG audio: polynomial 0x8005, all ones at first."""

    def build():
        table = []
        for i in range(256):
            c = i << 8
            for _ in range(8):
                c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
            table.append(c)
        return table

    table, c = cached("mpeg crc", build), 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ table[c >> 8 ^ b]
    return c


def frame_crc(raw: bytes) -> int:
    """The CRC of header bytes 3 and 4 with the side information."""
    known = cached("mpeg crcs", dict)
    if raw not in known:
        if len(known) > 50_000:
            known.clear()
        known[raw] = crc16(raw)
    return known[raw]


def bits_crc(head: bytes, bits: str) -> int:
    """The CRC of header bytes 3 and 4 with some bits, which may end inside a byte."""
    whole = len(bits) // 8 * 8
    c = crc16(head + bytes(int(bits[i : i + 8], 2) for i in range(0, whole, 8)))
    for b in bits[whole:]:
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ (b == "1") else 0)
    return c


def subband_bits(h: Header) -> list[int]:
    """Bits of the allocation of each subband of a Layer I or II frame."""
    if h.layer == 1:
        return [4] * 32
    each = h.kbits // h.channels
    if h.version != "1":
        kind = "half"
    elif each and each <= 48:
        kind = "some" if h.rate == 32000 else "few"
    else:
        kind = "most" if h.rate == 48000 or 56 <= each <= 80 else "more"
    return [bits for bits, n in ALLOCATION[kind] for _ in range(n)]


def allocation_crc(head: bytes, body: bytes, h: Header) -> int | None:
    """The CRC of a Layer I or II frame: of its allocation and, in Layer II, which scale factors it sends; null if cut short."""
    sizes = subband_bits(h)
    stereo = min(h.stereo_to, len(sizes)) if h.channels == 2 else len(sizes)
    bits = "".join(f"{b:08b}" for b in body[:64])
    at = used = 0
    for band, size in enumerate(sizes):
        for _ in range(h.channels if band < stereo else 1):
            used += (h.channels if band >= stereo else 1) * (int(bits[at : at + size] or "0", 2) > 0)
            at += size
    at += 2 * used if h.layer == 2 else 0
    return bits_crc(head, bits[:at]) if at <= len(bits) else None


def syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def plain_size(raw: bytes) -> int:
    """Four bytes of seven bits each."""
    return sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0), strict=False))


def id3v2(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """The end of the tag at an offset and its text frames."""
    major, flags, size = data[at + 3], data[at + 5], plain_size(data[at + 6 : at + 10])
    end = at + 10 + size + (10 if flags & 0x10 and major == 4 else 0)
    body, i, tags = data[at + 10 : at + 10 + size], 0, {}
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    if flags & 0x40 and major > 2:
        i = plain_size(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    name_size, head = (3, 6) if major == 2 else (4, 10)
    while major in (2, 3, 4) and i + head <= len(body) and body[i : i + name_size].strip(b"\0"):
        n = plain_size(body[i + 4 : i + 8]) if major == 4 else int.from_bytes(body[i + name_size : i + 2 * name_size], "big")
        name, value = body[i : i + name_size].decode("latin-1"), body[i + head : i + head + n]
        if major == 4:
            value = value[4:] if body[i + 9] & 1 else value  # the size before packing
            value = value.replace(b"\xff\0", b"\xff") if (body[i + 9] & 2 or flags & 0x80) else value
        if name[:1] == "T" and value:
            text = value[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[value[0] & 3], "replace").rstrip("\0")
            key, _, said = text.partition("\0") if name in ("TXXX", "TXX") else (name, "", text)
            tags[key] = said
        i += head + n
    return end, tags


def vbr_table(frame: bytes, h: Header) -> tuple[int, int, list[int]] | None:
    """Frames, bytes and seek points (byte offsets) that a Xing, Info or VBRI table states, if the frame holds a whole one."""
    xing = 4 + h.side
    if frame[xing : xing + 4] in (b"Xing", b"Info"):
        flags, i, out = int.from_bytes(frame[xing + 4 : xing + 8], "big"), xing + 8, []
        for bit in (1, 2):
            out.append(int.from_bytes(frame[i : i + 4], "big") if flags & bit else 0)
            i += 4 if flags & bit else 0
        points = [p * out[1] // 256 for p in frame[i : i + 100]] if flags & 4 else []
        return (out[0], out[1], points) if i + 100 * bool(flags & 4) <= len(frame) else None
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width = struct.unpack(">IIHHH", frame[46:60])
        if 1 <= width <= 4 and 62 + entries * width <= len(frame):
            points = [0]
            for k in range(entries):
                points.append(points[-1] + scale * int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big"))
            return frames, size, points[:-1]
    return None


def free_length(data: bytes, at: int, end: int, h: Header) -> int:
    """The length of a frame of free format without padding: the distance to the next header like its own; 0 if there is none."""
    new = at
    while (new := data.find(data[at : at + 2], new + 4, end)) >= 0:
        other = header(data[new : new + 4])
        if other.valid and other.free and other.rate == h.rate and other.channels == h.channels and new - at > 4 + 2 * h.checked + h.side:
            return new - at - h.pad
    return 0


def walk(data: bytes) -> dict:
    """All that inspect tells of one stream, and the main data of its frames."""
    tags: dict[str, str] = {}
    at, end = 0, len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, z in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if text := data[end + a : end + z].split(b"\0")[0].decode("latin-1").strip():
                tags[name] = text
    out = {"tags": tags, "offsets": [], "n_frames": 0, "samples": 0, "skipped": 0, "crc_checked": 0, "crc_errors": 0, "main": []}
    out |= dict.fromkeys(("vbr_frames", "vbr_bytes", "vbr_seek", "version", "layer", "sample_rate", "channels"))
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        at, more = id3v2(data, at)
        tags |= more
    seconds, by_rate, sure, free = Fraction(0), {}, False, 0
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h.valid and h.free and not free:
            free = free_length(data, at, end, h)
        length = (free and free + h.pad) if h.valid and h.free else h.length if h.valid else 0
        stop = at + length
        if not length or stop > end or not (sure or stop + 4 > end or header(data[stop : stop + 4]).valid):
            sure, free = False, 0
            new = data.find(b"\xff", at + 1, end)
            new = end if new < 0 else new
            out["skipped"] += new - at
            at = new
            continue
        sure = True
        if out["version"] is None:
            out |= {"version": h.version, "layer": h.layer, "sample_rate": h.rate, "channels": h.channels}
            table = vbr_table(data[at:stop], h) if h.layer == 3 else None
            if table:
                out["vbr_frames"], out["vbr_bytes"], out["vbr_seek"] = table
                at = stop
                continue
        body = at + 4 + 2 * h.checked
        if h.checked:
            head, said = data[at + 2 : at + 4], int.from_bytes(data[at + 4 : at + 6], "big")
            got = frame_crc(head + data[body : body + h.side]) if h.layer == 3 else allocation_crc(head, data[body:stop], h)
            out["crc_checked"] += got is not None
            out["crc_errors"] += got is not None and got != said
        out["offsets"].append(at)
        out["main"].append(data[body + h.side : stop])
        by_rate[h.rate] = by_rate.get(h.rate, 0) + h.samples
        at = stop
    out["skipped"] += max(0, end - at)
    for rate, n in by_rate.items():
        seconds += Fraction(n, rate)
    out["n_frames"], out["samples"] = len(out["offsets"]), sum(by_rate.values())
    out["duration_num"], out["duration_den"] = seconds.numerator, seconds.denominator
    return out


FIELDS = [
    ("version", "string"), ("layer", "int"), ("sample_rate", "int"), ("channels", "int"), ("n_frames", "long"), ("samples", "long"), ("duration_num", "long"), ("duration_den", "long"),
    ("skipped", "long"), ("crc_checked", "long"), ("crc_errors", "long"), ("vbr_frames", "long"), ("vbr_bytes", "long"), ("vbr_seek", "array<long>"), ("offsets", "array<long>"), ("tags", "map<string,string>"),
]

#: Layer III, mono, 32 kHz: each frame has a checksum.
SIDE, RATE_INDEX, MOST_INDEX = 17, 2, 14


def frame_room(index: int) -> int:
    return 144 * BITRATES[True, 3][index - 1] * 1000 // 32000 - 6 - SIDE


def packed(payload: bytes) -> bytes:
    """A stream whose frames hold the payload as main data: a tag with its length, a Xing table, then frames of the
    highest bitrate and a last one of the lowest that suffices."""

    def build():
        heads = {i: bytes((0xFF, 0xFA, i << 4 | RATE_INDEX << 2, 0xC0)) for i in range(1, 15)}
        return {i: h + crc16(h[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE) for i, h in heads.items()}

    heads = cached("mpeg heads", build)
    room = frame_room(MOST_INDEX)
    full, rest = divmod(len(payload), room)
    out = [heads[MOST_INDEX] + payload[i * room : (i + 1) * room] for i in range(full)]
    if rest:
        last = next(i for i in range(1, 15) if frame_room(i) >= rest)
        out.append(heads[last] + payload[full * room :] + bytes(frame_room(last) - rest))
    text = b"\0payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    size = sum(map(len, out))
    toc = bytes(min(255, i * 256 // 100) for i in range(100))
    xing = bytes((0xFF, 0xFB, 9 << 4 | RATE_INDEX << 2, 0xC0)) + bytes(SIDE) + b"Xing" + struct.pack(">III", 7, len(out), size + 576) + toc
    return b"".join([b"ID3\x03\0\0", syncsafe(len(tag)), tag, xing.ljust(576, b"\0"), *out])


def _mapped(df: DataFrame, column: str, new: list[tuple[str, str]], row) -> DataFrame:
    """df with new columns made from one binary column by row(bytes or None)."""
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n, _ in new}]
    schema = T.StructType([*(df.schema[c] for c in kept), *T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in new)).fields])
    source = df.select(*map(named, kept), named(column).alias(*unused(kept, "media_in")))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        own = to_arrow_schema(schema)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                got = [row(x.as_py()) for x in part.column(len(kept))]
                more = [pa.array([None if g is None else g[n] for g in got], own.field(n).type) for n, _ in new]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *more], names=own.names)

    return mapped(source, run, schema)


def inspect(df: DataFrame, media: str = "media") -> DataFrame:
    """df with the columns of FIELDS."""

    def row(data):
        if data is None:
            return None
        got = walk(data)
        return got | {"tags": list(got["tags"].items())}

    return _mapped(df, media, FIELDS, row)


def store(df: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """df with each payload packed into a stream."""
    return _mapped(df, payload, [(media, "binary")], lambda x: None if x is None else {media: packed(x)})


def unpacked(df: DataFrame, media: str = "media", payload: str = "payload") -> DataFrame:
    """df with what inspect tells and the payload that store packed, null if the stream is damaged."""

    def row(data):
        if data is None:
            return None
        got = walk(data)
        said = got["tags"].get("payload_bytes", "")
        size = int(said) if re.fullmatch("[0-9]{1,18}", said) else -1
        main = b"".join(got["main"])
        whole = 0 <= size <= len(main) and not got["crc_errors"] and not got["skipped"] and got["vbr_frames"] == got["n_frames"]
        return got | {"tags": list(got["tags"].items()), payload: main[:size] if whole else None}

    return _mapped(df, media, [*FIELDS, (payload, "binary")], row)
