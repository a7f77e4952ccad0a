import gzip
import hashlib

import pytest

from shelfmark.llm import warc as W
from shelfmark.llm.queries import op10_warc

SCHEMA = "page_id long, url string, html string, digest string, first long"


def test_round_trip_with_segments_and_revisits(spark, tmp_path):
    same = "é" * 60
    long = "<p>" + "xyz\r\n" * 40_000
    rows = [(1, "http://a/\r\nX: y", same), (2, None, same), (3, "u", same), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", long), (9, "u", long), (None, "u", same), (1, "u", same), (None, None, "z" * 200)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    folder, archives = W.write(frame)
    assert archives.count() >= 1
    got = W.read(spark, folder).collect()
    assert len(got) == len(rows)
    want = []
    for page, _, body in rows:
        raw = (body or "").encode()
        first = None
        if len(raw) >= 100:
            ids = [p for p, _, b in rows if b == body and p is not None]
            first = min(ids) if ids and min(ids) != page else None
        want.append((str(page), "response" if first is None else "revisit", str(first), len(raw), hashlib.sha256(raw).hexdigest()))
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to_page), r.payload_bytes, r.payload_digest) for r in got) == sorted(want)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert {bytes(r.payload).decode() for r in got if r.page_id == "8"} == {long}
    files = [f for f in __import__("pathlib").Path(folder.removeprefix("file:")).glob("part-*")]
    plain = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert plain.count(b"WARC-Type: continuation") == len(W.HTTP + W.chunked(long.encode())) // W.SEGMENT_BYTES
    assert b"http://a/%0D%0AX:%20y" in plain


def test_chunk_framing():
    for n in (0, 1, 8191, 8192, 8193, 100_000):
        body = bytes(i % 256 for i in range(n))
        assert W.unchunked(W.chunked(body)) == body
    assert W.unchunked(b"3;a=b\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        W.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_missing_segments_are_told(spark, tmp_path):
    body = b"q" * 100_000
    members = W.records("0-0", "1", None, body, hashlib.sha256(body).hexdigest(), None, False)
    (tmp_path / "part-0.warc.gz").write_bytes(b"".join(members[::-1]))
    assert [bytes(r.payload) for r in W.read(spark, str(tmp_path)).collect()] == [body]
    (tmp_path / "part-0.warc.gz").write_bytes(b"".join(members[:1] + members[2:]))
    with pytest.raises(Exception, match="missing"):
        W.read(spark, str(tmp_path)).collect()


def test_empty_table_and_query(spark):
    folder, archives = W.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert archives.count() == 0 and W.read(spark, folder).count() == 0
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = {r.page_id: r for r in op10_warc(spark, "/root/testdata/sf0.001").collect()}
    assert {i: (r.payload_bytes, r.payload_digest) for i, r in got.items()} == {i: (len(h.encode()), hashlib.sha256(h.encode()).hexdigest()) for i, h in pages.items()}
    # a revisit names a record that is there
    first = {i: min(k for k, x in pages.items() if x == h) for i, h in pages.items() if len(h.encode()) >= 100}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {i: ("revisit", first[i]) if first.get(i, i) != i else ("response", None) for i in pages}


def test_ids_of_any_type_and_record_ids_that_are_there(spark):
    rows = [("b/1 é\n", "u", "x" * 200), ("a", "u", "x" * 200), ("", "u", "x" * 200), ("c", "u", "y" * 200)]
    folder, _ = W.write(spark.createDataFrame(rows, "page_id string, url string, html string"))
    got = W.read(spark, folder).collect()
    assert {r.page_id: (r.record_type, r.refers_to_page) for r in got} == {"": ("response", None), "a": ("revisit", ""), "b/1 é\n": ("revisit", ""), "c": ("response", None)}
    ids = {r.record_id for r in got if r.record_type == "response"}
    assert all(r.refers_to in ids for r in got if r.record_type == "revisit") and len({r.record_id for r in got}) == 4


def written(kind, fields, block, version="1.0"):
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/{version}\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def other_writers_archive():
    import base64

    body = b"hello world" * 20
    plain = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    framed = b"HTTP/1.1 200 OK\r\nTRANSFER-ENCODING:  Chunked\r\n\r\n" + W.chunked(body)
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    raw = "sha1:" + base64.b32encode(hashlib.sha1(W.chunked(body)).digest()).decode()
    http = {"Content-Type": "application/http; msgtype=response"}
    at = {"WARC-Target-URI": "http://a/", "WARC-Date": "2020-01-01T00:00:00Z"}
    return body, [
        written("warcinfo", {"WARC-Record-ID": "<urn:uuid:0>", "Content-Type": "application/warc-fields"}, b"software: x\r\n"),
        written("response", {"WARC-Record-ID": "<urn:uuid:1>", "WARC-Payload-Digest": sha1, **at, **http}, plain),
        written("response", {"WARC-Record-ID": "<urn:uuid:2>", "WARC-Payload-Digest": raw, **http}, framed),
        written("request", {"WARC-Record-ID": "<urn:uuid:3>", **http}, b"GET / HTTP/1.1\r\n\r\n"),
        written("revisit", {"WARC-Record-ID": "<urn:uuid:4>", "WARC-Refers-To": "<urn:uuid:1>", "WARC-Payload-Digest": sha1, **http}, b"HTTP/1.1 304 Not Modified\r\n\r\n"),
        written("revisit", {"WARC-Record-ID": "<urn:uuid:5>", "WARC-Refers-To-Target-URI": "http://a/", "WARC-Refers-To-Date": "2020-01-01T00:00:00Z", "WARC-Payload-Digest": sha1}, b""),
        written("revisit", {"WARC-Record-ID": "<urn:uuid:6>", "WARC-Refers-To": "<urn:uuid:99>", "WARC-Payload-Digest": sha1}, b""),
        written("resource", {"WARC-Record-ID": "<urn:uuid:7>", "Content-Type": "text/plain", "X-Folded": "a\r\n b"}, b"as it is"),
        written("response", {"WARC-Record-ID": "<urn:uuid:8>", "Content-Type": "text/dns", "WARC-Payload-Digest": "blake9:zz"}, b"20200101\r\n\r\na. 1 IN A"),
        written("response", {"WARC-Record-ID": "<urn:uuid:9>", "WARC-Segment-Number": "1", "WARC-Payload-Digest": sha1, **http}, plain[:100]),
        written("continuation", {"WARC-Record-ID": "<urn:uuid:10>", "WARC-Segment-Origin-ID": "<urn:uuid:9>", "WARC-Segment-Number": "2", "WARC-Segment-Total-Length": str(len(plain))}, plain[100:]),
    ]


@pytest.mark.parametrize("name", ["CC-MAIN-1.warc.gz", "one.warc.gz", "plain.warc"])
def test_archives_of_other_writers(spark, tmp_path, name):
    body, parts = other_writers_archive()
    (tmp_path / "deep").mkdir()
    data = b"".join(map(gzip.compress, parts)) if name.startswith("CC") else gzip.compress(b"".join(parts)) if name.endswith("gz") else b"".join(parts)
    (tmp_path / "deep" / name).write_bytes(data)
    got = {r.record_id[-2:-1]: r for r in W.read(spark, str(tmp_path)).collect()}
    digest = hashlib.sha256(body).hexdigest()
    assert {k: (r.record_type, r.payload_bytes, r.refers_to) for k, r in got.items()} == {
        "1": ("response", 220, None), "2": ("response", 220, None), "4": ("revisit", 220, "<urn:uuid:1>"), "5": ("revisit", 220, "<urn:uuid:1>"), "6": ("revisit", None, "<urn:uuid:99>"),
        "7": ("resource", 8, None), "8": ("response", 21, None), "9": ("response", 220, None),
    }
    assert all(got[k].payload_digest == digest for k in "12459") and all(bytes(got[k].payload) == body for k in "129")
    assert {k for k, r in got.items() if r.problem} == {"6"} and got["1"].page_id is None


def test_damage_is_told_in_a_column(spark, tmp_path):
    _, parts = other_writers_archive()
    bad = written("response", {"WARC-Record-ID": "<urn:uuid:a>", "WARC-Payload-Digest": "sha1:AAAA"}, b"HTTP/1.1 200 OK\r\n\r\nx")
    framing = written("response", {"WARC-Record-ID": "<urn:uuid:b>"}, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n")
    (tmp_path / "a.warc").write_bytes(bad + framing + parts[9] + parts[1][:-100])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(parts[1])[:-9])
    (tmp_path / "c.warc").write_bytes(b"no archive at all")
    (tmp_path / "d.warc").write_bytes(b"")
    got = W.read(spark, str(tmp_path), strict=False).collect()
    said = sorted((r.record_type, r.problem.split(" of <")[0]) for r in got if r.problem)
    assert said == [("archive", "an archive ends inside a record")] * 2 + [("archive", "broken record"), ("response", "a payload does not match its digest"), ("response", "broken chunk framing"), ("response", "segments")]
    with pytest.raises(Exception, match="broken|digest|ends inside"):
        W.read(spark, str(tmp_path)).collect()
