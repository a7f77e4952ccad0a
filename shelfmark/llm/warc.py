"""WARC archives: written from pages, read back, segments put together.

``write`` makes gzipped WARC 1.1 files in the shared folder. Of pages with equal payloads of
at least ``least_bytes``, that with the least id becomes a response and the others revisit
it. Bodies are framed in chunks, and records longer than ``segment_bytes`` continue in
further records.

``read`` takes archives of any writer, gzipped or plain, by folder, file or pattern. Workers stream each
archive once: whole records are decoded there, and segments are grouped by their origin's identifier, ordered
by number, verified to be without gaps and of the stated total length, and freed of chunk framing. Revisits
get the length and digest of the record that they refer to, by its identifier or else by its URI and date.
Payload digests (sha1, sha256, sha512 or md5, in hexadecimal digits or base 32) are verified, over the body with or
without its chunk framing; other algorithms are not.

Defined results: null payloads count as empty; payloads of any length are one value; ids may have any type and
are read back as strings; repeated rows of the least id are all responses, of one record id, and equal segments of one origin are
read as copies of a record; a page without
id is never referred to, and revisits another only if that has an id; control characters in URLs are
percent-encoded; an empty table gives no records; further columns are left out, so their names cannot clash;
of several records with the identifier or the URI and date that a revisit refers to, that with the least digest, then id, counts;
a revisit of a record that is not there has its stated digest, if in hexadecimal sha256, and no length. Damaged records and archives raise an
error, or, unless ``strict``, have their fault in the column ``problem``; what follows damage in an archive is
not read then, and a row of the type ``archive`` says so.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import fresh_path, staged

LEAST_BYTES = 100
#: Bytes of a record's block before it continues in another record; of a chunk; of an archive before compression.
SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_BYTES = 32 << 10, 8 << 10, 32 << 20

DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(body: bytes) -> bytes:
    parts = [body[i : i + CHUNK_BYTES] for i in range(0, len(body), CHUNK_BYTES)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The body in chunk framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        if line < 0 or not re.fullmatch(rb"[ \t]*[0-9A-Fa-f]+[ \t]*", data[at:line].split(b";")[0]):
            raise ValueError("broken chunk framing")
        size = int(data[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(data[line + 2 : line + 2 + size])
        at = line + 2 + size
        if len(out[-1]) != size or data[at : at + 2] != b"\r\n":
            raise ValueError("broken chunk framing")
        at += 2


def record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    data = f"WARC/1.1\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record_id(*of: object) -> str:
    """A record identifier that follows from what it is made of."""
    name = hashlib.sha256("\n".join(quote(str(x), safe="") for x in of).encode()).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=name, version=5)}>"


def records(place: str, page: str | None, url: str | None, body: bytes, digest: str, first: str | None, copied: bool) -> list[bytes]:
    """The gzip members of a page: one, or one for each segment. place tells it from other pages; copied: others revisit it or it one."""
    own = record_id("page", page, digest) if copied and first is None else record_id("at", place, page, digest)
    base = [("WARC-Record-ID", own), ("WARC-Date", DATE)]
    if page is not None:
        base.append(("X-Page-ID", quote(page, safe="")))
    if url is not None:
        base.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    base += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if first is not None:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id("page", first, digest))]
        return [record("revisit", base + more, HTTP)]
    block = HTTP + chunked(body)
    if len(block) <= SEGMENT_BYTES:
        return [record("response", base, block)]
    parts = [block[i : i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
    out = [record("response", [*base, ("WARC-Segment-Number", 1)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        fields = [("WARC-Record-ID", record_id("segment", own, k)), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k)]
        out.append(record("continuation", [*fields, *([("WARC-Segment-Total-Length", len(block))] if k == len(parts) else [])], part))
    return out


def opened(uri: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = f"file://{uri.removeprefix('file:')}"
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES) -> tuple[str, DataFrame]:
    """The folder of the archives and a table of them: path, n_records, bytes."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc", make=True)
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("body"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    long = F.octet_length("body") >= least_bytes
    firsts = rows.filter(long).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("same"), "first")
    firsts = staged(firsts, "first-pages")
    typed = rows.join(firsts, (F.col("digest") == F.col("same")) & long, "left")
    first = F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    typed = typed.select(F.col("page").cast("string").alias("page"), "url", "body", "digest", first.cast("string").alias("first"), F.col("same").isNotNull().alias("copied"))
    # in one order, so that a task that runs again writes the same archives
    typed = typed.sortWithinPartitions("page", "digest", "url")

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        held, size, n_archives, n_records = [], 0, 0, 0

        def closed():
            nonlocal held, size, n_archives, n_records
            name = f"part-{context.partitionId():06d}-{n_archives:04d}.warc.gz"
            data = b"".join(held)
            # written whole under a name of this attempt, then renamed: a task that runs again leaves the same file
            temporary = f"{root}/_{context.taskAttemptId()}-{name}"
            with store.open_output_stream(temporary, compression=None) as f:
                f.write(data)
            store.move(temporary, f"{root}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n_records], pa.int64()), pa.array([len(data)], pa.int64())], names=["path", "n_records", "bytes"])
            held, size, n_archives, n_records = [], 0, n_archives + 1, 0
            return row

        i = 0
        for batch in batches:
            for k in range(batch.num_rows):
                page, url, body, digest, first, copied = (c[k].as_py() for c in batch.columns)
                body = body.encode()
                members = records(f"{context.partitionId()}-{i}", page, url, body, digest, first, copied)
                i += 1
                held += members
                n_records += len(members)
                size += len(body)
                if size >= ARCHIVE_BYTES:
                    yield closed()
        if held:
            yield closed()

    return folder, staged(typed.mapInArrow(run, "path string, n_records long, bytes long"), "archives")


def parsed(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, names in lower case, and block of each record of an archive, gzipped or plain, read as a stream."""
    plain = io.BufferedReader(file, 1 << 20)
    if plain.peek(2)[:2] == b"\x1f\x8b":
        plain = io.BufferedReader(gzip.GzipFile(fileobj=plain), 1 << 20)
    try:
        while line := plain.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("broken record")
            head, name = {}, None
            while (line := plain.readline()).strip():
                text = line.decode("utf-8", "replace")
                if text[0] in " \t" and name:
                    head[name] += f" {text.strip()}"
                else:
                    name, _, value = text.partition(":")
                    name = name.strip().lower()
                    head[name] = value.strip()
            if not head.get("content-length", "").isdecimal() or "warc-type" not in head:
                raise ValueError("broken record")
            block = plain.read(int(head["content-length"]))
            if len(block) != int(head["content-length"]):
                raise ValueError("an archive ends inside a record")
            yield head, block
    except (EOFError, zlib.error, gzip.BadGzipFile) as e:
        raise ValueError("an archive ends inside a record" if isinstance(e, EOFError) else "broken compression") from e


def body_of(block: bytes, http: bool = True) -> tuple[bytes, bytes]:
    """The payload of a record, and as it stands there, with its chunk framing."""
    if not http:
        return block, block
    head, _, body = block.partition(b"\r\n\r\n")
    coding = re.search(rb"(?im)^transfer-encoding:[ \t]*([^\r\n]*)", head)
    return (unchunked(body) if coding and coding[1].lower().replace(b" ", b"").endswith(b"chunked") else body), body


def fault_of(said: str | None, body: bytes, raw: bytes) -> str | None:
    """What is wrong with a stated digest, if that can be told."""
    name, _, value = (said or "").partition(":")
    kind = name.strip().lower().replace("-", "")
    if kind not in ("sha1", "sha256", "sha512", "md5") or not value:
        return None
    for data in (body, raw):
        digest = hashlib.new(kind, data).digest()
        if value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("="):
            return None
    return "a payload does not match its digest"


def bare_sha256(said: str | None) -> str | None:
    """The hexadecimal digits of a stated sha256 digest."""
    found = re.fullmatch("(?i)sha-?256:([0-9a-f]{64})", said or "")
    return found[1].lower() if found else None


RECORD = [
    ("record_id", pa.string()), ("page_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to_id", pa.string()), ("refers_to_uri", pa.string()),
    ("refers_to_date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("problem", pa.string()), ("payload", pa.binary()),
]
#: Segments have these beside; their block is in payload until they are put together.
SEGMENT = [("segment", pa.int64()), ("total", pa.int64()), ("origin", pa.string()), ("said", pa.string()), ("http", pa.bool_())]
#: How often a segment stands.
COPIES = ("copies", pa.int64())
DDL = ", ".join(f"{n} {'long' if t == pa.int64() else 'binary' if t == pa.binary() else 'boolean' if t == pa.bool_() else 'string'}" for n, t in [*SEGMENT, *RECORD])
RECORD_DDL = ", ".join(f"{n} {'long' if t == pa.int64() else 'binary' if t == pa.binary() else 'string'}" for n, t in RECORD)


def batches_of(rows: Iterator[dict], columns: list[tuple[str, pa.DataType]], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 400 + len(row.get("payload") or b"")
        if size > most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], t) for n, t in columns], names=[n for n, _ in columns])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], t) for n, t in columns], names=[n for n, _ in columns])


def decoded(row: dict, block: bytes, http: bool, said: str | None, payloads: bool, strict: bool) -> dict:
    """A row with its payload, its length and digest, or its fault."""
    try:
        body, raw = body_of(block, http)
    except ValueError as e:
        if strict:
            raise
        return row | {"problem": str(e), "payload": None}
    problem = fault_of(said, body, raw)
    if problem and strict:
        raise ValueError(problem)
    return row | {"payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest(), "problem": problem, "payload": body if payloads else None}


def read(spark: SparkSession, path: str, payloads: bool = True, strict: bool = True) -> DataFrame:
    """The responses, resources and revisits of the archives at a path: record_id, page_id (of archives by write), record_type,
    target_uri, date, refers_to (a record id), refers_to_page, payload_bytes, payload_digest (sha256 in hexadecimal digits), problem, and payload,
    null for revisits, and for all unless payloads."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(path)

    def run(batches):
        def rows():
            for batch in batches:
                for uri in batch.column(0).to_pylist():
                    store, name = opened(uri)
                    with store.open_input_file(name) as file:
                        try:
                            for head, block in parsed(file):
                                yield from one(head, block)
                        except ValueError as e:
                            if strict:
                                raise ValueError(f"{uri}: {e}") from e
                            yield {"record_type": "archive", "target_uri": uri, "problem": str(e)}

        def one(head, block):
            kind, said = head["warc-type"].lower(), head.get("warc-payload-digest")
            page = head.get("x-page-id")
            row = {"record_id": head.get("warc-record-id"), "page_id": None if page is None else unquote(page), "record_type": kind, "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date")}
            http = kind == "response" and head.get("content-type", "application/http").lower().startswith("application/http")
            if "warc-segment-number" in head and kind in ("response", "resource", "continuation"):
                total, segment = head.get("warc-segment-total-length", ""), head["warc-segment-number"]
                yield row | {
                    "origin": head.get("warc-segment-origin-id") if kind == "continuation" else row["record_id"], "segment": int(segment) if segment.isdecimal() else 0,
                    "total": int(total) if total.isdecimal() else None, "said": said, "http": http, "payload": block,
                }
            elif kind == "revisit":
                refers = {f"refers_to_{a}": head.get(f"warc-refers-to{b}") for a, b in (("id", ""), ("uri", "-target-uri"), ("date", "-date"))}
                yield row | refers | {"payload_digest": bare_sha256(said)}
            elif kind in ("response", "resource"):
                yield decoded(row, block, http, said, payloads, strict)

        yield from batches_of(rows(), [*SEGMENT, *RECORD])

    def together(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["segment"])
        firsts = [r for r in rows if r["segment"] == 1] or rows[:1]  # repeated rows may differ in what their first segments say of them
        rest = [r for r in rows if r["segment"] > 1]

        def joined(first: dict) -> dict:
            own = [first, *rest]
            block = b"".join(r["payload"] for r in own)
            if [r["segment"] for r in own] != list(range(1, len(own) + 1)) or own[-1]["total"] != len(block):
                problem = f"segments of {first['origin']} are missing or of the wrong length"
                if strict:
                    raise ValueError(problem)
                return first | {"problem": problem, "payload": None}
            return decoded(first, block, first["http"], first["said"], payloads, strict)

        return pa.Table.from_batches(batches_of(map(joined, firsts), [*RECORD, COPIES]))

    found = staged(listed.select("path").mapInArrow(run, DDL), "records")
    names = [n for n, _ in RECORD]
    parts = found.filter("segment IS NOT NULL").withColumn("origin", F.coalesce("origin", "record_id"))
    # equal segments are copies of one, told by their digests before anything is brought together; the first one says how many records there are
    told = [n for n, _ in [*SEGMENT, *RECORD] if n not in ("record_id", "payload")]
    continued = F.when(F.col("segment") == 1, F.col("record_id"))
    parts = parts.groupBy(*told, continued.alias("record_id"), F.sha2("payload", 256).alias("of")).agg(F.first("payload").alias("payload"), F.count("*").alias(COPIES[0])).drop("of")
    parts = parts.groupBy("origin").applyInArrow(together, f"{RECORD_DDL}, {COPIES[0]} long")
    parts = parts.withColumn(COPIES[0], F.explode(F.array_repeat(F.lit(1), F.col(COPIES[0]).cast("int"))))
    whole = found.filter("segment IS NULL").select(names).unionByName(parts.select(names))
    others, revisits = whole.filter("record_type <> 'revisit'"), whole.filter("record_type = 'revisit'")

    # what revisits refer to: one row for each identifier, and for each URI and date
    target = F.min(F.struct("payload_digest", "record_id", "page_id", "payload_bytes")).alias("of")
    known = others.filter("payload_digest IS NOT NULL").select("record_id", "page_id", "target_uri", "date", "payload_bytes", "payload_digest")
    by_id = known.groupBy("record_id").agg(target).select(F.col("record_id").alias("refers_to_id"), F.col("of").alias("by_id"))
    by_uri = known.groupBy("target_uri", "date").agg(target).select(F.col("target_uri").alias("refers_to_uri"), F.col("date").alias("refers_to_date"), F.col("of").alias("by_uri"))
    named = revisits.filter("refers_to_id IS NOT NULL").join(by_id, "refers_to_id", "left").withColumn("by_uri", F.lit(None).cast(by_uri.schema["by_uri"].dataType))
    dated = revisits.filter("refers_to_id IS NULL").join(by_uri, ["refers_to_uri", "refers_to_date"], "left").withColumn("by_id", F.lit(None).cast(by_id.schema["by_id"].dataType))
    resolved = named.unionByName(dated).withColumn("of", F.coalesce("by_id", "by_uri"))
    out = ["record_id", "page_id", "record_type", "target_uri", "date", "refers_to", "refers_to_page", "payload_bytes", "payload_digest", "problem", "payload"]
    resolved = resolved.select(
        "record_id", "page_id", "record_type", "target_uri", "date", F.coalesce("of.record_id", "refers_to_id").alias("refers_to"), F.col("of.page_id").alias("refers_to_page"),
        F.col("of.payload_bytes").alias("payload_bytes"), F.coalesce("of.payload_digest", "payload_digest").alias("payload_digest"),
        F.coalesce("problem", F.when(F.col("of").isNull(), "the record referred to is not there")).alias("problem"), "payload",
    )
    none = F.lit(None).cast("string")
    return others.withColumn("refers_to", none).withColumn("refers_to_page", none).select(out).unionByName(resolved.select(out))
