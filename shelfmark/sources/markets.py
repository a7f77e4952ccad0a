"""Searches of marketplaces as a Spark data source: one call a query and page, in lanes that run side by side.

``answers`` lands the queries in lanes and reads the source; its rows are the answers as they came, so that JSON is
taken apart by built-in functions (``feeds``). A lane is one partition: it reads its queries in order, a batch at a time, and asks page after page of a query
while pages are full, with the pause between calls and the token's lifetime that the marketplace wants. What an answer's status means follows from
the kind of search:

active: 429 and any other failure stop the job, since a gap in the active listings would delist them.
sold: 401 and 403 say that access is not granted: the lane gives no row for this query and asks no more (a latch; other lanes learn of it
by a marker in the shared folder before their next call). Other failures give no row.
shop: any failure gives no row, one lane at a time.

Transports: ``landed`` has each query's answers from a table of (query, offset, status, body) beside it; ``http`` calls a URL,
with a token by client credentials where ``token_url`` is given.

Defined results: a null query is not asked; a query without a landed answer has status 404; a query asked twice is answered
twice; empty queries tables give no rows; times come from the clock of the transport, which tests replace.
"""

from __future__ import annotations

import base64
import itertools
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.ordering import numbered
from ..functions.staging import fresh_path

SCHEMA = "seq long, query string, page_start int, status int, body string"
KINDS = ("active", "sold", "shop")
MOST_PER_PAGE = {"active": 200, "sold": 200, "shop": 50}
#: Names of the parameters of a call, and those that are always sent. Fixed values of the services.
QUERY_PARAMS = {
    "active": ("q", "limit", {"filter": "buyingOptions:{FIXED_PRICE|AUCTION}"}),
    "sold": ("q", "limit", {}),
    "shop": ("s_keywords", "pagemax", {"lang": "eng"}),
}
#: Seconds between two calls of a lane, and before a token's end at which it is asked for anew.
PAUSE = {"active": 0.0, "sold": 0.0, "shop": 1.2}
TOKEN_MARGIN = 60
#: Rows that a lane reads at once, and bytes of a row group of its files.
BATCH, ROW_GROUP = 64, 8 << 20


class Token:
    """A token that is kept until a minute before its end. fetch gives a token and its lifetime in seconds."""

    def __init__(self, fetch: Callable[[], tuple[str, float]], clock: Callable[[], float] = time.time):
        self.fetch, self.clock, self.held, self.until = fetch, clock, None, 0.0

    def __call__(self) -> str:
        if self.held is None or self.clock() >= self.until:
            self.held, lifetime = self.fetch()
            self.until = self.clock() + lifetime - TOKEN_MARGIN
        return self.held


class Pace:
    """Waits so that calls are pause seconds apart at least."""

    def __init__(self, pause: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.pause, self.clock, self.sleep, self.last = pause, clock, sleep, None

    def __call__(self) -> None:
        if self.last is not None and (wait := self.last + self.pause - self.clock()) > 0:
            self.sleep(wait)
        self.last = self.clock()


class Landed:
    """Answers that stand beside their queries, in the order of their offsets, in which they are asked for: one is held, and no others."""

    def __init__(self, rows: Iterator[dict]):
        self.rows, self.own, self.ahead = rows, iter(()), None

    def queries(self) -> Iterator[dict]:
        for _, group in itertools.groupby(self.rows, key=lambda r: r["seq"]):
            self.own = group
            self.ahead = row = next(group)
            yield row

    def __call__(self, query: str, offset: int, limit: int) -> tuple[int, str | None]:
        found = 404, None
        while self.ahead is not None and (self.ahead["offset"] is None or self.ahead["offset"] <= offset):
            if self.ahead["offset"] == offset:
                found = self.ahead["status"], self.ahead["body"]
            self.ahead = next(self.own, None)
        return found


class Http:
    """Answers of a service."""

    def __init__(self, options: dict, kind: str):
        self.options, self.kind = options, kind
        self.token = Token(self.fetch_token) if options.get("token_url") else None

    def opened(self, request: urllib.request.Request) -> tuple[int, str]:
        try:
            with urllib.request.urlopen(request, timeout=float(self.options.get("timeout", 15))) as answer:
                return answer.status, answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode("utf-8", "replace")
        except OSError as e:  # no answer at all
            return 0, str(e)

    def fetch_token(self) -> tuple[str, float]:
        pair = base64.b64encode(f"{self.options['client_id']}:{self.options['client_secret']}".encode()).decode()
        said = {"grant_type": "client_credentials"} | ({"scope": self.options["scope"]} if self.options.get("scope") else {})
        request = urllib.request.Request(self.options["token_url"], urllib.parse.urlencode(said).encode(), {"Authorization": f"Basic {pair}", "Content-Type": "application/x-www-form-urlencoded"})
        status, body = self.opened(request)
        if status != 200:
            raise RuntimeError(f"no token: status {status}")
        got = json.loads(body)
        return got["access_token"], float(got["expires_in"])

    def __call__(self, query: str, offset: int, limit: int) -> tuple[int, str | None]:
        q, n, more = QUERY_PARAMS[self.kind]
        params = {q: query, n: str(limit)} | more
        if self.kind == "shop":
            params["pagecnt"] = str(offset // limit + 1)
        elif offset:
            params["offset"] = str(offset)
        if self.options.get("category"):
            params["category_ids"] = self.options["category"]
        head = {"Accept": "application/json"} | ({"Authorization": f"Bearer {self.token()}"} if self.token else {})
        return self.opened(urllib.request.Request(f"{self.options['url']}?{urllib.parse.urlencode(params)}", headers=head))


LISTS = {"active": "itemSummaries", "sold": "itemSales", "shop": "items"}


def length_of(body: str | None, kind: str) -> int:
    """How many items an answer lists."""
    try:
        return len(json.loads(body or "{}").get(LISTS[kind]) or [])
    except (ValueError, AttributeError):
        return 0


def asked(rows: Iterable[dict], call: Callable, kind: str, limit: int, pages: int | None, denied: Callable[[bool], bool], pace: Callable[[], None]) -> Iterator[tuple]:
    """The answers of a lane. denied(True) tells that access is not granted, denied(False) asks whether any lane was told so. pages: of a query at most, or None."""
    for row in rows:
        for page in itertools.count() if pages is None else range(pages):
            if kind == "sold" and denied(False):
                return
            pace()
            status, body = call(row["query"], page * limit, limit)
            if kind == "active" and status != 200:
                raise RuntimeError(f"the search for {row['query']!r} failed with status {status}" + (": too many calls, try later" if status == 429 else ""))
            if kind == "sold" and status in (401, 403):
                denied(True)
                return
            if status != 200:
                break
            yield row["seq"], row["query"], page * limit, status, body
            if length_of(body, kind) < limit:
                break


def _store(path: str):
    from pyarrow import fs

    path = f"file://{path.removeprefix('file:')}" if path.startswith("file:/") and not path.startswith("file://") else path
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class MarketReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(int(self.options["lanes"]))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        options, kind = self.options, self.options["kind"]
        store, root = _store(options["path"])

        def table() -> Iterator[dict]:
            """The lane's rows in order: Spark numbers files by their range of the order, and sorts within each."""
            folder = f"{root}/queries/lane={partition.value}"
            if store.get_file_info(folder).type == fs.FileType.NotFound:
                return
            for path in sorted(f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet")):
                with store.open_input_file(path) as source:
                    for batch in pq.ParquetFile(source).iter_batches(BATCH):
                        yield from batch.to_pylist()

        marker = f"{root}/denied"

        def denied(told: bool) -> bool:
            if told:
                with store.open_output_stream(marker) as out:
                    out.write(b"")
            # a latch of its own lane is enough for one run to be like another; what other lanes were told only saves calls
            return told or (options.get("shared_latch") == "true" and store.get_file_info(marker).type == fs.FileType.File)

        call = Landed(table()) if options["transport"] == "landed" else Http(options, kind)
        rows = call.queries() if options["transport"] == "landed" else table()
        yield from asked(rows, call, kind, int(options["limit"]), int(options["pages"]) or None, denied, Pace(0.0 if options["transport"] == "landed" else PAUSE[kind]))


class Market(DataSource):
    """spark.read.format("market")."""

    @classmethod
    def name(cls) -> str:
        return "market"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MarketReader(self.options)


def answers(queries: DataFrame, kind: str, landed: DataFrame | None = None, lanes: int = 4, limit: int = 50, pages: int | None = 1, **options: str) -> DataFrame:
    """SCHEMA's rows for a table of queries (query, and any columns to order by: priority first, then query). landed: query, offset, status,
    body; without it options has url and, for a token, token_url, client_id and client_secret. pages: of a query at most; None: until one is not full."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    spark = queries.sparkSession
    spark.dataSource.register(Market)
    path, lanes = fresh_path(spark, "market", make=True), 1 if kind == "shop" else lanes
    order = [F.col(c) for c in queries.columns if c != "query"]
    placed = numbered(queries.filter("query IS NOT NULL"), *order, F.col("query"), name="seq")
    placed = placed.select(F.col("seq").cast("long").alias("seq"), "query", F.pmod(F.col("seq"), F.lit(lanes)).cast("int").alias("lane"))
    most, parts = min(limit, MOST_PER_PAGE[kind]), int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["lane", "seq"]
    if landed is not None:
        # only offsets that can be asked; the numbers are staged, so that a query keeps its number when its answers are joined
        pages_of = landed.select("query", F.col("offset").cast("int").alias("offset"), F.col("status").cast("int").alias("status"), "body").filter((F.col("offset") >= 0) if pages is None else F.col("offset").between(0, most * (pages - 1)))
        placed, order = placed.join(pages_of, "query", "left"), [*order, "offset"]
    # files of ranges of a lane's order: no task sorts or writes a whole lane, and a reader holds a small row group
    placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.partitionBy("lane").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/queries")
    said = {"path": path, "kind": kind, "transport": "http" if landed is None else "landed", "lanes": lanes, "limit": most, "pages": pages or 0}
    # a lane is one task, so what is made of its answers is spread over more
    return spark.read.format("market").options(**said, **options).load().repartition(parts)
