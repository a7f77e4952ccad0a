"""Search by an inverted index of the runs of two and three characters in each row's texts.

A token can only stand in a text that holds all its runs, so the rows of its rarest run are the candidates, and
each is then checked for every token. Postings are packed: one row holds the ids that some megabytes of text have for a run. They lie in folders by a checksum of their run, sorted, so a search reads the row groups
of one run. The index names rows by their id; texts stay in their table.

Postings of two or three characters grow with the rows, so as many queries as rows would make candidates by the square of the rows. Many queries at once
are therefore led to their rows by what they ask for: of each, up to 16 characters around its rarest run, which one pass over the texts looks for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import spread, unused
from ..functions.staging import staged
from .catalog import matches_query, query_tokens

FOLDERS, SPREAD = 64, 8
#: Characters of texts whose postings are packed together, at most, but for one longer row.
PIECE = 4 << 20
#: Characters of a token by which many searches are led to its texts, at most, and characters of texts that are looked at at once.
ASKED, BLOCK = 16, 1 << 16
#: Parts of the table of bits that marks what is asked for, bits of a part as a power of two (16 MB in all at most), and the odd number whose powers make keys.
PARTS, LEAST, MOST, BASE = 64, 10, 21, 0x9E3779B97F4A7C15


def runs_of(text: Column) -> Column:
    """Distinct runs of two and of three characters of a token; a null or shorter one has none."""
    at = lambda k: F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: text.substr(i, F.lit(k)))
    of = lambda k: F.when(F.length(text) >= k, at(k)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(of(2), of(3)))


def token_runs(token: str) -> list[str]:
    """The runs that a text with this token has to hold: those of three characters, or the one of two."""
    k = min(3, len(token))
    return [token[i : i + k] for i in range(len(token) - k + 1)] if k >= 2 else []


def folder_of(run: str) -> int:
    return zlib.crc32(run.encode()) % FOLDERS


@dataclass
class Index:
    postings: DataFrame  # folder, run, n, ids
    sizes: DataFrame  # folder, run, n


def packed_runs(ids: pa.Array, texts: list[list[str]]) -> Iterator[pa.RecordBatch]:
    """run, n and ids of rows with some texts each: each distinct run of two and of three characters once, with the rows that hold it."""
    n = len(texts)
    flat = [t for own in texts for t in own]
    points = np.frombuffer("".join(flat).encode("utf-32-le"), np.uint32)
    if not len(points):
        return
    text = np.repeat(np.arange(len(flat)), [len(t) for t in flat])
    row = np.repeat(np.arange(n), [len(own) for own in texts])[text]
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    letters = np.flatnonzero(seen)
    base = len(letters) + 1  # the last number stands for no third character
    if n > 1 and base**3 * n >= 1 << 63:
        yield from packed_runs(ids[: n // 2], texts[: n // 2])
        yield from packed_runs(ids[n // 2 :], texts[n // 2 :])
        return
    number = np.zeros(0x110000, np.int64)
    number[letters] = np.arange(len(letters))
    number = number[points]
    two, three = text[:-1] == text[1:], text[:-2] == text[2:]
    pairs = number[:-1] * base + number[1:]
    keys = np.unique(np.concatenate([((pairs * base + base - 1) * n + row[:-1])[two], ((pairs[:-1] * base + number[2:]) * n + row[:-2])[three]]))
    if not len(keys):
        return
    codes, holder = np.divmod(keys, n)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    codes = codes[first]
    sign = [*map(chr, letters.tolist()), ""]
    runs = [sign[a] + sign[b] + sign[c] for a, b, c in zip((codes // base**2).tolist(), (codes // base % base).tolist(), (codes % base).tolist(), strict=True)]
    at = np.append(first, len(keys))
    held = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), ids.take(pa.array(holder)))
    yield pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(np.diff(at), pa.int64()), held], names=["run", "n", "ids"])


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[list[str]]]]:
    """ids and texts of a batch (id, texts), by pieces of at most PIECE characters."""
    texts = [[t or "" for t in own] for own in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
    ends = np.cumsum([sum(map(len, own)) for own in texts])
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PIECE, side="right")))
        yield batch.column(0)[begin:end], texts[begin:end]
        begin = end


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of batches (id, texts)."""
    for batch in batches:
        for ids, texts in pieces(batch):
            yield from packed_runs(ids, texts)


def read(rows: DataFrame, id_col: str, texts: list[Column]) -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), *(t.cast("string").alias(f"t{i}") for i, t in enumerate(texts)))


def build(rows: DataFrame, path: str, id_col: str, texts: list[Column]) -> Index:
    """The index of texts, written at a path."""
    kind = rows.schema[id_col].dataType.simpleString()
    held = read(spread(rows), id_col, texts).mapInArrow(packed, f"run string, n long, ids array<{kind}>")
    held = held.withColumn("folder", (F.crc32(F.col("run").cast("binary")) % FOLDERS).cast("int"))
    # a run that a third of all rows hold goes to SPREAD tasks
    placed = held.repartition("folder", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(SPREAD))).sortWithinPartitions("folder", "run")
    placed.write.partitionBy("folder").option("compression", "zstd").parquet(f"{path}/postings")
    spark = rows.sparkSession
    postings = spark.read.schema(held.schema).parquet(f"{path}/postings")
    postings.groupBy("folder", "run").agg(F.sum("n").alias("n")).repartition("folder").sortWithinPartitions("run").write.partitionBy("folder").parquet(f"{path}/sizes")
    return Index(postings, spark.read.schema("run string, n long, folder int").parquet(f"{path}/sizes"))


def search(index: Index, rows: DataFrame, query: str, id_col: str = "figure_id", text: str = "search_text", name: str = "name") -> DataFrame:
    """The rows that matches_query takes, read by the postings of the query's rarest run. A query without a run of two characters looks at all rows."""
    tokens = query_tokens(query) or [" ".join(query.split()).lower()]
    runs = list(dict.fromkeys(r for t in tokens for r in token_runs(t)))
    hit = matches_query(query, text, name)
    if not runs:
        return rows.filter(hit)
    known = index.sizes.filter(F.col("folder").isin(sorted({folder_of(r) for r in runs})) & F.col("run").isin(runs)).collect()  # a row for each run of the query
    sizes = {r.run: r.n for r in known}
    rarest = min(runs, key=lambda r: (sizes.get(r, 0), r))
    (own,) = unused(rows.columns, "id")
    found = index.postings.filter((F.col("folder") == folder_of(rarest)) & (F.col("run") == rarest)).select(F.explode("ids").alias(own))
    return rows.join(found, F.col(id_col) == F.col(own), "left_semi").filter(hit)


def window_keys(points: np.ndarray, lengths: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length, a 64-bit key of each window of so many code points, a polynomial of them; equal windows have equal keys."""
    n = len(points)
    up, down = (np.cumprod(np.full(n, x, np.uint64)) for x in (BASE, pow(BASE, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * up)])
    for k in lengths:
        if k <= n:
            yield k, (sums[k:] - sums[:-k]) * down[: n - k + 1]


def points_of(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tokens, key and length of batches (tokens, asked)."""
    for batch in batches:
        asked = batch.column(1).to_pylist()
        length = np.array([len(a) for a in asked], np.int32)
        keys = np.zeros(len(asked), np.uint64)
        for k in set(length.tolist()):
            at = np.flatnonzero(length == k)
            keys[at] = next(window_keys(points_of([asked[i] for i in at]), [k]))[1][::k]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys.view(np.int64)), pa.array(length)], names=["tokens", "key", "n"])


def places(width: int) -> tuple[int, ...]:
    """Where a key has its places in its part of the table, the first beside the number of the part."""
    return 58 - width, 0, 19


def marks_of(keys: DataFrame) -> tuple[bytes, int]:
    """A table of bits, of bounded size, that marks the keys, and the bits of one of its parts as a power of two. A key's part follows from its highest bits."""
    width = min(MOST, max(LEAST, (4 * keys.count()).bit_length()))  # 256 bits a key and more, while the table may grow

    def part(table: pa.Table) -> pa.Table:
        own, bits = table.column("key").to_numpy().view(np.uint64), np.zeros(1 << width, np.uint8)
        for place in places(width):
            bits[(own >> np.uint64(place)) & np.uint64((1 << width) - 1)] = 1
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    size = (1 << width) // 8
    marks = bytearray(size * PARTS)
    for r in keys.select("key", F.shiftrightunsigned("key", 58).cast("int").alias("part")).groupBy("part").applyInArrow(part, "part int, bits binary").collect():  # 64 rows
        marks[r.part * size : (r.part + 1) * size] = r.bits
    return bytes(marks), width


def marked(keys: np.ndarray, marks: np.ndarray, some: np.ndarray, width: int) -> np.ndarray:
    """Where the keys are that are marked: all that marks were made of, and a few others. some: which bytes of marks have a bit."""
    first = places(width)[0]
    at = np.flatnonzero(some[keys >> np.uint64(first + 3)])
    for place in places(width):
        own = keys[at]
        bit = (own >> np.uint64(58) << np.uint64(width)) | (own >> np.uint64(place) & np.uint64((1 << width) - 1))
        at = at[(marks[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
    return at


def holding(rows: DataFrame, kind: str, lengths: list[int], marks: bytes, width: int) -> DataFrame:
    """(key, id): the keys of windows that are marked, once for each of the rows (id, texts) that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(marks, np.uint8)
        some = bits != 0
        for batch in batches:
            for ids, texts in pieces(batch):
                flat = [t for own in texts for t in own]
                ends, row = np.cumsum([len(t) for t in flat]), np.repeat(np.arange(len(texts)), [len(own) for own in texts])
                points = points_of(flat)
                found, holder = [np.zeros(0, np.uint64)], [row[:0]]
                for begin in range(0, len(points), BLOCK):
                    for k, keys in window_keys(points[begin : begin + BLOCK + ASKED - 1], lengths):
                        at = marked(keys[:BLOCK], bits, some, width)
                        text = np.searchsorted(ends, begin + at, side="right")
                        whole = begin + at + k <= ends[text]
                        found.append(keys[at[whole]])
                        holder.append(row[text[whole]])
                found, holder = np.concatenate(found), np.concatenate(holder)
                order = np.lexsort((found, holder))
                found, holder = found[order], holder[order]
                first = np.append(True, (found[1:] != found[:-1]) | (holder[1:] != holder[:-1]))[: len(found)]
                yield pa.RecordBatch.from_arrays([pa.array(found[first].view(np.int64)), ids.take(pa.array(holder[first]))], names=["key", "id"])

    return rows.mapInArrow(run, f"key long, id {kind}")


def searched(index: Index | None, rows: DataFrame, queries: DataFrame, id_col: str, texts: list[Column]) -> DataFrame:
    """(query_id, id) for many queries at once. queries: query_id, tokens of two characters or more; one without tokens finds nothing.

    Queries of the same tokens are looked up once, and each text is read once for what is asked for, and once beside all that may stand in it.
    A query is led by its token with the rarest run in the index of the texts; without an index, by its longest one.
    """
    queries = staged(queries.select("query_id", "tokens").distinct(), "queries")
    led = queries.select("tokens").distinct()
    if index is None:
        led = led.withColumn("token", F.array_max(F.transform("tokens", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"])
        begin = F.lit(1)
    else:
        first = lambda t: F.when(F.length(t) < 3, F.array(t)).otherwise(F.filter(runs_of(t), lambda r: F.length(r) == 3))
        wanted = led.select("tokens", F.explode(F.array_distinct(F.flatten(F.transform("tokens", first)))).alias("run"))
        sized = wanted.join(index.sizes.select("run", "n"), "run", "left")
        led = sized.groupBy("tokens").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("r")).filter("r.n > 0").select("tokens", "r.run")
        led = led.withColumn("token", F.get(F.filter("tokens", lambda t: t.contains(F.col("run"))), 0))
        begin = F.greatest(F.lit(1), F.least(F.position("run", "token"), F.length("token") - ASKED + 1))
    led = led.filter(F.length("token") >= 2)
    asked = staged(led.select("tokens", F.substr("token", begin, F.lit(ASKED)).alias("asked")).mapInArrow(keyed, "tokens array<string>, key long, n int"), "asked")
    lengths = sorted(r.n for r in asked.select("n").distinct().collect())  # ASKED rows at most
    found = holding(read(rows, id_col, texts), rows.schema[id_col].dataType.simpleString(), lengths, *marks_of(asked.select("key").distinct()))
    found = found.join(asked.select("key", "tokens"), "key").groupBy("id").agg(F.collect_set("tokens").alias("asked"))
    held = rows.select(F.col(id_col).alias("id"), F.array(*texts).alias("texts"))
    all_there = lambda tokens: F.forall(tokens, lambda t: F.exists("texts", lambda x: F.coalesce(x.contains(t), F.lit(False))))
    # outer, since a plain explode is led by a filter that checks all tokens once more
    hits = found.join(held, "id").select("id", F.explode_outer(F.filter("asked", all_there)).alias("tokens")).filter("tokens IS NOT NULL")
    return queries.join(hits, "tokens").select("query_id", "id")
