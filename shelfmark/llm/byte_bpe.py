"""Byte-level BPE over a global shuffle of distinct words.

``encode`` cuts texts into pre-tokens, once, and stages them by block of documents: the block's distinct
words, and each text as numbers of these. Every distinct word of a block goes once to the bucket of its
hash, where each word of the whole corpus meets its copies and is encoded a single time, and the ids
go back to the block, where they are put together by position. Rows travel packed: one for each
(block, bucket), so a very common word is one entry of a block and no key is hot. The number of buckets follows
from the size of the texts. ``decode`` joins ids with the table of token bytes.

Texts are cut by the pattern given: the GPT-2 one has a vectorised form, others go through a regular expression.

Defined results: null text counts as empty and has no ids; texts of any length are encoded whole; what a pattern
does not match has no tokens; repeated rows give repeated rows, so nothing is tied; a null id is kept, and ids may
have any type; an empty table gives an empty table; further columns are left out of the codes, so their names
cannot clash; a column with the name of a result of ``decode`` is replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import named
from ..functions.staging import staged
from .arrow_text import binary_array, cached, coded, mapped, pack, pieces, planes, runs, text_buffers, tidy, uncoded, unpack, unplanes

#: Bytes of text of a block, at most, but for a longer single batch; of a bucket's share of all texts, at least and at most.
BLOCK_BYTES, LEAST_SHARE, MOST_SHARE = 12 << 20, 4 << 20, 32 << 20
#: Bytes of text that are cut into words at once, and how many such pieces are compressed together; words whose ids are put together at once.
#: A longer text is worked on alone. Two workers of each executor stand beside its JVM, so what a task holds counts twice.
PIECE_BYTES, PIECES, WORDS = 512 << 10, 4, 64 << 10
#: How hard blocks are compressed: what is staged and shuffled is most of the operator's disk.
LEVEL = 9

# Fixed value: the pattern that pretoken_starts implements.
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4


def char_classes() -> np.ndarray:
    """The class of each code point."""

    def build():
        category = unicodedata.category
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        table[WHITE_SPACE] = SPACE
        return table

    return cached("char_classes", build)


def pretoken_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte offsets at which the pre-tokens of the texts begin, as the GPT-2 pattern cuts them.

    Runs of letters, numbers or others take one blank before them; the last white space of a
    run before a text's next word stands alone or goes to that word; an apostrophe at the
    start of a run of others takes s, t, m, d, re, ve or ll with it.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    plain = len(lead) == len(data)
    cp = data if plain else np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = char_classes()[cp]
    n = len(cp)
    first = np.zeros(n, bool)
    edges = at[:-1][at[:-1] < at[1:]]
    first[edges if plain else np.searchsorted(lead, edges)] = True
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank_before = np.zeros(n, bool)
    blank_before[1:] = (cp[:-1] == 32) & ~first[1:]
    space = kind == SPACE
    start = run & (space | ~blank_before)
    ends_space = np.zeros(n, bool)  # the last white space of a run that a word follows
    ends_space[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start |= ends_space
    quote = np.flatnonzero(start & (cp == 39) & ~blank_before)
    if len(quote):
        pad = np.concatenate([cp, np.zeros(3, cp.dtype)])
        stop = np.concatenate([first, np.ones(3, bool)])
        a, b = pad[quote + 1], pad[quote + 2]
        in_a, in_b = ~stop[quote + 1], ~stop[quote + 1] & ~stop[quote + 2]
        one = in_a & np.isin(a, [ord(c) for c in "stmd"])
        two = in_b & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for hit, length in ((one, 2), (two, 3)):
            q = quote[hit]
            start[q + 1] = False
            after = q + length
            after = after[after < n]
            start[after] |= kind[after] == LETTER
    found = np.flatnonzero(start)
    return found if plain else lead[found]


def tokenizer(path: str, pattern: str):
    """The tiktoken encoding of a file of ranks."""

    def build():
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return cached(f"tokenizer {path} {pattern}", build)


def token_bytes(path: str) -> pa.Array:
    """Row i holds the bytes of token i."""

    def build():
        with open(path, "rb") as f:
            ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
        return pa.array([ranks.get(i, b"") for i in range(max(ranks, default=-1) + 1)], pa.binary())

    return cached(f"token bytes {path}", build)


def pretokens(data: np.ndarray, at: np.ndarray, pattern: str) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of the texts, and how many each has."""
    if pattern == GPT2:
        starts = pretoken_starts(data, at)
        return binary_array(data, starts, np.append(starts[1:], len(data))[: len(starts)]), np.diff(np.searchsorted(starts, at))

    def build():
        import regex

        # white space as the library sees it, which is the Unicode property
        return regex.compile(re.sub(r"(?<!\\)((?:\\\\)*)\\([sS])", lambda m: m[1] + (r"\p{White_Space}" if m[2] == "s" else r"\P{White_Space}"), pattern))

    found = cached(f"pattern {pattern}", build)
    raw = data.tobytes()
    cut = [[m[0].encode() for m in found.finditer(raw[a:z].decode("utf-8")) if m[0]] for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return pa.array([w for words in cut for w in words], pa.binary()), np.array([len(words) for words in cut], np.int64)


def numbered(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, and each word as a number of these."""
    held = words.dictionary_encode()
    return held.dictionary, held.indices.to_numpy(zero_copy_only=False)


class Block:
    """Documents of one part of the input: their ids, their distinct words, and each text as numbers of words."""

    def __init__(self):
        self.ids, self.counts, self.words, self.numbers, self.bytes = [], [], [], [], 0

    def add(self, ids: list, data: np.ndarray, at: np.ndarray, pattern: str) -> None:
        words, counts = pretokens(data, at, pattern)
        # a piece keeps its distinct words only, which take far less than all
        distinct, number = numbered(words)
        self.words.append(distinct)
        self.numbers.append(number.astype(np.min_scalar_type(len(distinct))))
        self.counts.append(counts.astype(np.uint32))
        self.ids.append(ids)
        self.bytes += len(data)

    def close(self) -> tuple[Iterator[np.ndarray], pa.Array]:
        """Its numbers of words by piece, and its words: those of higher frequency first, by powers of two, then in order."""
        sizes = [len(w) for w in self.words]
        held, self.words = pa.concat_arrays(self.words), []
        words, number = numbered(held)
        del held
        number = np.split(number, np.cumsum(sizes)[:-1])
        often = np.zeros(len(words), np.int64)
        for own, v in zip(number, self.numbers, strict=True):
            often[own] += np.bincount(v, minlength=len(own))
        place = pc.sort_indices(words).to_numpy()
        order = place[np.argsort(-np.log2(np.maximum(often[place], 1)).astype(np.int8), kind="stable")]
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        return (rank[own][v] for own, v in zip(number, self.numbers, strict=True)), words.take(pa.array(order))


def blocks_of(batches, id_col: str, text_col: str, pattern: str) -> Iterator[Block]:
    """The batches of a task as blocks."""
    block = Block()
    for rows, data, at in pieces(batches, text_col, PIECE_BYTES):
        if block.bytes and block.bytes + len(data) > BLOCK_BYTES:
            yield block
            block = Block()
        # ids as a list: an Arrow column keeps its whole batch, with all texts
        block.add(rows.column(rows.schema.get_field_index(id_col)).to_pylist(), data, at, pattern)
    if block.ids:
        yield block


PACKED = "key long, part int, payload binary"
PACKED_ARROW = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("payload", pa.binary())])


def packed_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(PACKED_ARROW)], schema=PACKED_ARROW)


def block_key(i: int) -> int:
    """The key of a task's i-th block."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 24 | i


def n_buckets_of(blocks: DataFrame, n_bytes: str = "bytes") -> tuple[int, int]:
    """How many blocks there are, and into how many buckets their texts go."""
    n, total = blocks.select(F.count(n_bytes), F.coalesce(F.sum(n_bytes), F.lit(0))).first()
    partitions = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return n, max(1, -(-total // MOST_SHARE), min(partitions, -(-total // LEAST_SHARE)))


def buckets_of(words: pa.Array, n_buckets: int) -> np.ndarray:
    return (np.fromiter((zlib.crc32(w) for w in words.to_pylist()), np.uint32, len(words)) % np.uint32(n_buckets)).astype(np.uint32)


def packed_words(words: pa.Array) -> bytes:
    data, at = text_buffers(words)
    return pack((coded(np.diff(at)), data.tobytes()), LEVEL)


def unpacked_words(payload: bytes) -> pa.Array:
    sizes, data = unpack(payload)
    at = np.concatenate([[0], np.cumsum(uncoded(sizes))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Each row's id and the ids of its text's tokens."""
    return encoded(docs, path, pattern, id_col, text_col, None, "ids array<int>").toDF(id_col, ids_col)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, use: Callable | None, columns: str) -> DataFrame:
    """id and columns: what use makes of the rows (id, ids) inside the task that puts them together; without use the rows themselves."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = pa_type(docs.schema[id_col].dataType)

    def cut(batches):
        for k, block in enumerate(blocks_of(batches, "id", "text", pattern)):
            key = block_key(k)
            numbers, words = block.close()
            row = lambda part, payload, n_bytes: pa.RecordBatch.from_arrays([*packed_rows([(key, part, payload)]).columns, pa.array([n_bytes], pa.int64())], names=["key", "part", "payload", "bytes"])  # noqa: B023, E731
            yield row(-1, packed_words(words), block.bytes)
            del words
            for i, some in enumerate(itertools.batched(zip(block.ids, block.counts, numbers, strict=True), PIECES)):
                ids, counts, v = zip(*some, strict=True)
                yield row(-2 - i, pack((list(itertools.chain(*ids)), coded(np.concatenate(counts)), coded(np.concatenate(v))), LEVEL), None)

    blocks = staged(source.mapInArrow(tidy(cut), f"{PACKED}, bytes long"), "blocks")
    n_blocks, n_buckets = n_buckets_of(blocks)
    words = blocks.filter("part = -1").select("key", "part", "payload")

    def words_out(batches):
        for batch in batches:
            for key, payload in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = unpacked_words(payload)
                buckets = buckets_of(words, n_buckets)
                order = np.argsort(buckets, kind="stable")
                cuts = np.searchsorted(buckets[order], np.arange(n_buckets + 1))
                for b in np.flatnonzero(cuts[:-1] < cuts[1:]).tolist():
                    yield packed_rows([(key, b, packed_words(words.take(pa.array(order[cuts[b] : cuts[b + 1]]))))])

    def encode_words(batches):
        known: dict[bytes, bytes] = {}
        one = tokenizer(path, pattern)._core_bpe.encode_single_piece
        for batch in batches:
            for key, b, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = []
                for word in unpacked_words(payload).to_pylist():
                    got = known.get(word)
                    if got is None:
                        got = known[word] = np.array(one(word), np.uint32).tobytes()
                    ids.append(got)
                counts = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                yield packed_rows([(key, b, pack((coded(counts), planes(np.frombuffer(b"".join(ids), np.uint32))), LEVEL))])

    def buckets_out(batches):
        for batch in batches:
            for key, payload in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                yield packed_rows([(key, -1, pack(coded(buckets_of(unpacked_words(payload), n_buckets)), LEVEL))])

    out_schema = pa.schema([("id", id_type), ("ids", pa.list_(pa.int32()))])

    def put_together(batches):
        rows: dict[int, bytes] = {}
        for batch in batches:
            rows |= zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        buckets = uncoded(unpack(rows[-1]))
        order = np.argsort(buckets, kind="stable")
        cuts = np.searchsorted(buckets[order], np.arange(n_buckets + 1))
        each = np.zeros(len(buckets), np.int64)
        flat = []
        for b in np.flatnonzero(cuts[:-1] < cuts[1:]).tolist():
            counts, ids = unpack(rows.pop(b))
            each[order[cuts[b] : cuts[b + 1]]] = uncoded(counts)
            flat.append(unplanes(ids))
        flat = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
        begin = np.zeros(len(buckets), np.int64)
        begin[order] = np.cumsum(each[order]) - each[order]
        for part in sorted((p for p in rows if p < -1), reverse=True):
            ids, counts, v = unpack(rows.pop(part))
            v = uncoded(v)
            words_at = np.concatenate([[0], np.cumsum(uncoded(counts).astype(np.int64))])
            for first, last in runs(words_at, WORDS):
                own = v[words_at[first] : words_at[last]]
                sizes = each[own]
                ends = np.cumsum(sizes)
                tokens = flat[np.repeat(begin[own] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
                at = np.concatenate([[0], ends])[words_at[first : last + 1] - words_at[first]].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[first:last], id_type), pa.ListArray.from_arrays(pa.array(at), pa.array(tokens))], schema=out_schema)

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = put_together(batches)
        yield from use(rows) if use else rows

    ids = words.mapInArrow(tidy(words_out), PACKED).repartitionById(n_buckets, F.col("part")).mapInArrow(tidy(encode_words), PACKED)
    layouts = blocks.filter("part < -1").select("key", "part", "payload")
    sent = ids.unionByName(layouts).unionByName(words.mapInArrow(tidy(buckets_out), PACKED))
    id_ddl = docs.schema[id_col].dataType.simpleString()
    # one task for each block or so, however many there are
    return sent.select("key", "part", "payload").repartition(max(1, n_blocks), "key").groupBy("key").applyInArrow(tidy(reassemble), f"id {id_ddl}, {columns}")


def pa_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def id_slices(batch: pa.RecordBatch, column: int, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most that many ids in all (a longer list alone)."""
    at = np.concatenate([[0], np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
    for first, last in runs(at, most):
        yield batch.slice(first, last - first)


def decoded(ids: pa.Array, table: pa.Array) -> pa.Array:
    """The bytes of each list of ids; a null list gives null, and an id that is null or not in the table no bytes."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    flat = ids.flatten()
    flat = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table))), flat, pa.scalar(None, flat.type))
    data, at = text_buffers(table.take(flat))
    sizes = np.asarray(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    cuts = at[np.concatenate([[0], np.cumsum(sizes)])]
    body = data.tobytes()
    gone = ids.is_null().to_pylist() if ids.null_count else [False] * len(ids)
    return pa.array([None if g else body[a:b] for g, a, b in zip(gone, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """The input with the bytes that its ids stand for: ids joined with the token-byte table."""
    kept = [c for c in encoded.columns if c.lower() != bytes_col.lower()]
    schema = T.StructType([*(encoded.schema[c] for c in kept), T.StructField(bytes_col, T.BinaryType())])

    at = kept.index(ids_col)

    def run(batches):
        table = token_bytes(path)
        for batch in batches:
            for rows in id_slices(batch, at):
                yield pa.RecordBatch.from_arrays([*rows.columns, decoded(rows.column(at), table)], names=[*rows.schema.names, "out"])

    return mapped(encoded.select(*map(named, kept)), run, schema)


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digested(path: str) -> Callable:
    """Rows of an id and a list of ids, as the id and DIGESTS."""

    def run(batches):
        table = token_bytes(path)
        names = cached(f"names {path}", lambda: [str(i) for i in range(len(table))])
        sha = hashlib.sha256
        for batch in batches:
            for rows in id_slices(batch, 1):
                ids = rows.column(1)
                lists = [x or [] for x in ids.to_pylist()]
                said = [sha(" ".join(map(names.__getitem__, x)).encode()).hexdigest() for x in lists]
                back = [sha(x or b"").hexdigest() for x in decoded(ids, table).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x) for x in lists], pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, n_tokens, ids_sha256 (decimal ids, one space between) and decoded_sha256."""
    ddl = encoded.schema[id_col].dataType.simpleString()
    out = encoded.select(F.col(id_col).alias("id"), ids_col).mapInArrow(tidy(digested(path)), f"id {ddl}, {DIGESTS}")
    return out.withColumnRenamed("id", id_col)


def encoded_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digests of what encode gives, made where the ids are put together: lists of ids neither leave their worker nor need a second one."""
    return encoded(docs, path, pattern, id_col, text_col, digested(path), DIGESTS).withColumnRenamed("id", id_col)
