"""Repeated passages by content-defined chunking.

A gear rolling hash over the last 16 bytes sets the cuts: a cut stands behind the least hash of every ``MOST``
positions of a text, so an insertion moves only the cuts near it, and no chunk is longer than two spans. White space counts as one
blank, however it breaks. Each chunk runs from a cut to the second cut after it, so chunks overlap by half. Chunks
are deduplicated by digest over the whole corpus: a block of documents sends each distinct digest once to the
bucket of its value, and gets back which stand elsewhere, and in which document first. No key is hot, however often a
passage occurs, and the number of buckets follows from the size of the texts.

Shared chunks lead to passages. Inside a text that stands twice, all cuts that are a span and a hash away from its ends
are alike in both places, so all chunks between them are shared. A window of ``min_words`` words is a candidate if all its
inner chunks are shared; one too short to be sure of an inner chunk is always one, so none is missed. Only candidates are
compared: their digests go the way of the chunks, and each stretch of windows that stand in two documents, or twice apart in one, is told as
passages, each of at least ``min_words`` words and whole in the first document of its windows. Where a stretch goes on
in another first document, or may go on elsewhere in it, a passage ends and the next overlaps it. The first and the
last word of a window are compared without the punctuation on their outer side. ``deduplicated`` cuts out, or
masks, all but the first copy of each passage.

Defined results: null and empty text has no chunks; texts of any length are read whole; repeated rows are two
documents with one id, and neither is a later copy of the other; ids may have any type with an order, and a null
id sorts first; what stands in several documents is first in that with the least id; an empty table gives an empty
table; further columns are left out of ``repeats`` and kept by ``deduplicated``, whatever their names. Texts are staged once, as blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import named, unused
from ..functions.staging import staged
from .arrow_text import binary_array, coded, digest64, mixed, pack, pieces, planes, spans_of, tidy, uncoded, unpack, unplanes
from .byte_bpe import PACKED, pa_type, packed_rows
from .setsketch import marked, marks_of

#: Bytes that set a hash; positions of which the least hash is a cut, so that two cuts are at most as far apart.
WINDOW, MOST = 16, 36
#: Bytes of text of a block, at most, but for a longer single batch.
BLOCK_BYTES = 24 << 20
#: Bytes of text whose digests are in a bucket, at least and at most.
LEAST_SHARE, MOST_SHARE = 4 << 20, 24 << 20
#: Bytes of text whose windows a task makes at a time.
PIECE_BYTES = 4 << 20
#: A passage has over 50 words.
MIN_WORDS = 51
#: Its powers tell apart the places of words in a window, and of bytes in a chunk.
ODD = 0x9E3779B97F4A7C15
#: What may stand around the first and last word of a passage.
AROUND = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "¡¿«»“”‘’…–—"


def gear() -> np.ndarray:
    """A random value for each byte."""
    return (mixed(np.arange(1, 257, dtype=np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def extreme_of(values: np.ndarray, n: int, pick) -> np.ndarray:
    """What pick, np.minimum or np.maximum, leaves of each n values in a row."""
    step = 1
    out = values
    while step * 2 <= n:
        out = pick(out[:-step], out[step:])
        step *= 2
    k = len(values) - n + 1
    return pick(out[:k], out[n - step : n - step + k])


def cuts_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sorted offsets of all cuts of the texts, with the start and the end of each text that has bytes."""
    if not len(data):
        return np.zeros(0, np.int64)
    into = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    h = gear()[data]
    for w in (1, 2, 4, 8):
        older = h[:-w] << np.uint16(w)
        older[into[w:] < w] = 0
        h[w:] = h[w:] + older
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    if len(data) >= MOST:
        low = extreme_of(h, MOST, np.minimum)
        low[np.repeat(at[1:], np.diff(at))[: len(low)] < np.arange(len(low)) + MOST] = 0  # spans over the end of a text
        # a position is the least of a span if it equals the greatest of the least values of all spans with it
        around = np.zeros(len(data) + MOST - 1, low.dtype)
        around[MOST - 1 : MOST - 1 + len(low)] = low
        cut[1:] |= extreme_of(around, MOST, np.maximum) == h
    return np.flatnonzero(cut)


def chunks_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the chunks and the text of each: from a cut to the second cut after it, or to the text's end."""
    cuts = cuts_of(data, at)
    starts = cuts[:-1]
    doc = np.searchsorted(at, starts, side="right") - 1
    ends = np.minimum(np.append(cuts[2:], cuts[-1:])[: len(starts)], at[doc + 1])
    return starts, ends, doc


def digests_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of the bytes of each chunk: sums of random values of bytes times powers of an odd number, brought to one place."""
    power, back = (np.cumprod(np.full(len(data) + 1, b, np.uint64), dtype=np.uint64) for b in (ODD, pow(ODD, -1, 1 << 64)))
    values = mixed(np.arange(1, 257, dtype=np.uint64))
    added = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * power[: len(data)], dtype=np.uint64)])
    return mixed((added[ends] - added[starts]) * back[starts] + mixed((ends - starts).astype(np.uint64)))


def evened(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with each run of white space as one blank, their offsets, and where each byte stood."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    kept = np.ones(len(data), bool)
    kept[1:] = ~(space[1:] & space[:-1])
    edges = at[:-1][at[:-1] < len(data)]
    kept[edges] = True
    place = np.flatnonzero(kept)
    return np.where(space[place], np.uint8(32), data[place]), np.searchsorted(place, at), place


def windows_of(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of n words of one text: its digest, its text, the offsets where it starts and ends, and the digest of the words inside it."""
    starts, ends = spans_of(~((data == 32) | ((data >= 9) & (data <= 13))), at)
    if len(starts) < n:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64)
    coded = binary_array(data, starts, ends).dictionary_encode()
    number = coded.indices.to_numpy()
    plain = coded.dictionary.to_pylist()
    texts = [w.decode() for w in plain]
    left, right = ([f(w, AROUND).encode() or x for w, x in zip(texts, plain, strict=True)] for f in (str.lstrip, str.rstrip))
    size = np.array([len(w) for w in plain], np.int64)
    lead, tail = (size - np.array([len(w) for w in side], np.int64) for side in (left, right))
    # sums of digests times powers of an odd number, which powers of its inverse bring to the same place
    power, back = (np.cumprod(np.full(len(starts), b, np.uint64), dtype=np.uint64) for b in (ODD, pow(ODD, -1, 1 << 64)))
    added = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(digest64(plain))[number] * power, dtype=np.uint64)])
    doc = np.searchsorted(at, starts, side="right") - 1
    i = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1])
    z = i + n - 1
    inner = (added[np.maximum(z, i + 1)] - added[i + 1]) * back[i]
    first, last = mixed(digest64(left)), mixed(digest64(right) ^ np.uint64(0x5555555555555555))
    return mixed(mixed(inner + first[number[i]]) + last[number[z]]), doc[i], starts[i] + lead[number[i]], ends[z] - tail[number[z]], inner


def again(inner: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the words inside a window stand at another place of its text too: what follows on it there may not follow here."""
    keyed = inner ^ mixed(doc.astype(np.uint64))
    order = np.sort(keyed)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keyed), bool)
    return twice[np.searchsorted(twice, keyed).clip(max=len(twice) - 1)] == keyed


def grouped(digests: np.ndarray, docs: np.ndarray, own: np.ndarray, unsure: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct digests, whether two documents have each, and twice the least id's rank, and one if unsure there; docs ascend."""
    order = np.argsort(digests, kind="stable")
    digests, docs = digests[order], docs[order]
    new = np.ones(len(order), bool)
    new[1:] = digests[1:] != digests[:-1]
    at = np.flatnonzero(new)
    if not len(at):
        return digests, np.zeros(0, bool), np.zeros(0, np.int64)
    last = np.append(at[1:], len(docs)) - 1
    ranks = own[docs]
    least = np.minimum.reduceat(ranks, at)
    held = ranks == least[np.cumsum(new) - 1]
    # two documents with the least id may each have a part of what follows
    low, high = (f.reduceat(np.where(held, docs, none), at) for f, none in ((np.minimum, np.iinfo(docs.dtype).max), (np.maximum, 0)))
    shaky = np.maximum.reduceat(held & unsure[order], at) | (low != high)
    return digests[at], docs[at] != docs[last], 2 * least + shaky


class Block:
    """Documents of one part of the input: their ids, hashes and texts."""

    def __init__(self):
        self.ids, self.hashes, self.texts, self.sizes, self.bytes = [], [], [], [], 0

    def add(self, ids: pa.Array, hashes: pa.Array, data: np.ndarray, at: np.ndarray) -> None:
        self.ids += ids.to_pylist()
        self.hashes += hashes.to_pylist()
        self.texts.append(data.tobytes())
        self.sizes.append(np.diff(at))
        self.bytes += len(data)

    def packed(self) -> tuple[int, int, bytes]:
        """Its row: the key is what its rows are, so blocks of equal rows share it."""
        key = int(np.uint64(xxhash.xxh3_64_intdigest(np.array(self.hashes, np.int64).tobytes())).astype(np.int64))
        return key, -1, pack((self.ids, self.hashes, np.concatenate(self.sizes), b"".join(self.texts)))


def blocks_of(batches) -> Iterator[pa.RecordBatch]:
    block = Block()
    for rows, data, at in pieces(batches, "text"):
        if block.bytes and block.bytes + len(data) > BLOCK_BYTES:
            yield packed_rows([block.packed()])
            block = Block()
        block.add(rows.column(0), rows.column(2), data, at)
    if block.ids:
        yield packed_rows([block.packed()])


def texts_of(payload: bytes) -> tuple[list, list, list]:
    """Ids and hashes of a block, and its texts in runs: number of the first, bytes, offsets."""
    ids, hashes, sizes, body = unpack(payload)
    at = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(body, np.uint8)
    runs, first = [], 0
    while first < len(ids):
        last = max(first + 1, int(np.searchsorted(at, at[first] + PIECE_BYTES, side="right")) - 1)
        runs.append((first, data[at[first] : at[last]], at[first : last + 1] - at[first]))
        first = last
    return ids, hashes, runs


def chunks_of_block(runs: list) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """The chunks of each run (starts, ends), the document of each chunk, the distinct digests, and each chunk's number among them."""
    placed, docs, digests = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for first, data, at in runs:
        even, even_at, _ = evened(data, at)
        starts, ends, doc = chunks_of(even, even_at)
        placed.append((starts, ends))
        docs.append(doc + first)
        digests.append(digests_of(even, starts, ends))
    distinct, number = np.unique(np.concatenate(digests), return_inverse=True)
    return placed, np.concatenate(docs), distinct, number.ravel()


#: A window of so many bytes, white space evened, has two cuts beside its inner one that its bytes alone set; a run of
#: chunks inside it may fall short of it by so many.
SURE, OUTSIDE = 5 * MOST + WINDOW - 3, 4 * MOST + WINDOW - 3


def promising(data: np.ndarray, at: np.ndarray, chunks: tuple[np.ndarray, np.ndarray], doc: np.ndarray, shared: np.ndarray, n: int) -> np.ndarray:
    """Which texts may have candidates: those with a run of shared chunks long enough for one of their windows, or with a window too short to be sure of a chunk."""
    starts, ends = spans_of(~((data == 32) | ((data >= 9) & (data <= 13))), at)
    out = np.zeros(len(at) - 1, bool)
    if len(starts) < n:
        return out
    of = np.searchsorted(at, starts, side="right") - 1
    long = np.concatenate([[0], np.cumsum(ends - starts)])
    i = np.flatnonzero(of[n - 1 :] == of[: len(of) - n + 1])
    size = long[i + n - 1] - long[i + 1] + n - 1  # between the first and the last word
    least = np.full(len(out), np.iinfo(np.int64).max)
    np.minimum.at(least, of[i], size)
    most = np.zeros(len(out), np.int64)
    a, z = spans_of(shared, np.searchsorted(doc, np.arange(len(out) + 1)))
    np.maximum.at(most, doc[a], chunks[1][z - 1] - chunks[0][a])
    return (least < SURE) | ((least < np.iinfo(np.int64).max) & (most >= least - OUTSIDE))


def candidates(data: np.ndarray, at: np.ndarray, chunks: tuple[np.ndarray, np.ndarray], shared: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Digest, text, start, end and inner digest, as windows_of tells them, of all windows of the texts that have a candidate,
    and which are candidates. chunks: starts and ends in the evened texts; shared: whether each stands at another place too."""
    _, even_at, place = evened(data, at)
    starts, ends = chunks
    doc = np.searchsorted(even_at, starts, side="right") - 1
    some = promising(data, at, chunks, doc, shared, n)
    number = np.flatnonzero(some)
    # from here on only these texts, laid end to end
    kept = np.repeat(some, np.diff(at))
    gone = np.cumsum(np.where(some, 0, np.diff(at)))
    own_at = np.concatenate([[0], np.cumsum(np.diff(at)[some])])
    window, of, begin, end, inner = windows_of(data[kept], own_at, n)
    of = number[of]
    begin, end = begin + gone[of], end + gone[of]
    first, last = np.searchsorted(place, begin), np.searchsorted(place, end - 1) + 1
    # cuts from here to there are set by bytes of the window alone
    a = np.searchsorted(starts, first + MOST + WINDOW - 1)
    z = np.maximum(a, np.searchsorted(ends, last - MOST + 1, side="right"))
    missing = np.concatenate([[0], np.cumsum(~shared)])
    hit = missing[z] == missing[a]
    some = np.zeros(len(at), bool)
    some[of[hit]] = True
    kept = some[of]
    return window[kept], of[kept], begin[kept], end[kept], inner[kept], hit[kept]


def plain_ids(ids: list):
    """The distinct ids but null, in their order: an array if they are whole numbers."""
    plain = sorted({i for i in ids if i is not None})
    return np.array(plain, np.int64) if all(type(x) is int and -(1 << 63) <= x < 1 << 63 for x in plain) else plain


def ranks_of(ids: list, plain) -> np.ndarray:
    """The place of each id in plain, from 1; 0 for null."""
    number = {x: k for k, x in enumerate(plain.tolist() if isinstance(plain, np.ndarray) else plain, 1)}
    return np.fromiter((0 if i is None else number[i] for i in ids), np.int64, len(ids))


def chosen(plain, *ranks: np.ndarray) -> tuple:
    """What any of the ranks name, packed, and the ranks among that; 0 stays null."""
    used, place = np.unique(np.concatenate([np.zeros(1, np.int64), *ranks]), return_inverse=True)
    if isinstance(plain, np.ndarray):
        named = np.diff(plain[used[1:] - 1], prepend=np.zeros(1, np.int64))
    else:
        named = [plain[k - 1] for k in used[1:].tolist()]
    return named, *map(coded, np.split(place.ravel()[1:], np.cumsum([len(r) for r in ranks])[:-1]))


def chosen_back(packed: tuple) -> tuple:
    """The ids, and the ranks among them."""
    named, *ranks = packed
    return np.cumsum(named) if isinstance(named, np.ndarray) else named, *(uncoded(r).astype(np.int64) for r in ranks)


def together(parts: list) -> tuple:
    """The distinct ids of several lists in their order, and the ranks among these of each list's ranks."""
    if all(isinstance(x, np.ndarray) for x in parts):
        plain = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]))
        return plain, [np.concatenate([[0], np.searchsorted(plain, x) + 1]) for x in parts]
    parts = [x.tolist() if isinstance(x, np.ndarray) else x for x in parts]  # one without any id may be an array
    plain = sorted({i for x in parts for i in x})
    return plain, [np.concatenate([[0], ranks_of(x, plain)]) for x in parts]


def spread(values: np.ndarray) -> tuple[int, bytes]:
    """Ascending 64-bit values as the byte planes of their steps, which compress better."""
    steps = np.diff(values, prepend=np.zeros(1, np.uint64))
    return len(values), np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unspread(packed: tuple[int, bytes]) -> np.ndarray:
    n, data = packed
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)


def bucket_cuts(distinct: np.ndarray, n: int) -> np.ndarray:
    """Buckets are ranges of the digests' values: where each begins among the sorted digests."""
    edges = [(i << 64) // n for i in range(n)]
    return np.append(np.searchsorted(distinct, np.array(edges, np.uint64)), len(distinct))


def first_and_last(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands for the first and for the last time."""
    _, first, back = np.unique(values, return_index=True, return_inverse=True)
    back = back.ravel()
    last = np.zeros(len(first), np.int64)
    np.maximum.at(last, back, np.arange(len(values)))
    return first[back], last[back]


def passages_of(hit: np.ndarray, others: np.ndarray, source: np.ndarray, shaky: np.ndarray, later: np.ndarray, first_at: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Of one document's windows, the stretches that are passages: first window, and the one after the last.

    others: whether other documents have the window; source: rank of the first document, -1 for this one; later: whether the window stands in this document before, apart, at first_at.
    """
    follows = hit[1:] & hit[:-1] & (others[1:] == others[:-1]) & (source[1:] == source[:-1]) & (later[1:] == later[:-1])
    inside = source[1:] == -1
    follows &= np.where(inside, ~later[1:] | (first_at[1:] == first_at[:-1] + 1), ~shaky[:-1])
    edge = np.flatnonzero(np.concatenate([hit[:1], hit[1:] & ~follows]))
    stop = np.flatnonzero(np.concatenate([hit[:-1] & ~follows, hit[-1:]])) + 1
    i = 0
    while i < len(edge):
        yield int(edge[i]), int(stop[i])
        # of passages that begin before the words of this one end, all but the last are inside the two
        j = int(np.searchsorted(edge, stop[i] - 1 + n, side="right")) - 1
        i = max(i + 1, j) if j > i and stop[j] > stop[i] else i + 1


def _repeats(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """What repeats returns, with the hash of id and text."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col, text_col).alias("hash"))
    source = source.withColumn("bytes", F.octet_length("text"))
    size = Observation()
    blocks = staged(source.observe(size, F.coalesce(F.sum("bytes"), F.lit(0)).alias("total")).select("id", "text", "hash").mapInArrow(tidy(blocks_of), PACKED), "blocks")
    total = size.get["total"]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(1, -(-total // MOST_SHARE), min(partitions, -(-total // LEAST_SHARE)))
    n_groups = max(1, -(-2 * total // BLOCK_BYTES))  # one task for each block or so, however many there are
    id_type = pa_type(docs.schema[id_col].dataType)

    def chunks_out(batches):
        for batch in batches:
            for key, payload in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                ids, _, runs = texts_of(payload.as_py())
                _, doc, distinct, number = chunks_of_block(runs)
                plain = plain_ids(ids)
                own = ranks_of(ids, plain)
                pairs = np.unique(number.astype(np.int64) * len(ids) + doc)
                held = np.bincount(pairs // len(ids), minlength=len(distinct)).astype(np.uint32)
                twice = np.bincount(number, minlength=len(distinct)) > 1
                least = np.full(len(distinct), np.iinfo(np.int64).max)
                np.minimum.at(least, pairs // len(ids), own[pairs % len(ids)])
                cuts = bucket_cuts(distinct, n_buckets)
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    s = slice(cuts[b], cuts[b + 1])
                    yield packed_rows([(key, b, pack((spread(distinct[s]), coded(held[s]), np.packbits(twice[s]), chosen(plain, least[s]))))])

    def parts_of(batches, answer):
        got: dict[int, list] = {}
        for batch in batches:
            for key, part, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got.setdefault(part, []).append((key, payload))
        for part in sorted(got):
            yield from answer(part, got.pop(part))

    def chunk_answers(batches):
        yield from parts_of(batches, chunk_answer)

    def chunk_answer(part: int, rows: list) -> Iterator[pa.RecordBatch]:
        chunks, held, twice, least, names = ([] for _ in range(5))
        for _, payload in rows:
            a, h, t, named = unpack(payload)
            ids, x = chosen_back(named)
            chunks.append(unspread(a))
            held.append(uncoded(h))
            twice.append(np.unpackbits(t, count=len(chunks[-1])))
            least.append(x)
            names.append(ids)
        plain, to = together(names)
        digests, number = np.unique(np.concatenate(chunks), return_inverse=True)
        number = number.ravel()
        many = np.bincount(number, weights=np.concatenate(held), minlength=len(digests)) > 1
        elsewhere = many | (np.bincount(number, weights=np.concatenate(twice), minlength=len(digests)) > 0)
        first = np.full(len(digests), np.iinfo(np.int64).max)
        np.minimum.at(first, number, np.concatenate([t[x] for t, x in zip(to, least, strict=True)]))
        i = 0
        for (key, _), c in zip(rows, chunks, strict=True):
            mine = number[i : i + len(c)]
            i += len(c)
            yield packed_rows([(key, part, pack((len(c), np.packbits(elsewhere[mine]), np.packbits(many[mine]), chosen(plain, first[mine[many[mine]]]))))])

    def led(batches) -> tuple:
        """A block with the answers to its chunks: how often it came, ids, hashes, ranks of all ids, counts of chunks, and its candidates."""
        rows: dict[int, bytes] = {}
        copies = 0
        for batch in batches:
            rows |= zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            copies += batch.column(1).to_pylist().count(-1)
        ids, hashes, runs = texts_of(rows.pop(-1))
        placed, doc, distinct, number = chunks_of_block(runs)
        there, many, first, names = [], [], [], []
        for b in sorted(rows):
            n, bits, docs_bits, packed_ids = unpack(rows.pop(b))
            ids_there, x = chosen_back(packed_ids)
            there.append(np.unpackbits(bits, count=n).astype(bool))
            many.append(np.unpackbits(docs_bits, count=n).astype(bool))
            first.append(x)
            names.append(ids_there)
        mine = plain_ids(ids)
        _, to = together([mine, *names])
        own = to[0][ranks_of(ids, mine)]
        none = np.zeros(0, bool)
        there, often = (np.concatenate([none, *x])[number] for x in (there, many))
        least = np.zeros(len(distinct), np.int64)
        least[np.concatenate([none, *many])] = np.concatenate([np.zeros(0, np.int64), *(t[x] for t, x in zip(to[1:], first, strict=True))])
        count = lambda mask: np.bincount(doc[mask], minlength=len(ids))[: len(ids)].astype(np.int64)
        counts = [count(np.ones(len(doc), bool)), count(often), count(often & (least[number] < own[doc] if len(doc) else often))]
        windows, at = [], 0
        for (lead, data, offsets), (starts, ends) in zip(runs, placed, strict=True):
            window, of, begin, end, inner, hit = candidates(data, offsets, (starts, ends), there[at : at + len(starts)], min_words)
            at += len(starts)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            base = points[offsets[:-1]][of] if len(of) else of
            place = ((points[x] - base).astype(np.uint32) for x in (begin, end))
            windows.append((window, (of + lead).astype(np.uint32), *place, again(inner, of), hit))
        empty = (np.zeros(0, np.uint64), *(np.zeros(0, np.uint32) for _ in range(3)), none, none)
        return copies, ids, hashes, counts, tuple(np.concatenate(x) for x in zip(empty, *windows, strict=True))

    def windows_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        key = batches[0].column(0)[0].as_py()
        copies, ids, _, _, (window, of, _, _, shaky, hit) = led(batches)
        plain = plain_ids(ids)
        own = ranks_of(ids, plain)
        digests, twice, low = grouped(window[hit], of[hit], own, shaky[hit])
        cuts = bucket_cuts(digests, n_buckets)
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            w = slice(cuts[b], cuts[b + 1])
            row = (key, b, pack((spread(digests[w]), chosen(plain, low[w] >> 1), np.packbits(twice[w]), np.packbits(low[w] & 1 > 0))))
            yield packed_rows([row] * copies)

    def window_answers(batches):
        yield from parts_of(batches, window_answer)

    def window_answer(part: int, rows: list) -> Iterator[pa.RecordBatch]:
        windows, twice, low, names = ([] for _ in range(4))
        for _, payload in rows:
            w, named, t, u = unpack(payload)
            ids, y = chosen_back(named)
            windows.append(unspread(w))
            twice.append(np.unpackbits(t, count=len(windows[-1])))
            low.append((y, np.unpackbits(u, count=len(windows[-1]))))
            names.append(ids)
        plain, to = together(names)
        known, place = np.unique(np.concatenate(windows), return_inverse=True)
        place = place.ravel()
        common = np.bincount(place, weights=1 + np.concatenate(twice), minlength=len(known)) > 1
        source = np.full(len(known), np.iinfo(np.int64).max)
        own = np.concatenate([2 * t[y] + u for t, (y, u) in zip(to, low, strict=True)])
        np.minimum.at(source, place, own)
        shaky = np.bincount(place, weights=own >> 1 == source[place] >> 1, minlength=len(known)) > 1  # the least id in two blocks
        j = 0
        for (key, _), w in zip(rows, windows, strict=True):
            at = place[j : j + len(w)]
            j += len(w)
            hit = common[at]
            of = source[at[hit]]
            yield packed_rows([(key, part, pack((len(w), np.packbits(hit), chosen(plain, of >> 1), np.packbits((of & 1 > 0) | shaky[at[hit]]))))])

    def layouts_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        key = batches[0].column(0)[0].as_py()
        copies, ids, hashes, counts, (window, of, begin, end, _, hit) = led(batches)
        _, place = np.unique(window[hit], return_inverse=True)
        steps = [coded(np.diff(x, prepend=np.zeros(1, np.uint32))) for x in (of, begin[hit], end[hit])]
        yield packed_rows([(key, -1, pack((ids, hashes, counts, np.packbits(hit), planes(place.ravel()), *steps)))] * copies)

    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64()), ("first_id", id_type), ("copy", pa.bool_()), ("others", pa.bool_())])
    out_schema = pa.schema([("id", id_type), ("hash", pa.int64()), ("n_chunks", pa.int64()), ("n_shared", pa.int64()), ("n_copied", pa.int64()), ("passages", pa.list_(passage))])

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, bytes] = {}
        copies = 0
        for batch in batches:
            rows |= zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            copies += batch.column(1).to_pylist().count(-1)
        ids, hashes, counts, led_to, place, *steps = unpack(rows.pop(-1))
        n = len(ids)
        of, begin, stop = (np.cumsum(uncoded(x), dtype=np.uint32).astype(np.int64) for x in steps)
        led_to = np.unpackbits(led_to, count=len(of)).astype(bool)
        distinct, source, unsure, named = [], [], [], []
        for b in sorted(rows):
            n_windows, bits, ranks, shaky = unpack(rows.pop(b))
            names, low = chosen_back(ranks)
            named.append(names)
            hit = np.unpackbits(bits, count=n_windows).astype(bool)
            distinct.append(hit)
            source.append(low)
            unsure.append(np.unpackbits(shaky, count=int(hit.sum())))
        mine = plain_ids(ids)
        plain, to = together([mine, *named])
        own, to = to[0][ranks_of(ids, mine)], to[1:]
        found: list[list] = [[] for _ in range(n)]
        said = [None, *(plain.tolist() if isinstance(plain, np.ndarray) else plain)]
        if led_to.any():
            known = np.concatenate(distinct)
            from_, doubt = np.zeros(len(known), np.int64), np.zeros(len(known), bool)
            from_[known] = np.concatenate([t[x] for t, x in zip(to, source, strict=True)])
            doubt[known] = np.concatenate(unsure)
            place = unplanes(place).astype(np.int64)

            def all_windows(values: np.ndarray, rest) -> np.ndarray:
                out = np.full(len(of), rest, values.dtype) if np.isscalar(rest) else rest.astype(values.dtype)
                out[led_to] = values
                return out

            # windows that are no candidates stand nowhere else: each has a place of its own
            hit, from_, shaky = all_windows(known[place], False), all_windows(from_[place], 0), all_windows(doubt[place], False)
            start, end = all_windows(begin, 0), all_windows(stop, 0)
            place = all_windows(place, len(known) + np.arange(len(of)))
            edges = np.append(np.searchsorted(of, np.arange(n)), len(of))
            pairs = np.sort(of * (int(place.max()) + 1) + place)
            twice = pairs[1:][pairs[1:] == pairs[:-1]] // (int(place.max()) + 1)
            for d in np.union1d(of[hit], twice).tolist():
                a, z = edges[d], edges[d + 1]
                first_at, last_at = first_and_last(place[a:z])
                later = np.arange(z - a) - first_at >= min_words
                others, inner = hit[a:z], (from_[a:z] == own[d]) | ~hit[a:z]
                told = others | (last_at - first_at >= min_words)
                for x, y in passages_of(told, others, np.where(inner, -1, from_[a:z]), shaky[a:z], later & inner, first_at, min_words):
                    k = a + x
                    found[d].append({
                        "start": int(start[k]), "end": int(end[a + y - 1]), "words": y - x - 1 + min_words, "first_id": ids[d] if inner[x] else said[from_[k]],
                        "copy": bool(later[x] if inner[x] else True), "others": bool(others[x]),
                    })
        for _ in range(copies):
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(hashes, pa.int64()), *map(pa.array, counts), pa.array(found, pa.list_(passage))], schema=out_schema)

    def by_key(rows: DataFrame, run, ddl: str) -> DataFrame:
        return rows.select("key", "part", "payload").repartition(n_groups, "key").groupBy("key").applyInArrow(run, ddl)

    answered = blocks.mapInArrow(tidy(chunks_out), PACKED).repartitionById(n_buckets, F.col("part")).mapInArrow(tidy(chunk_answers), PACKED)
    with_answers = answered.unionByName(blocks)
    compared = by_key(with_answers, windows_out, PACKED).repartitionById(n_buckets, F.col("part")).mapInArrow(tidy(window_answers), PACKED)
    ddl = docs.schema[id_col].dataType.simpleString()
    return by_key(
        compared.unionByName(by_key(with_answers, layouts_out, PACKED)), reassemble,
        f"id {ddl}, hash long, n_chunks long, n_shared long, n_copied long, passages array<struct<start: long, end: long, words: long, first_id: {ddl}, copy: boolean, others: boolean>>",
    )


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each row: id_col, n_chunks, n_shared (chunks that other documents have too), n_copied (those of
    which an earlier document holds the first copy), and passages: array of (start, end, words, first_id, copy, others), in code points; copy: whether it is
    not the first; others: whether other documents hold it, or it stands twice in this one alone."""
    return _repeats(docs, id_col, text_col, min_words).drop("hash").withColumnRenamed("id", id_col)


def without(text: Column, spans: Column, mark: str) -> Column:
    """The text with each stretch of spans (start, end, by their starts) that touch or overlap replaced by mark."""

    def step(a: Column, s: Column) -> Column:
        more = F.concat(a["text"], text.substr((a["end"] + 1).cast("int"), (s["start"] - a["end"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(a["end"], s["end"]).alias("end"), F.when((s["start"] <= a["end"]) & a["any"], a["text"]).otherwise(more).alias("text"), F.lit(True).alias("any"))

    begin = F.struct(F.lit(0).cast("long").alias("end"), F.lit("").alias("text"), F.lit(False).alias("any"))
    return F.aggregate(spans, begin, step, lambda a: F.concat(a["text"], text.substr((a["end"] + 1).cast("int"), F.length(text))))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, mark: str = "") -> DataFrame:
    """docs with all but the first copy of each passage replaced by mark. Only texts that hold such copies are looked up by a shuffle."""
    found = _repeats(docs, id_col, text_col, min_words).select("hash", F.filter("passages", lambda p: p["copy"]).alias("spans"))
    found = found.filter(F.size("spans") > 0).groupBy("hash").agg(F.min(F.transform("spans", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))).alias("spans"))
    found = staged(found, "copies")
    hash_col, hit, of, spans = unused(docs.columns, "hash", "hit", "of", "spans")
    own = marked(docs.withColumn(hash_col, F.xxhash64(id_col, text_col)), hash_col, marks_of(found), hit)
    seen = own.filter(hit).join(found.select(F.col("hash").alias(of), F.col("spans").alias(spans)), F.col(hash_col) == F.col(of), "left")
    text = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(without(F.col(text_col), F.col(spans), mark))
    cut = seen.select(*(text.alias(c) if c == text_col else named(c) for c in docs.columns))
    return own.filter(~F.col(hit)).select(*(named(c) for c in docs.columns)).unionAll(cut)
