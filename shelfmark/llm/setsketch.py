"""Near-duplicate groups by SetSketch registers.

A register is the least of exponentially distributed hash values of a set, kept as a
truncated logarithm to a base near 1. Registers of a union are the larger ones of
both, and equal registers grow likelier with similarity, so bands of registers find
candidates. Candidates are first held against a maximum-likelihood estimate from
both sketches and both set sizes, then against the full sets.

Equal sets form one class. In each bucket of a band, the class with the most company
is held against the others, and linked classes are joined to groups. What is left to compare
are classes of one bucket in different groups. Two of these can only be linked if what tells them from the
bucket's first class overlaps enough, so a prefix of that, rarest items first, leads to the pairs:
no link between groups is lost, and no pairs within a group are made.

Texts are not shuffled, but those that have to be compared: a table of bits, of bounded size, marks these by a
hash of id and text, and what is marked is then looked up exactly.

Defined results: null and empty texts, and texts without words, are linked with nothing; texts of any
length are read whole; ids may have any type with an order; repeated rows are copies; rows with a null id join
groups but never name them, and a group of null ids alone has a null component; an empty table gives an
empty table; further columns are left out, so their names cannot clash. ``deduplicated`` keeps all columns
as they are; of rows equal in id and text the one that comes first as JSON stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import named, unused
from ..functions.staging import staged, temporary_tables
from .arrow_text import binary_array, digest64, lower_ascii, mixed, pieces, spans_of, tidy

SHINGLE = 5
#: Registers, registers of a band, and the sketch's base, rate and largest value but one.
REGISTERS, BAND, BASE, RATE, LIMIT = 120, 5, 1.001, 20.0, (1 << 16) - 2
#: Pairs estimated this far below the threshold (six standard errors) are not verified.
MARGIN = 0.2


def odd_constants(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(n, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of each text and their number by text."""
    data = lower_ascii(data)
    starts, ends = spans_of(~((data == 32) | ((data >= 9) & (data <= 13))), at)
    coded = binary_array(data, starts, ends).dictionary_encode()
    word = digest64(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(starts) else np.zeros(0, np.uint64)
    n_docs = len(at) - 1
    first = np.searchsorted(starts, at[:-1])
    n_words = np.diff(np.append(first, len(starts)))
    factors = odd_constants(SHINGLE, 1)
    padded = np.append(word, np.zeros(SHINGLE - 1, np.uint64))
    hashes = np.zeros(len(word), np.uint64)
    doc = np.repeat(np.arange(n_docs), n_words)
    ahead = np.append(doc, np.full(SHINGLE - 1, -1))
    for k in range(SHINGLE):
        same = ahead[k : k + len(word)] == doc
        hashes += np.where(same, padded[k : k + len(word)] * factors[k], np.uint64(0))
    short = n_words < SHINGLE
    hashes += np.where(short[doc], n_words[doc].astype(np.uint64) * odd_constants(1, 2)[0], np.uint64(0)) if len(doc) else hashes
    into = np.arange(len(word)) - first[doc] if len(doc) else np.zeros(0, np.int64)
    kept = into < np.where(short, np.minimum(n_words, 1), n_words - SHINGLE + 1)[doc] if len(doc) else np.zeros(0, bool)
    hashes, doc = mixed(hashes[kept]), doc[kept]
    keyed = hashes ^ mixed(doc.astype(np.uint64))
    order = np.argsort(keyed)
    new = np.ones(len(order), bool)
    new[1:] = keyed[order][1:] != keyed[order][:-1]
    unique = np.zeros(len(order), bool)
    unique[order[new]] = True
    return hashes[unique], np.bincount(doc[unique], minlength=n_docs)


def by_doc(ufunc, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return ufunc.reduceat(values, first) if len(first) else values[:0]


def sketches(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The registers of each non-empty set, as rows of uint16."""
    a, b = odd_constants(REGISTERS, 3), odd_constants(REGISTERS, 4)
    out = np.zeros((len(sizes), REGISTERS), np.uint64)
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):  # a few sets at a time, so that their hashes stay in the cache
        base = ends[i] - sizes[i]
        j = max(i + 1, int(np.searchsorted(ends, base + 32768, side="right")))
        own, first = hashes[base : ends[j - 1]], (ends[i:j] - sizes[i:j] - base)
        for r in range(REGISTERS):
            out[i:j, r] = np.minimum.reduceat(own * a[r] + b[r], first)
        i = j
    least = -np.log1p(-((out.astype(np.float64) + 0.5) / 2.0**64).clip(0, 1 - 2**-53)) / RATE
    return np.clip(np.floor(1 - np.log(least.clip(1e-300)) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def estimate(u: np.ndarray, v: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, steps: int = 128) -> np.ndarray:
    """The likeliest similarity of each pair, given both sketches and both sizes."""
    up, down = (u > v).sum(1), (u < v).sum(1)
    same = u.shape[1] - up - down
    x = n_u / (n_u + n_v)
    y = 1 - x
    most = np.minimum(x / y, y / x)
    j = most[:, None] * np.linspace(0, 1, steps)[None, :]
    p = lambda z: -np.log1p(-z.clip(0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    a, b = p(x[:, None] - y[:, None] * j), p(y[:, None] - x[:, None] * j)
    log = lambda z: np.log(z.clip(1e-12))
    fit = up[:, None] * log(a) + down[:, None] * log(b) + same[:, None] * log(1 - a - b)
    return j[np.arange(len(j)), fit.argmax(1)]


def fixed(rows: np.ndarray) -> pa.Array:
    """Rows of equal bytes as Arrow binary values."""
    rows = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0), np.uint8)
    offsets = (np.arange(len(rows) + 1) * (rows.shape[1] if len(rows) else 0)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def set_digests(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits of each non-empty set that don't depend on the order of its members."""
    sums = [by_doc(np.add, mixed(hashes ^ c), first) for c in odd_constants(2, 5)]
    return np.stack(sums, 1) if len(first) else np.zeros((0, 2), np.uint64)


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, hash (of id and text), n (set size), d (digest of the set, null if empty), registers."""

    def run(batches):
        for rows, data, at in pieces(batches, "text", 2 << 20):
            hashes, sizes = shingles(data, at)
            full = np.flatnonzero(sizes)
            first = (np.cumsum(sizes) - sizes)[full]
            place = np.full(len(sizes), -1)
            place[full] = np.arange(len(full))
            at_full = pa.array(place, mask=place < 0)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(sizes.astype(np.int64)), fixed(set_digests(hashes, first)).take(at_full), fixed(sketches(hashes, sizes[full])).take(at_full)], names=["id", "hash", "n", "d", "registers"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col, text_col).alias("hash"))
    return source.mapInArrow(tidy(run), f"id {docs.schema[id_col].dataType.simpleString()}, hash long, n long, d binary, registers binary")


#: Bits for each hash that is marked, and words of 64 bits at most: 16 MB.
BITS_EACH, MOST_WORDS = 8, 1 << 20


def marks_of(hashes: DataFrame) -> tuple[DataFrame, int]:
    """A table of bits (word, bits) that marks the hashes in the column hash, and its number of words: a power of two."""
    words = 64
    need = hashes.count() * BITS_EACH // 64
    while words < need and words < MOST_WORDS:
        words *= 2
    word, bit = place_of(F.col("hash"), words)
    return staged(hashes.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), "marks"), words


def place_of(hash_: Column, words: int) -> tuple[Column, Column]:
    """The word of a hash, and its bit there."""
    return hash_.bitwiseAND(F.lit(words - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hash_, 40).bitwiseAND(F.lit(63)).cast("int"))


def marked(rows: DataFrame, hash_col: str, marks: tuple[DataFrame, int], mark_col: str) -> DataFrame:
    """rows with whether their hash is marked: always if it is among the hashes, and now and then if it isn't."""
    table, words = marks
    word, bit = place_of(F.col(hash_col), words)
    w, b = unused([*rows.columns, mark_col], "word", "bits")
    small = F.broadcast(table.select(F.col("word").alias(w), F.col("bits").alias(b)))
    hit = F.coalesce(F.col(b).bitwiseAND(bit) != 0, F.lit(False))
    return rows.join(small, word == F.col(w), "left").select(*(named(c) for c in rows.columns), hit.alias(mark_col))


def likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose estimate allows the threshold."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                rows = batch.slice(i, 2000)
                u, v = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint16).reshape(rows.num_rows, -1) for c in (4, 5))
                got = estimate(u, v, rows.column(2).to_numpy().astype(float), rows.column(3).to_numpy().astype(float))
                yield rows.filter(pa.array(got >= threshold - MARGIN)).select([0, 1])

    left = classes.select(F.col("d").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("u"))
    right = classes.select(F.col("d").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("v"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "u", "v").mapInArrow(tidy(run), "a binary, b binary")


def full_sets(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, items): the sorted hashes of the sets of the needed classes (d, hash)."""

    def run(batches):
        for rows, data, at in pieces(batches, "text", 2 << 20):
            hashes, sizes = shingles(data, at)
            full = np.flatnonzero(sizes)
            first = (np.cumsum(sizes) - sizes)[full]
            items = [np.sort(hashes[a : a + n]).tobytes() for a, n in zip(first.tolist(), sizes[full].tolist(), strict=True)]
            d = fixed(set_digests(hashes, first))
            wanted = rows.column(1).take(pa.array(full))
            same = pa.array([x == y for x, y in zip(d.to_pylist(), wanted.to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([d, pa.array(items, pa.binary())], names=["d", "items"]).filter(same)

    source = docs.select(F.xxhash64(id_col, text_col).alias("hash"), F.col(text_col).cast("string").alias("text"))
    source = marked(source, "hash", marks_of(needed), "mark").filter("mark").drop("mark")
    return source.join(needed, "hash").select("text", "d").mapInArrow(tidy(run), "d binary, items binary").dropDuplicates(["d"])


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """What tells the classes d from the class a of each pair: a, d, n, label, in_a, delta (the items that one of both has)."""

    def run(batches):
        for batch in batches:
            delta = []
            for x, y in zip(batch.column(5), batch.column(6), strict=True):
                apart = np.setxor1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True)
                delta.append(apart.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(delta, pa.binary())], names=["a", "d", "n", "label", "in_a", "delta"])

    left, right = sets.select(F.col("d").alias("a"), F.col("items").alias("x")), sets.select("d", F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "d").select("a", "d", "n", "label", "in_a", "x", "y").mapInArrow(tidy(run), "a binary, d binary, n long, label binary, in_a boolean, delta binary")


#: Cells in which items are counted, to put rarer ones first.
CELLS = 1 << 18


def cell_counts(apart: DataFrame) -> np.ndarray:
    """About how many differences hold the items of each cell."""

    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(total, (np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(CELLS)).astype(np.int64), 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["cell", "n"])

    counts = np.zeros(CELLS, np.int64)
    for row in apart.select("delta").mapInArrow(tidy(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[row.cell] = row.n
    return counts


def excess(size, n, percent: int):
    """What a difference of so many items has over the most that a class of n items of its own may have."""
    return size * (100 + percent) - n * (100 - percent)


def prefixes(apart: DataFrame, percent: int) -> DataFrame:
    """The items that lead from a class to those it may be linked with: a, item, d, n, over (its excess), rest (how many items of
    its difference stand from this one on), label, in_a, far (leads to the group of a), wide (leads to other groups).

    Classes whose differences from a have x and y items, of n items together, are linked if these have
    (x + y - n * (100 - percent) / (100 + percent)) / 2 items in common, and only then. x alone bounds that from below, given the least excess
    among the classes that it can be paired with. So the first x less that many items, and one more, hold a common one.
    """
    counts = cell_counts(apart)
    over = excess(F.octet_length("delta") / 8, F.col("n"), percent).cast("long")
    least = staged(apart.groupBy("a").agg(F.min(F.when(F.col("in_a"), over)).alias("inside"), F.min(F.when(~F.col("in_a"), over)).alias("outside")), "least")
    names = ["a", "item", "d", "n", "over", "rest", "label", "in_a", "far", "wide"]

    def run(batches):
        for batch in batches:
            at, items, over, rest, far, wide = ([] for _ in range(6))
            for k in range(batch.num_rows):
                n, in_a, inside, outside = (batch.column(c)[k].as_py() for c in (2, 4, 6, 7))
                delta = np.frombuffer(batch.column(5)[k].as_buffer(), np.uint64)
                own = excess(len(delta), n, percent)
                lead = lambda low: 0 if low is None else max(0, len(delta) + 1 - max(1, -(-(own + low) // (2 * (100 + percent)))))  # noqa: B023, E731
                to_a, to_others = (0 if in_a else lead(inside)), lead(outside)
                order = np.lexsort((delta, counts[(delta % np.uint64(CELLS)).astype(np.int64)]))[: max(to_a, to_others)]
                at.append(np.full(len(order), k))
                items.append(delta[order].view(np.int64))
                over.append(np.full(len(order), own))
                rest.append(len(delta) - np.arange(len(order)))
                far.append(np.arange(len(order)) < to_a)
                wide.append(np.arange(len(order)) < to_others)
                if sum(map(len, items)) > 100_000 or k == batch.num_rows - 1:
                    a, d, size, label, inner = (batch.column(c).take(pa.array(np.concatenate(at))) for c in range(5))
                    new = [pa.array(np.concatenate(x)) for x in (items, over, rest, far, wide)]
                    yield pa.RecordBatch.from_arrays([a, new[0], d, size, new[1], new[2], label, inner, *new[3:]], names=names)
                    at, items, over, rest, far, wide = ([] for _ in range(6))

    rows = apart.join(least, "a").select("a", "d", "n", "label", "in_a", "delta", "inside", "outside")
    return rows.mapInArrow(tidy(run), "a binary, item long, d binary, n long, over long, rest long, label binary, in_a boolean, far boolean, wide boolean")


def met(x: DataFrame, y: DataFrame, percent: int, more) -> DataFrame:
    """Pairs (a, b) of classes that share an item of a class a, and that may be linked if it is the first they share."""
    x, y = (z.select("a", "item", *(F.col(c).alias(f"{c}_{s}") for c in z.columns if c not in ("a", "item"))) for z, s in ((x, "x"), (y, "y")))
    close = F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent
    enough = F.col("over_x") + F.col("over_y") <= 2 * (100 + percent) * F.least("rest_x", "rest_y")
    return x.join(y, ["a", "item"]).filter(close & enough & more).select(F.least("d_x", "d_y").alias("a"), F.greatest("d_x", "d_y").alias("b"))


def crossing_pairs(still: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes in different groups: all that may be linked. still: a, d, n, label of classes held against a, and whether they are in its group."""
    rows = staged(prefixes(staged(differences(still, sets), "differences"), percent), "prefixes")
    inner = rows.filter("in_a AND wide").select("a", "item", "d", "n", "over", "rest")
    outer = rows.filter("NOT in_a AND far").select("a", "item", "d", "n", "over", "rest")
    across = met(inner, outer, percent, F.lit(True))
    others = rows.filter("NOT in_a AND wide").select("a", "item", "d", "n", "over", "rest", "label")
    held = others.groupBy("a", "item", "label").agg(F.count("*").alias("held"))
    # the group with the most rows of an item is held against the others, never against itself
    major = held.groupBy("a", "item").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("held", "label")).alias("major")).filter("labels > 1")
    leads = staged(others.join(major.select("a", "item", "major"), ["a", "item"]), "leads").withColumn("is_major", F.col("label") == F.col("major"))
    apart = (F.col("label_x") != F.col("label_y")) & (F.col("is_major_y") | (F.col("label_x") < F.col("label_y")))
    between = met(leads.filter("NOT is_major"), leads, percent, apart)
    return across.unionByName(between).distinct()


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(x, y).clip(max=len(x) - 1)
                both = int((x[at] == y).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("d").alias("a"), F.col("items").alias("x")), sets.select(F.col("d").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(tidy(run), "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component. edges: a, b. Labels spread along edges and jump to their label's label."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        near = staged(near, "near")
        hops = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = labels.join(near, "node").join(hops, "label").select("node", F.least("label", "near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("changed"))
        new = staged(new, "labels")
        if new.filter("changed").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _grouped(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """id, hash, n, component_id of each row."""
    threshold = percent / 100
    rows = staged(sketch(docs, id_col, text_col), "sketches")
    first = [F.first(c).alias(c) for c in ("n", "registers")]
    classes = staged(rows.filter("n > 0").groupBy("d").agg(F.min("id").alias("rep"), F.min("hash").alias("hash"), *first), "classes")

    width = 2 * BAND
    bands = [F.xxhash64(F.lit(i), F.expr(f"substring(registers, {i * width + 1}, {width})")) for i in range(REGISTERS // BAND)]
    members = classes.select("d", "hash", "n", F.explode(F.array(*bands)).alias("key"))
    buckets = staged(members.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1"), "buckets")
    members = staged(members.join(buckets, "key"), "members")
    # the first of a bucket is the class with the most company in all its buckets: of copies of one text, that text
    company = staged(members.groupBy("d").agg(F.sum("held").alias("company")), "company")
    firsts = members.join(company, "d").groupBy("key").agg(F.max(F.struct("company", "d", "n")).alias("first"))
    firsts = staged(firsts.select("key", F.col("first.d").alias("a"), F.col("first.n").alias("n_a")), "firsts")
    members = staged(members.select("key", "d", "hash", "n").join(firsts, "key"), "members")

    close = F.least("n", "n_a") * 100 >= F.greatest("n", "n_a") * percent
    pairs = members.filter((F.col("a") != F.col("d")) & close).select("a", F.col("d").alias("b")).distinct()
    needed = staged(members.select("d", "hash").distinct(), "needed")
    sets = staged(full_sets(docs, needed, id_col, text_col), "sets")
    first_pairs = staged(pairs, "pairs")
    links = staged(linked(likely(first_pairs, classes, threshold), sets, percent), "links")
    labels = components(links)

    own = members.select("key", "a", "d", "n").join(labels.withColumnRenamed("node", "d"), "d", "left").withColumn("label", F.coalesce("label", "d"))
    own = staged(own, "grouped")
    mixed_keys = staged(own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key"), "open")
    # the first of a bucket has been held against all of it
    still = own.join(mixed_keys, "key", "left_semi").filter(F.col("a") != F.col("d")).select("a", "d", "n", "label").distinct()
    of_first = labels.select(F.col("node").alias("a"), F.col("label").alias("label_of_a"))
    still = still.join(of_first, "a", "left").withColumn("in_a", F.col("label") == F.coalesce("label_of_a", "a")).drop("label_of_a")
    still = staged(still, "still")
    crossing = crossing_pairs(still, sets, percent)
    more = staged(linked(likely(staged(crossing, "crossing"), classes, threshold), sets, percent), "links")
    if not more.isEmpty():
        labels = components(links.union(more))

    named = classes.select("d", "rep").join(labels.withColumnRenamed("node", "d"), "d", "left").withColumn("label", F.coalesce("label", "d"))
    named = staged(named, "named")
    least = staged(named.groupBy("label").agg(F.min("rep").alias("component_id")), "least")
    component = staged(named.join(least, "label").select("d", "component_id"), "components")

    full = rows.filter("n > 0").select("id", "hash", "n", "d").join(component, "d").select("id", "hash", "n", "component_id")
    empty = rows.filter("n = 0").select("id", "hash", "n", F.col("id").alias("component_id"))
    return full.unionByName(empty)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """A row for each row: id_col, n_shingles, component_id (the least id of its group), kept (whether that is its own id)."""
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    with temporary_tables():
        found = staged(_grouped(docs, id_col, text_col, percent), "groups", lasting=True)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of docs that name their group, repeated rows once. Only rows that go, or are repeated, are looked up by a shuffle."""
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    with temporary_tables():
        found = _grouped(docs, id_col, text_col, percent).groupBy("hash").agg(F.max(kept).alias("kept"), F.count("*").alias("copies"))
        found = staged(found.filter("NOT kept OR copies > 1"), "verdicts", lasting=True)
    hash_col, hash_of, mark, verdict, copies, rank = unused(docs.columns, "hash", "hash_of", "mark", "kept", "copies", "rank")
    marks = marks_of(found)
    own = marked(docs.withColumn(hash_col, F.xxhash64(id_col, text_col)), hash_col, marks, mark)
    columns = [named(c) for c in docs.columns]
    verdicts = found.select(F.col("hash").alias("of"), F.col("kept").alias(verdict), F.col("copies").alias(copies)).withColumnRenamed("of", hash_of)
    seen = own.filter(mark).join(verdicts, F.col(hash_col) == F.col(hash_of), "left").filter(F.coalesce(F.col(verdict), F.lit(True)))
    again = W.partitionBy(hash_col, id_col, text_col).orderBy(F.to_json(F.struct(*columns)))
    once = seen.filter(F.col(copies) > 1).withColumn(rank, F.row_number().over(again)).filter(F.col(rank) == 1)
    return own.filter(~F.col(mark)).select(columns).unionAll(seen.filter(F.coalesce(F.col(copies), F.lit(1)) == 1).select(columns)).unionAll(once.select(columns))
