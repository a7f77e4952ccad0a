"""Importance resampling of documents towards a target, by hashed runs of words.

Features of a text are all runs of 1 to ``n`` consecutive words, joined by one space, repeats counted. A text is
scanned once for them: each word starts a zlib state, and the states of the last ``n`` starts are extended by a
space and the next word, so each run costs one step and no run is ever built. The scan goes over stretches of
words, and carries the last n - 1 words into the next; a state modulo ``buckets`` is a feature's bucket.

Each task adds up its own counts of buckets, so what is shuffled is ``buckets`` rows a task at most. A bucket's
gain, from its smoothed rates in target and raw texts, is a whole number; there are ``buckets`` of them, and they
are on the driver. A second scan sums each document's gains. With noise from a hash of its id (Gumbel's, so that a
draw of the highest is a draw without replacement) that is its score. Ranks come from one sort by ranges of the
scores, rows alone, without texts: each range is numbered from where those before it end.

Defined results: null and empty texts have no words and no features, and weight 0; texts and words of any length
are read whole, a stretch at a time; ties go to the smaller id, nulls last, then to fewer features; repeated rows are
documents of their own; a null id counts as empty in its hash; ids may have any type that can be sorted; an empty
table gives an empty table, and an empty target counts 0 in each bucket; further columns are left out of the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named
from ..functions.ordering import numbered
from ..functions.staging import staged
from .arrow_text import pieces, tidy

N, BUCKETS, SEED = 3, 10_000, 42
#: Documents of fewer words are never drawn; of the others, so many in a hundred are.
LEAST_WORDS, PERCENT = 20, 5
#: Bytes of a text whose words are held at a time.
STRETCH = 1 << 20

#: A-Z becomes a-z, other ASCII but digits and letters a space; bytes from 128 on belong to words.
PLAIN = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def stretches(text: bytes, size: int = STRETCH) -> Iterator[list[bytes]]:
    """The lower-case words of a text, some size bytes of them at a time; a word is never cut."""
    at = 0
    while at < len(text):
        end = at + size
        part = text[at:end].translate(PLAIN)
        while end < len(text) and part[-1] != 32:
            more = text[end : end + size].translate(PLAIN)
            cut = more.find(b" ") + 1 or len(more)
            part, end = part + more[:cut], end + cut
        yield part.split()
        at = end


def runs(text: bytes, n: int, size: int = STRETCH) -> Iterator[tuple[int, np.ndarray]]:
    """For each stretch, its number of words and the CRCs of all runs of 1 to n words that end in it."""
    before: list[bytes] = []
    for new in stretches(text, size):
        words = before + new
        tails = [b" " + w for w in words]
        states = list(map(crc32, words))  # of the runs that start at each word
        found = [states[len(before) :]]
        for k in range(1, n):
            states = list(map(crc32, tails[k:], states))
            found.append(states[max(0, len(before) - k) :])
        yield len(new), np.concatenate([np.array(f, np.uint32) for f in found])
        before = words[len(words) - min(n - 1, len(words)) :]


def bucket_counts(docs: DataFrame, text_col: str = "text", n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n: how many features of all texts are in each bucket that has any."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for _, data, at in pieces(batches, "text"):
            for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                for _, found in runs(data[a:z].tobytes(), n):
                    total += np.bincount(found % buckets, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    each = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "bucket int, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, text_col: str = "text", n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: floor(1000 * ln) of its rate in the target by its rate in raw texts, one added to each count."""
    counts = []
    for docs in (raw, target):
        own = np.zeros(buckets, np.float64)
        for row in bucket_counts(docs, text_col, n, buckets).collect():  # buckets rows at most
            own[row.bucket] = row.n
        counts.append(own)
    s, t = counts
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """id_col, n_words, n_features and weight, the sum of the gains of a document's features."""

    def run(batches):
        for rows, data, at in pieces(batches, "text"):
            out = np.zeros((3, rows.num_rows), np.int64)
            for i, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                for words, found in runs(data[a:z].tobytes(), n):
                    out[:, i] += (words, len(found), gain[found % len(gain)].sum())
            yield pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, out)], names=["id", "n_words", "n_features", "weight"])

    ddl = docs.schema[id_col].dataType.simpleString()
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return got.mapInArrow(tidy(run), f"id {ddl}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def noise(id_col: str, seed: int = SEED) -> Column:
    """floor(-1000 * ln(-ln(u))), where u comes from the first 32 bits of a hash of seed and id."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(float(1 << 32)))))


def drawn(scored: DataFrame, id_col: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored with rank: 1, 2, ... for the floor(percent * N / 100) highest scores of the N documents of least_words
    words or more, null for all others. scored is read more than once, so it should be a table."""
    long = F.col("n_words") >= least_words
    most = scored.filter(long).count() * percent // 100
    ranked = numbered(scored.filter(long), F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("n_features"), F.col("weight"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return ranked.unionByName(scored.filter(~long).withColumn("rank", F.lit(None).cast("long")))


def ranks(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """id_col, n_words, n_features, weight, score and rank of every document; target has its texts in text_col too."""
    got = weighed(docs, gains(docs, target, text_col, n, buckets), id_col, text_col, n)
    return drawn(staged(got.withColumn("score", F.col("weight") + noise(id_col, seed)), "scored"), id_col, percent, least_words)


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents drawn, columns as they are. An id that stands more than once comes with all its rows if one is drawn; rows without one are left out."""
    chosen = ranks(docs, target, id_col, **options).filter("rank IS NOT NULL").select(id_col).distinct()
    return docs.join(chosen, id_col, "left_semi").select(*map(named, docs.columns))
