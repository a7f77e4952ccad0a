import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from shelfmark.llm import importance as I
from shelfmark.llm.queries import op11_importance

FOLDER = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def buckets(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, benchmark):
    own = [buckets(t) for _, t in docs]
    raw, target = (np.bincount(np.array([b for x in y for b in x], int), minlength=10_000).tolist() for y in (own, [buckets(t) for t in benchmark]))
    s, t = sum(raw), sum(target)
    gain = [math.floor(1000 * math.log((b + 1) * (s + 10_000) / ((a + 1) * (t + 10_000)))) for a, b in zip(raw, target, strict=True)]
    out, long = [], []
    for (i, text), x in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x)
        out.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(words(text)) >= 20:
            long.append(out[-1])
    long.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(long[: 5 * len(long) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    benchmark = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = brute(docs, benchmark)
    assert result(op11_importance(spark, FOLDER)) == want
    assert sum(r[4] is not None for r in want) > 30


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_stretches_do_not_change_the_runs(size, n):
    for text in ["", " ", "one", "Ein ÜBERMUT zwei, drei;vier  fünf", "a b c d e f g h i j", "x" * 50 + " y", "\x00a\x7fb 日本 語"]:
        w = [x.encode() for x in words(text)]
        want = sorted(zlib.crc32(b" ".join(w[i : i + k])) for k in range(1, n + 1) for i in range(len(w) - k + 1))
        got = list(I.runs(text.encode(), n, size))
        assert sorted(np.concatenate([f for _, f in got]).tolist() if got else []) == want
        assert sum(c for c, _ in got) == len(w)


def test_odd_rows_ties_and_clashing_names(spark):
    long, other = "lorem ipsum dolor sit " * 5, "alpha beta gamma delta " * 50_000
    docs = [(1, None), (2, ""), (3, "!?"), (4, long), (4, long), (5, other), (None, long), (None, None), (6, "ÀÉ " * 30), *((k, long) for k in range(10, 90))]
    frame = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, score string, rank int, place int")
    target = spark.createDataFrame([("lorem ipsum", "x"), (None, "x")], "text string, bucket string")
    got = I.ranks(frame, target)
    assert result(got) == brute(docs, ["lorem ipsum", None])
    kept = I.resampled(frame, target)
    assert kept.columns == frame.columns
    ranked = {r.doc_id for r in got.filter("rank IS NOT NULL").collect()}
    assert {r.doc_id for r in kept.collect()} == ranked - {None}
    empty = frame.filter("false")
    assert I.ranks(empty, target).count() == 0
    assert result(I.ranks(frame, target.filter("false"))) == brute(docs, [])
