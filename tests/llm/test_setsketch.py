import random

import numpy as np
from pyspark.sql import functions as F

from shelfmark.llm import setsketch as S


def shingle_set(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def brute(texts):
    """component of each id by all pairs."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in seen:
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def variants(rng, n_groups=12):
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    texts, i = {}, 0
    for g in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 40, 150, 400]))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts[i] = (" " if rng.random() < 0.7 else " \n").join(w.upper() if rng.random() < 0.1 else w for w in copy).replace("É", "é")
            i += 1
            base = copy if rng.random() < 0.5 else base
    return texts


def test_groups_against_brute_force(spark):
    rng = random.Random(7)
    texts = variants(rng)
    k = len(texts)
    texts |= {k: "", k + 1: " \t", k + 2: "Three words here", k + 3: "three  words\nhere", k + 4: "a b c d e", k + 5: "z " * 9000}
    rows = [(i, t, 1, "x") for i, t in texts.items()] + [(k + 6, None, 1, "x"), (0, texts[0], 1, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n int, d string").repartition(3)
    want = brute({**texts, k + 6: ""})
    got = S.groups(frame).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute({r.doc_id: r.text for r in docs.collect()})
    # an id may stand in several rows; its class is that of each text
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in S.groups(docs).collect()}
    unique = {r.doc_id for r in docs.groupBy("doc_id").count().filter("count = 1").collect()}
    assert {i: v for i, v in got.items() if i in unique} == {i: v for i, v in want.items() if i in unique}


def test_null_ids_and_empty_table(spark):
    text = "one two three four five six seven"
    got = S.groups(spark.createDataFrame([(None, text), (5, text), (4, text), (None, "alone in the world of text")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("4", "4", True), ("5", "4", False), ("None", "4", False), ("None", "None", True)]
    assert S.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimates_follow_similarity():
    rng = np.random.default_rng(0)
    for j in (0.3, 0.7, 0.9):
        both, n = int(1000 * j), 1000
        pool = S.mixed(rng.integers(0, 1 << 62, 2 * n, dtype=np.int64).astype(np.uint64))
        extra = (n - both) // 2
        a, b = pool[: both + extra], np.concatenate([pool[:both], pool[both + extra : both + 2 * extra]])
        u = S.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]))
        got = S.estimate(u[:1], u[1:], np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(got - both / (both + 2 * extra)) < 0.12
        union = S.sketches(np.unique(np.concatenate([a, b])), np.array([both + 2 * extra]))
        assert (union[0] == np.maximum(u[0], u[1])).all()

def test_links_across_groups_of_a_bucket_are_found(spark):
    """Pages of one template share a first class; copies among them are linked with each other, not with it."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    template = [word() for _ in range(300)]
    texts = {}
    for i in range(400):
        own = [word() for _ in range(100)]
        texts[i] = " ".join(template + own)
        if i % 10 == 0:  # a near copy, and a chain of them
            for k in (1, 2):
                own = [*own[: -2 * k], *(word() for _ in range(2 * k))]
                texts[1000 * k + i] = " ".join(template + own)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in S.groups(frame).collect()} == brute(texts)


def test_ids_of_any_type_ties_and_columns_named_as_its_own(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [("b", text, 1, "x"), ("a", text, 2, "y"), ("a", text, 2, "x"), ("c", None, 3, "x"), ("d", "", 4, "x"), ("e", "other words than these here", 5, "x"), (None, text, 6, "x"), (None, "alone as it is in the world", 7, "x")]
    frame = spark.createDataFrame(rows, "doc_id string, text string, hash int, __hash_own string").withColumn("word", F.col("hash"))
    got = S.deduplicated(frame.repartition(3))
    assert got.columns == frame.columns
    assert sorted(map(str, ((r.doc_id, r.hash, r["__hash_own"], r.word) for r in got.collect()))) == sorted(map(str, [("a", 2, "x", 2), ("c", 3, "x", 3), ("d", 4, "x", 4), ("e", 5, "x", 5), (None, 7, "x", 7)]))
    assert {(r.doc_id, r.component_id) for r in S.groups(frame).collect() if r.doc_id} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("e", "e")}


def test_deduplicated_keeps_what_groups_say(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted(r.doc_id for r in S.groups(docs).filter("kept").collect())
    assert sorted(r.doc_id for r in S.deduplicated(docs).collect()) == want


def test_marks_hold_all_that_is_marked(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("hash"))
    marks = S.marks_of(rows)
    assert S.marked(rows, "hash", marks, "mark").filter("mark").count() == 5000
    others = spark.range(5000, 25000).select(F.xxhash64("id").alias("hash"))
    assert S.marked(others, "hash", marks, "mark").filter("mark").count() < 4000
