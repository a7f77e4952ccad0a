import re

import numpy as np
import pytest

from shelfmark.llm import quality_trees as Q
from shelfmark.llm.queries import op12_quality_rules

FOLDER = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {}
    for w in windows:
        often[w] = often.get(w, 0) + 1
    held = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 8)}
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(held) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(held), failed


ODD = [
    "", None, " ", "one", "a b c d e f g h", "a " * 9, "a b c d e f g h " * 2, "x y\n\nx y\n \n \nx y \nz", "\n\n", "ü ö ä # * $ % & | < >\nü ö ä # * $ % & | < >", "one\rtwo\x0bthree\x0cfour", "日本 語 " * 40,
    "w " * 100_000, " ".join(map(str, range(50_000))), "same line of words\n" * 30, "1 2 3 4 5 6 7 8 9\n1 2 3 4 5 6 7 8", "end\n", "\nend",
]


@pytest.mark.parametrize("size", [1, 2 << 20])
def test_counts_against_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(Q, "PIECE_BYTES", size)
    rows = [(i, t, "x", 7) for i, t in enumerate(ODD)] + [(None, "twice twice", "x", 7), (3, "one", "x", 7)]
    got = Q.statistics(spark.createDataFrame(rows, "doc_id long, text string, id string, n_words int")).withColumn("failed", Q.base_failed()).collect()
    key = lambda r: (repr(r[0]), r[1:])
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.failed) for r in got), key=key) == sorted(((i, *brute(t)) for i, t, _, _ in rows), key=key)


def test_other_counts():
    text = "The the the cat! Sat,\non 12 MATS? ñandú"
    got = {k: int(v[0]) for k, v in Q.counted(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])).items()}
    assert got.keys() == set(Q.COUNTS)
    assert (got["n_lines"], got["n_upper"], got["n_digits"], got["n_shouts"], got["n_marks"], got["n_wide"], got["n_distinct"], got["n_most"], got["n_stutter"]) == (2, 6, 2, 2, 1, 2, 8, 2, 1)


def test_query_against_brute_force_and_labels(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in op12_quality_rules(spark, FOLDER).collect()}
    assert rows.keys() == docs.keys()
    for i, r in rows.items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(docs[i])
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    judged = [(labels[i], r.kept) for i, r in rows.items() if i in labels and not r.base_failed]
    assert np.mean([good == kept for good, kept in judged]) > 0.99


def test_verdicts_on_labels_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    stats = Q.statistics(docs).cache()
    good, bad = [], []
    for part in range(3):  # each labelled row is judged once, by a forest that has not seen it
        forest = Q.fit(stats, labels.filter(f"crc32(cast(doc_id AS string)) % 3 <> {part}"))
        held = Q.score(stats, forest).join(labels.filter(f"crc32(cast(doc_id AS string)) % 3 = {part}"), "doc_id").filter("NOT base_failed").collect()
        good += [r.kept for r in held if r.quality == 1]
        bad += [r.kept for r in held if r.quality == 0]
    assert len(bad) > 20 and np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_flat_trees_equal_a_walk_and_keep_to_the_constraints():
    pick = np.random.default_rng(3)
    x = np.column_stack([pick.normal(size=1500), pick.integers(0, 4, 1500), pick.normal(size=1500), np.zeros(1500)])
    y = (x[:, 0] - x[:, 0] ** 3 + np.sin(3 * x[:, 1]) - x[:, 2] ** 2 + 0.2 * pick.normal(size=1500) > 0).astype(float)
    free, held = Q.boosted(x, y, [0, 0, 0, 0]), Q.boosted(x, y, [-1, 1, -1, 0])

    def walk(forest, row):
        total = forest.offset
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        return total

    for forest in (free, held):
        assert np.allclose(forest.margins(x[:200]), [walk(forest, r) for r in x[:200]])
    grid = np.linspace(-4, 4, 60)

    def slopes(forest, f):
        out = []
        for row in x[:60]:
            line = np.repeat(row[None], len(grid), 0)
            line[:, f] = grid
            out.append(np.diff(forest.margins(line)))
        return np.array(out)

    assert (slopes(held, 0) <= 1e-12).all() and (slopes(held, 1) >= -1e-12).all() and (slopes(held, 2) <= 1e-12).all()
    assert (slopes(free, 0) > 0.01).any() and (slopes(free, 1) < -0.01).any()
    loss = lambda f: -np.mean(np.log(np.where(y == 1, f.scores(x), 1 - f.scores(x))))
    assert loss(free) < loss(held) < loss(Q.constant(0.0)) and np.mean((free.scores(x) > 0.5) == y) > 0.85


def test_unusable_labels_odd_rows_and_filtered(spark):
    good = " ".join(f"word{k}" for k in range(40))
    shout = " ".join(f"WORD{k}!!" for k in range(40))
    rows = [(k, t, "a", 1) for k in range(40) for t in [good + f" end{k}." if k % 2 else shout + f" {k}"]] + [(None, good, "b", 2), (50, None, "b", 2), (51, "", "b", 2), (1, good, "b", None)]
    docs = spark.createDataFrame(rows, "`doc_id` long, text string, `a.b` string, held int")
    stats = Q.statistics(docs).cache()
    for labels in ([], [(1, 1), (2, None)], [(k, 1) for k in range(40)]):
        frame = spark.createDataFrame(labels, "doc_id long, quality int")
        got = Q.score(stats, Q.fit(stats, frame))
        assert got.filter("kept").count() == 42 and got.filter("score <> 1").count() == 0
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(3, 1), (None, 1)], "doc_id long, quality int")
    forest = Q.fit(stats, labels)
    assert {r.doc_id for r in Q.score(stats, forest).filter("kept").collect()} == {*range(1, 40, 2), None}
    kept = Q.filtered(docs, forest)
    assert kept.columns == docs.columns and kept.count() == 22
    empty = docs.filter("false")
    assert Q.score(Q.statistics(empty), forest).count() == 0 and Q.filtered(empty, forest).count() == 0
    assert Q.score(stats, Q.fit(Q.statistics(empty), labels)).count() == 44
