import hashlib
import random
import re

from shelfmark.llm import decontamination as D
from shelfmark.llm.queries import op5_decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for i, t in items:
        x = words(t)
        for k in range(max(len(x) - 9, 1) if x else 0):
            win = x[k : k + 10]
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_against_brute_force(spark):
    rng = random.Random(1)
    pool = ["the", "of", "É", "é", "K", "k", "a1", "ß", "İ", "x", "y", "long", "Word"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([3, 9, 10, 11, 20])))) for i in range(12)] + [(20, ""), (21, None), (22, "--"), (5, "x")]
    docs = []
    for d in range(60):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.7:
            body = items[rng.randrange(12)][1]
            w = body.split()
            a = rng.randint(0, 3)
            text = text + rng.choice([" ", "-", ".\n"]) + rng.choice([",", " ", "--"]).join(w[a:])
        docs.append((d, rng.choice(["", ". ", " "]) + text.swapcase() if rng.random() < 0.3 else text))
    docs += [(100, ""), (101, None), (102, "..."), (103, D.END + " x " + D.END), (None, docs[0][1]), (3, docs[3][1]), (104, "the " * 50000)]
    frame = spark.createDataFrame([(*r, 1, "q") for r in docs], "doc_id long, text string, n int, items string").repartition(3)
    bench = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, doc_id int")
    for block in (D.BLOCK, 7):
        got = D.hits(frame, bench, block=block).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == sorted((str(i), *brute(t, items)) for i, t in docs)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.hits(docs.filter("false"), bench).count() == 0
    assert [(r.n_words, r.n_hit) for r in D.hits(docs, bench.filter("false")).collect()] == [(2, 0)]


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    n = 0
    for r in op5_decontamination(spark, folder).collect():
        n_words, n_hit, found = brute(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n_words, n_hit, len(found), n_hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        n += r.contaminated
    assert n
