import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import toxicity as T
from shelfmark.llm.queries import op2_toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def english(spark):
    text = "you are a stupid idiot and a worthless loser they said but the others were kind and good people who like the idea of it. " * 40
    return T.costs_of(T.trigram_counts(spark.createDataFrame([(text,)], "text string"), "text"))


@pytest.mark.parametrize(("seen", "want"), [("st00pid", None), ("1d10t", "idiot"), ("l0ser", "loser"), ("w0rthle$$", "worthless"), ("stuuuupid", "stupid"), ("i.d.i.o.t", "idiot"), ("$tupid", "stupid"), ("ID!OT", "idiot"), ("plain", "plain"), ("idiot***", "idiot"), ("(loser)", "loser"), ("Café", "café")])
def test_readings(english, seen, want):
    got = T.reading(seen, english)
    assert got == want if want else got.isalpha()


def test_viterbi_is_the_least_of_all_paths(english):
    def paths(options):
        if not options:
            return [("", 0.0)]
        return [(t + rest, c + cost) for t, c in options[0] for rest, cost in paths(options[1:])]

    def cost(said):
        a = b = T.EDGE
        total = 0.0
        for c in [*map(T.symbol, said), T.EDGE]:
            total += english[a, b, c]
            a, b = b, c
        return total

    for word in ("1d10t", "l00ser", "s-t-u", "wo!!rthl3ss", "7$|"):
        best = min(paths(T.lattice(word)), key=lambda p: p[1] + cost(p[0]))
        assert T.decode_word(word, english) == best[0]


def test_words_and_runs_of_any_length(english):
    assert T.reading("st" + "u" * 60 + "pid", english) == "stupid"
    assert T.reading("-".join("you.stupid.idiot.and.worthless.loser".replace(".", "")), english) == "youstupididiotandworthlessloser"
    text = ("x" * 50 + " " + " ".join("stupid" * 20)).encode()
    words = T.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), english)
    assert [(j - i) for i, j in words.apart] == [120]
    assert len(T.decode_word("s1" * 20000, english)) == 40000


@pytest.mark.parametrize(("seen", "want"), [("i d 1 0 t", "idiot"), ("s t u p ! d", "stupid"), ("$ t u p í d", "stupíd"), ("you are a s t u p i d person", "stupid"), ("y o u a r e i d i o t", "you are idiot"), ("S t u u u p i d.", "stupid"), ("s - t - u - p - i - d", "stupid")])
def test_spaced_words(english, seen, want):
    data = np.frombuffer(seen.encode(), np.uint8)
    words = T.Words(data, np.array([0, len(data)]), english)
    assert set(want.split()) <= {words.read[i] for i in words.code_all}
    assert f" {want} " in f" {T.restored_text(seen, english)} "


def test_a_row_of_many_lone_letters_and_clean_ones(english):
    assert " ".join(T.decode_apart("astupididiot" * 500, english)).replace(" ", "") == "astupididiot" * 500
    assert T.restored_text("1 2 3 4 and 5 6 7 8", english) == "1 2 3 4 and 5 6 7 8"


@pytest.mark.parametrize(("seen", "want"), [("stuupid", "stupid"), ("iddiot", "idiot"), ("looser", "loser"), ("good", "good"), ("will", "will"), ("worthless", "worthless")])
def test_letters_doubled(english, seen, want):
    text = "good people will see all books and the will of good people is a good will " * 40 + "you are a stupid idiot and a worthless loser they said " * 40
    s = np.concatenate([[T.EDGE], T.symbols()[np.frombuffer(text.encode(), np.uint8)], [T.EDGE]]).astype(int)
    assert T.reading(seen, T.costs_of(np.bincount(s[:-2] * T.SYMBOLS**2 + s[1:-1] * T.SYMBOLS + s[2:], minlength=T.SYMBOLS**3))) == want


def test_repeats_decoded_by_context_are_as_in_whole_words(english):
    rng, known = random.Random(7), {}
    for _ in range(3000):
        word = "".join(rng.choice("stupidloe") * rng.choice((1, 1, 1, 2, 3)) for _ in range(rng.randint(1, 9)))
        if T.REPEATED.search(word):
            assert T.collapsed(word, english, known) == T.decode_word(word, english)


def area(scores, labels):
    """How often a labelled text scores over one that is not, ties by half."""
    order = sorted(set(scores))
    rank = {v: i for i, v in enumerate(order)}
    yes, no = (np.bincount([rank[v] for v, y in zip(scores, labels, strict=True) if y == k], minlength=len(order)) for k in (1, 0))
    below = np.cumsum(no) - no
    return float((yes * (below + no / 2)).sum() / (yes.sum() * no.sum()))


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.1"])
def test_held_out_recall_and_area_under_the_curve(spark, folder):
    got = {r.doc_id: r for r in op2_toxicity(spark, folder).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").distinct().count()
    rows = [(labels[i], r.predicted, r.score) for i, r in got.items() if r.held_out and i in labels]
    yes, no = ([r for r in rows if r[0] == k] for k in (1, 0))
    assert sum(r[1] for r in yes) >= 0.9 * len(yes)
    assert sum(r[1] for r in no) <= 0.05 * len(no)
    assert area([r[2] for r in rows], [r[0] for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_disguised_text_scores_as_plain_text_does(spark):
    rng = random.Random(2)
    plain = ["the", "and", "of", "thing", "other", "there", "with", "have", "this", "from", "idea", "lesson", "stone", "most"]
    bad = ["loser", "idiot", "stupid", "moron"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            words[5:5] = rng.sample(bad, 2)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    odd = {1000: "the l0ser and 1d10t of this", 1001: "the thing i d i o t from m.o.r.o.n other", 1002: "the thing and other", 1003: "", 1004: None, 1005: "st*pid stuuupid idiooot", 1006: "a " * 50000}
    docs = spark.createDataFrame([*rows, *odd.items(), (None, "loser idiot")], "doc_id long, text string")
    frame = spark.createDataFrame([*labels, (None, 1), (3, None), (0, 0)], "doc_id long, toxic int")
    model = T.fit(docs, frame)
    got = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    assert len(got) == len(rows) + len(odd) + 1
    assert min(got[1000], got[1001], got[1005], got[None]) > 0.5 and max(got[1002], got[1003], got[1004], got[1006]) < 0.3
    assert got[1003] == got[1004]
    back = T.restored(docs.filter("doc_id in (1000, 1001, 1004)").withColumn("score", F.lit("x")), model).collect()
    said = {r.doc_id: r.restored for r in back}
    assert said == {1000: "the loser and idiot of this", 1001: "the thing idiot from moron other", 1004: None}
    assert T.filtered(docs, model, 0.3).filter("doc_id = 1000 or doc_id = 0").count() == 0


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "loser")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in T.score(docs, T.fit(docs, none)).collect()] == [0.0]
    empty = docs.filter("false")
    assert T.score(empty, T.fit(empty, none)).count() == 0
    assert np.isfinite(T.costs_of(np.zeros(T.SYMBOLS**3))).all()


def test_ids_of_any_type_and_columns_named_as_results(spark):
    rows = [(f"doc-{i}", "loser idiot and the other" if i % 4 == 0 else "the thing and the other", "x") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, restored string").withColumn("read", F.lit("y"))
    labels = spark.createDataFrame([(r[0], int(i % 4 == 0)) for i, r in enumerate(rows)], "doc_id string, toxic int")
    model = T.fit(docs, labels)
    got = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    assert min(got[f"doc-{i}"] for i in range(0, 80, 4)) > 0.5 > max(got[f"doc-{i}"] for i in range(1, 80, 4))
    back = T.restored(docs, model)
    assert sorted(back.columns) == ["doc_id", "read", "restored", "text"]
    assert all(r.restored == r.text and r["read"] == "y" for r in back.collect())


def test_weights_shrink_with_their_evidence(spark):
    at = lambda yes, no: spark.range(1).select(T.shrunken(F.lit(float(yes)), F.lit(float(no)), 10_000.0, 100_000.0).alias("w")).first().w
    assert at(1, 1) == 0 < at(4, 1) < at(40, 10) < at(400, 100)
    assert at(40, 400) == 0


def test_feature_counts_against_plain_python(english):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["idiot", "idiom", "the", "stupid", "Stupid.", "aa", "st00pid", ""]) for _ in range(rng.choice([0, 5, 700]))) for _ in range(30)]
    half, label = (np.array([rng.randrange(2) for _ in texts], np.int32) for _ in range(2))
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    words = T.Words(np.frombuffer(b"".join(raw), np.uint8), at, english)
    want = {}
    for i, t in enumerate(texts):
        own, tokens = {}, t.split()
        for w in tokens:
            for f in T.features(T.reading(w, english)):
                own[f] = own.get(f, 0) + 1
        for f, n in own.items():
            counts = want.setdefault(f, [0] * 6)
            counts[3 * half[i] + label[i]] += round(float(T.UNIT * min(1.0, T.LONG / len(tokens)) * np.log2(1 + n)))
            counts[3 * half[i] + 2] += int(label[i])
    got = T.feature_counts(words, half, label).to_pylist()
    assert {r["feature"]: [r[c] for c in T.COUNTS] for r in got if any(r[c] for c in T.COUNTS)} == want


def test_words_read_plainly_are_read_as_all_are(english):
    words = ["plain", "Good", "good", "It", "a", "aA", "l0ser", "end.", "élan", "x", "İ"]
    easy = T.plainly_read(pa.array([w.encode() for w in words], pa.binary())).tolist()
    assert easy == [True, False, False, True, True, False, False, False, False, True, False]
    assert all(T.reading(w, english) == w.lower() for w, e in zip(words, easy, strict=True) if e)


def toxic_corpus(rng, bad, n=400):
    plain = ["the", "and", "of", "thing", "other", "there", "with", "have", "this", "from", "idea", "lesson", "stone", "most"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            words[5:5] = rng.sample(bad, 2)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    return rows, labels


def test_each_form_of_a_word_scores_as_the_plain_one(spark):
    rng = random.Random(7)
    rows, labels = toxic_corpus(rng, ["loser", "idiot", "stupid", "moron"])
    wide = lambda w: "".join(chr(ord(c) + 0xFEE0) for c in w)
    forms = {"idiot": ["idiot", "1d10t", "i d i o t", "i.d.i.o.t", "idiooot", "idi ot", "id iot", "i diot", "idio t", "id i ot", "id­iot", "i​di⁠ot", wide("idiot"), "іdіоt", "ідіоt", "IDIOT!", "1di ot"],
             "stupid": ["stupid", "stu pid", "st upid", "stup id", "ѕtuріd", "s‍tupid", wide("Stupid"), "stupi d", "$tup1d"]}
    around = "the thing and other of {} this from there with idea"
    made = [(f"{w}-{k}", around.format(form)) for w, held in forms.items() for k, form in enumerate(held)]
    clean = ["idi", "ot", "stu", "iot the id", "the idea of most", "привет мир", "ｔｈｉｎｇ", "id and iot", "pid stu", "​", "­ ​"]
    docs = spark.createDataFrame([*((str(i), t) for i, t in rows), *made, *((f"clean-{k}", around.format(c)) for k, c in enumerate(clean))], "doc_id string, text string")
    model = T.fit(docs, spark.createDataFrame([(str(i), y) for i, y in labels], "doc_id string, toxic int"))
    got = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    for w, held in forms.items():
        for k, form in enumerate(held):
            assert abs(got[f"{w}-{k}"] - got[f"{w}-0"]) < 0.05 and got[f"{w}-{k}"] > 0.5, form
    assert max(got[f"clean-{k}"] for k in range(len(clean))) < 0.3
    said = {r.doc_id: r.restored for r in T.restored(docs.filter("doc_id LIKE 'idiot-%'"), model).collect()}
    assert set(said.values()) == {around.format("idiot"), around.format("IDIOT!")}


def test_few_labels_of_a_kind_still_make_a_model(spark):
    for salt in range(6):
        rows = [(f"{salt}-{i}", "you loser and idiot of the other thing" if i < 2 else "the other thing and this of idea") for i in range(40)]
        docs = spark.createDataFrame(rows, "doc_id string, text string")
        model = T.fit(docs, spark.createDataFrame([(r[0], int(i < 2)) for i, r in enumerate(rows)], "doc_id string, toxic int"))
        got = {r.doc_id: r.score for r in T.score(docs, model).collect()}
        assert min(got[f"{salt}-0"], got[f"{salt}-1"]) > 0.3 > max(got[f"{salt}-{i}"] for i in range(2, 40))
    one = T.fit(docs, spark.createDataFrame([(r[0], 1) for r in rows], "doc_id string, toxic int"))
    assert {r.score for r in T.score(docs, one).collect()} == {0.0}
