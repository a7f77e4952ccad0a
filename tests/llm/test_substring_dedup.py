import random
import re

import numpy as np

from shelfmark.llm import substring_dedup as S
from shelfmark.llm.queries import op7_substring_dedup


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoé") for _ in range(rng.randint(2, 9))) for _ in range(n))


def brute_chunks(text):
    data = np.frombuffer(re.sub("[ \t-\r]+", " ", text).encode(), np.uint8)
    starts, ends, _ = S.chunks_of(data, np.array([0, len(data)]))
    return [bytes(data[a:z]) for a, z in zip(starts, ends, strict=True)]


def test_chunks_of_many_texts_are_those_of_each():
    rng = random.Random(3)
    texts = [words(rng, rng.randint(0, 80)) for _ in range(60)] + ["", "a" * 5000]
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, doc = S.chunks_of(data, at)
    for i, t in enumerate(texts):
        assert [bytes(data[a:z]) for a, z in zip(starts[doc == i], ends[doc == i], strict=True)] == brute_chunks(t)
    assert max(ends - starts) <= 2 * S.MOST
    half = {bytes(data[a:z]): d for a, z, d in zip(starts, ends, S.digests_of(data, starts, ends), strict=True)}
    assert len(set(half.values())) == len(half)


def test_planted_passages(spark):
    rng = random.Random(5)
    shared = [words(rng, 55) for _ in range(8)]
    texts = {i: words(rng, rng.randint(5, 150)) for i in range(200)}
    holders = {i: [i * 3, i * 3 + 1, 100 + i] for i in range(8)}
    for k, docs in holders.items():
        for d in docs:
            texts[d] = words(rng, rng.randint(0, 30)) + " " + shared[k] + " " + words(rng, rng.randint(0, 30))
    rows = [(d, t, "x") for d, t in texts.items()] + [(500, "", None), (501, None, None), (None, texts[0], None), (502, "zz " * 40000, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    got = {r.doc_id: r for r in S.repeats(frame).collect()}
    assert len(got) == len(rows)
    want = {d for docs in holders.values() for d in docs} | {None}
    assert {d for d, r in got.items() if r.passages} - {502} == want
    r = got[1]
    p = r.passages[0]
    assert texts[1][p.start : p.end] in texts[1] and p.first_id in (None, 0) and p.copy
    assert got[501].n_chunks == 0 and got[500].n_chunks == 0
    assert got[None].n_shared == got[None].n_chunks and got[None].n_copied == 0


def test_counts_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = {}
    for d, t in texts.items():
        for c in brute_chunks(t):
            held.setdefault(c, set()).add(d)
    for r in S.repeats(docs).collect():
        chunks = brute_chunks(texts[r.doc_id])
        assert r.n_chunks == len(chunks)
        assert r.n_shared == sum(len(held[c]) > 1 for c in chunks)
        assert r.n_copied == sum(min(held[c]) < r.doc_id for c in chunks)


def test_empty_table(spark):
    assert S.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_lists_the_passages(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = {}
    for d, t in texts.items():
        w = t.split()
        for i in range(len(w) - 24):
            held.setdefault(tuple(w[i : i + 25]), set()).add(d)
    long = {}
    for d, t in texts.items():
        w = t.split()
        for i in range(len(w) - 50):
            if len(set(w[i : i + 51])) > 10:
                long.setdefault(tuple(w[i : i + 51]), set()).add(d)
    got = {r.doc_id for r in op7_substring_dedup(spark, folder).collect()}
    assert got <= {d for s in held.values() if len(s) > 1 for d in s}
    assert got >= {d for s in long.values() if len(s) > 1 for d in s}


def test_passages_of_51_words_are_found_whole_and_of_50_are_not(spark):
    rng = random.Random(11)
    short = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4))) for _ in range(n))
    rows, want = [], {}
    for k in range(300):
        shared, long = short(50 + k % 2), k % 2
        for j in (0, 1):
            lead, tail = short(rng.randint(1, 80)), short(rng.randint(1, 80))
            rows.append((2 * k + j, f"{lead} é{k}{j} " + (f"({shared})," if j else shared.replace(" ", "\n")) + f" {k}{j}x {tail}"))
            if long:
                start = len(f"{lead} é{k}{j} ") + j
                want[2 * k + j] = [(start, start + len(shared), 51, 2 * k, bool(j), True)]
    rows += [(900, "zz " * 60), (901, "zz " * 70)]
    # the first document has 60 words, so two passages make up the 70
    want |= {900: [(0, 179, 60, 900, False, True)], 901: [(0, 152, 51, 900, True, True), (57, 209, 51, 900, True, True)]}
    got = {r.doc_id: [tuple(p) for p in r.passages] for r in S.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {d: p for d, p in got.items() if p} == want


def bare(words):
    return (words[0].lstrip(S.AROUND) or words[0], *words[1:-1], words[-1].rstrip(S.AROUND) or words[-1])


def check_passages(rows, got, n):
    """Each passage stands whole in its first document, and all windows that stand twice are in passages of their first document."""
    texts = dict(rows)
    held = {}
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - n + 1):
            held.setdefault(bare(w[i : i + n]), []).append((d, i))
    for d, t in rows:
        spots = [m.span() for m in re.finditer(r"[^ \t-\r]+", t)]
        w, covered = t.split(), set()
        for p in got[d]:
            said = bare(t[p.start : p.end].split())
            assert len(said) == p.words >= n
            source = texts[p.first_id].split()
            assert any(bare(source[i : i + p.words]) == said for i in range(len(source) - p.words + 1)), (d, p)
            covered |= {k for k, (a, z) in enumerate(spots) if z > p.start and a < p.end}
            assert p.copy == (p.first_id != d or any(bare(w[i : i + n]) == bare(said[:n]) for i in range(max(0, sum(a < p.start for a, _ in spots) - n))))
        want = set()
        for i in range(len(w) - n + 1):
            holders = held[bare(w[i : i + n])]
            if len({h for h, _ in holders}) > 1 or max(k for _, k in holders) - min(k for _, k in holders) >= n:
                want |= set(range(i, i + n))
        assert covered == want, d


def test_a_passage_stands_whole_in_its_first_document(spark):
    rng = random.Random(1)
    x, y, z = (words(rng, 60) for _ in range(3))
    rows = [("1", f"{x} {y}"), ("2", f"{y} {z}"), ("3", f"{x} {y} {z}"), ("4", f"{x} q {x}"), ("5", f"{z} {z} {z}"), ("6", f"{y[: len(y) // 2]} {z} {y}"), ("7", "alone " + words(rng, 100)), ("8", f"{words(rng, 9)} {x} {words(rng, 9)} {x}")]
    got = {r.doc_id: r.passages for r in S.repeats(spark.createDataFrame(rows, "doc_id string, text string").repartition(3)).collect()}
    check_passages(rows, got, 51)
    assert [(p.words, p.first_id, p.copy) for p in got["3"]] == [(120, "1", True), (110, "2", True)]
    assert [(p.words, p.first_id, p.copy) for p in got["1"]] == [(120, "1", False)] and not got["7"]


def test_random_texts_of_few_words_against_brute_force(spark):
    rng = random.Random(2)
    parts = [words(rng, rng.randint(3, 30)) for _ in range(12)] + ["a b a b a b", "a a a a a a a a", "(a b", "b) c, d"]
    rows = [(d, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for d in range(150)]
    got = {r.doc_id: r.passages for r in S.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), min_words=8).collect()}
    check_passages(rows, got, 8)


def test_repeats_inside_one_document(spark):
    rng = random.Random(6)
    said = words(rng, 60)
    rows = [(1, f"{said} {words(rng, 20)} {said}")]
    (row,) = S.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(p.words, p.first_id, p.copy) for p in row.passages] == [(60, 1, False), (60, 1, True)]


def test_deduplicated_keeps_the_first_copy_of_each(spark):
    rng = random.Random(4)
    x, y = words(rng, 60), words(rng, 70)
    own = [words(rng, 10) for _ in range(8)]
    rows = [("a", f"{own[0]} {x} {own[1]}", 1, "h"), ("b", f"{own[2]} {x} {own[3]} {y}", 2, "h"), ("c", f"{y} {x}", 3, "h"), ("d", f"{own[4]} {y} {own[5]} {y} {own[6]}", 4, "h"), ("e", None, 5, "h"), ("f", "", 6, "h"), (None, own[7], 7, "h")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, spans int, hash string")
    got = S.deduplicated(docs.repartition(3), mark="#")
    assert got.columns == docs.columns
    assert {r.doc_id: (r.text, r.spans, r.hash) for r in got.collect()} == {
        "a": (rows[0][1], 1, "h"), "b": (f"{own[2]} # {own[3]} {y}", 2, "h"), "c": ("# #", 3, "h"), "d": (f"{own[4]} # {own[5]} # {own[6]}", 4, "h"), "e": (None, 5, "h"), "f": ("", 6, "h"), None: (own[7], 7, "h"),
    }
    again = S.deduplicated(got)
    assert {r.doc_id: r.text for r in again.collect()} == {r.doc_id: r.text for r in got.collect()}


def run_of(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def test_every_window_that_stands_twice_is_a_candidate_and_few_others_are():
    rng = random.Random(21)
    short = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(n))
    texts, twice = [], {}
    for k in range(120):
        shared = (short if k % 2 else lambda n: words(rng, n))(51)
        for j in range(2):
            lead = words(rng, rng.randint(0, 60))
            texts.append(f"{lead}  {'(' * j}{shared}{',' * j}\n{words(rng, rng.randint(0, 60))}".strip())
            twice[2 * k + j] = len(lead.split())
    data, at = run_of(texts)
    even, even_at, _ = S.evened(data, at)
    starts, ends, _ = S.chunks_of(even, even_at)
    digests = S.digests_of(even, starts, ends)
    _, number, often = np.unique(digests, return_inverse=True, return_counts=True)
    window, of, _, _, _, hit = S.candidates(data, at, (starts, ends), often[number.ravel()] > 1, 51)
    nth = np.arange(len(of)) - np.searchsorted(of, of)
    for d, i in twice.items():
        assert hit[(of == d) & (nth == i)].tolist() == [True], d
    sizes = [len(t) for t in texts]
    assert hit.sum() < 0.2 * len(hit) and len(hit) < sum(sizes)
    none = S.candidates(data, at, (starts, ends), np.zeros(len(starts), bool), 51)
    assert none[-1].sum() < hit.sum()  # those too short to be sure of a chunk


def test_passages_come_through_the_digests_of_chunks(spark, monkeypatch):
    rng = random.Random(22)
    shared = [words(rng, 60) for _ in range(10)]
    rows = [(2 * k + j, f"{words(rng, 40)} {x} {words(rng, 40)}") for k, x in enumerate(shared) for j in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = lambda: {r.doc_id: [tuple(p) for p in r.passages] for r in S.repeats(docs).collect()}
    plain = found()
    assert all(len(p) == 1 for p in plain.values())
    mixed = S.mixed
    monkeypatch.setattr(S, "digests_of", lambda data, starts, ends: mixed(starts.astype(np.uint64) + np.uint64(int(data[:64].astype(np.uint64).sum()) << 32)))
    assert not any(found().values())  # digests that say nothing of the chunks lead nowhere
    monkeypatch.setattr(S, "digests_of", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    assert found() == plain  # and if all are one, all windows are compared: that costs work, never rows


def test_query_spans_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = {}
    for d, t in texts.items():
        w = t.split()
        for i in range(len(w) - 50):
            held.setdefault(bare(w[i : i + 51]), set()).add(d)
    covered = {}
    for r in op7_substring_dedup(spark, folder).collect():
        a, z = map(int, r.span.split(":"))
        said = bare(texts[r.doc_id][a:z].split())
        source = texts[r.first_doc_id].split()
        assert len(said) == r.words >= 51
        assert any(bare(source[i : i + r.words]) == said for i in range(len(source) - r.words + 1))
        assert r.first_doc_id <= r.doc_id and (r.is_copy or r.first_doc_id == r.doc_id)
        spots = [m.span() for m in re.finditer(r"[^ \t-\r]+", texts[r.doc_id])]
        covered.setdefault(r.doc_id, set()).update(k for k, (x, y) in enumerate(spots) if y > a and x < z)
    for d, t in texts.items():
        w = t.split()
        want = {k for i in range(len(w) - 50) if len(held[bare(w[i : i + 51])]) > 1 for k in range(i, i + 51)}
        assert covered.get(d, set()) == want, d
    assert len(covered) > 10
