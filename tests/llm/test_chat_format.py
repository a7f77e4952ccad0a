import hashlib
import random

from pyspark.sql import functions as F

from shelfmark.llm import chat_format as C
from shelfmark.llm.queries import op1_chat_format

SCHEMA = "tree long, msg long, parent long, role string, text string, score double, key string, at int"


def brute(rows, best):
    """The best branches of each tree: (tree, rank, score, turns)."""
    nodes = {}
    for r in sorted(rows, key=lambda r: (r[3] or "", r[4] or "", r[5] or 0.0)):
        nodes.setdefault((r[0], r[1]), r)
    parents = {(r[0], r[2]) for r in nodes.values()}
    out = []
    for tree in {r[0] for r in nodes.values()}:
        found = []
        for (t, m), _ in nodes.items():
            if t != tree or (t, m) in parents:
                continue
            path, at = [], (t, m)
            while at in nodes and len(path) <= len(nodes):
                path.append(nodes[at])
                at = (t, nodes[at][2])
            if len(path) <= len(nodes):
                found.append((-sum(r[5] or 0.0 for r in path), -len(path), m, path[::-1]))
        for k, (s, _, _, path) in enumerate(sorted(found, key=lambda f: f[:3])[:best], 1):
            out.append((str(tree), k, round(-s, 6), [(r[3] or "", r[4] or "") for r in path]))
    return sorted(out)


def test_trees_against_brute_force(spark):
    rng = random.Random(8)
    pool = ["<|turn|>", "<|end|>\n", "~", "~~", "</s>", "[INST] ok [/INST]", "é🙂", "\n", "n", "", "<", "|end|>", "<<SYS>>", "$1", "\\"]
    rows = []
    for tree in [*range(25), None]:
        for m in range(rng.randint(1, 12)):
            text = "".join(rng.choice(pool) for _ in range(5))
            rows.append((tree, m, rng.randrange(m) if m and rng.random() < 0.9 else None, rng.choice(["user", "assistant", None, "~n\n<s>"]), text, rng.choice([0.5, 1.0, -2.0, None]), "k", 1))
    rows += [(50, i, i - 1, "user", str(i), 0.0, "k", 1) for i in range(300)] + [(51, 0, 1, "a", "cycle", 1.0, "k", 1), (51, 1, 0, "b", "cycle", 1.0, "k", 1), (51, 2, 1, "c", "under", 1.0, "k", 1), (52, 0, 99, "user", None, 1.0, "k", 1), (52, 0, 99, "user", None, 1.0, "k", 1)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for best in (1, 3):
        got = C.parsed(C.formatted(frame, score="score", best=best)).collect()
        assert sorted((str(r.tree), r.rank, round(r.score, 6), [(t.role, t.text) for t in r.turns]) for r in got) == brute([r for r in rows if r[0] != 51], best)
        for r in got:
            assert r.learnt == [t.text for t in r.turns if t.role == "assistant"]
            inner = r.formatted.replace(C.END, "").replace(C.TURN, "")
            assert not any(c in inner for c in C.CONTROL)


def test_empty_table_and_null_message(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.parsed(C.formatted(empty)).count() == 0
    assert C.formatted(spark.createDataFrame([(1, None, None, "user", "a", 1.0, "", 1), (1, None, None, "user", "b", 2.0, "", 1)], SCHEMA), score="score", best=5).count() == 2


def test_query_against_plain_python(spark):
    folder = "/root/testdata/sf0.01"
    chats = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn").collect():
        chats.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    chats[-7] = [(role, "</s>[INST] ok [/INST]") for role in ("user", "assistant")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = op1_chat_format(spark, folder).collect()
    assert len(got) == len(chats)
    for r in got:
        turns = chats[r.conv_id]
        learnt = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), sha(learnt))


def test_equal_turns_have_an_order(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", None), (None, 0, "user", "x"), (1, 0, "user", "a")]
    got = C.parsed(C.formatted(C.chained(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "conv_id")).select("conv_id", F.col("turns.text").alias("texts")).collect()
    assert {r.conv_id: r.texts for r in got} == {1: ["", "a", "a", "b"], None: ["x"]}


def test_trees_and_ids_that_read_alike_joined_are_apart(spark):
    rows = [("a/b", "c", None, "user", "1"), ("a", "b/c", None, "user", "2"), (None, "x", None, "user", "3"), ("~", "x", None, "user", "4"), ("null", "x", None, "user", "5"), ("a", "row 0", None, "user", "6"), ("a", None, "b/c", "user", "7"), ("a", "", None, "user", "8")]
    frame = spark.createDataFrame(rows, "tree string, msg string, parent string, role string, text string")
    got = C.parsed(C.formatted(frame, best=9)).collect()
    assert sorted((str(r.tree), [t.text for t in r.turns]) for r in got) == [("None", ["3"]), ("a", ["2", "7"]), ("a", ["6"]), ("a", ["8"]), ("a/b", ["1"]), ("null", ["5"]), ("~", ["4"])]


def test_parents_of_another_type_and_long_texts(spark):
    rows = [(1, 1, None, "user", "x" * 300_000), (1, 2, "1", "assistant", "y~" * 100_000)]
    got = C.parsed(C.formatted(spark.createDataFrame(rows, "tree int, msg int, parent string, role string, text string"))).collect()
    assert [[t.text for t in r.turns] for r in got] == [[rows[0][4], rows[1][4]]] and got[0].learnt == [rows[1][4]]
