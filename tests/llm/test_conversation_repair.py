import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from shelfmark.llm import conversation_repair as C
from shelfmark.llm.queries import op13_conversation_repair

FOLDER = "/root/testdata/sf0.01"


def brute(rows):
    """Cost, letters and repaired rows by trying all edits: rows are (role initial, has to go, truncated)."""
    inserts = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    best = None
    choices = [[(ins, edit) for ins in inserts for edit in (("D",) if gone else ("D", "K", "Ru", "Ra"))] for _, gone, _ in rows]
    for way in itertools.product(*choices, inserts):
        roles, letters, cost = "", "", 0
        for (role, _, truncated), (ins, edit) in zip(rows, way[:-1], strict=True):
            roles += "".join(ins) + ("" if edit == "D" else role if edit == "K" else edit[1])
            letters += "I" * len(ins) + edit[0]
            cost += 3 * len(ins) + {"D": 4, "K": 0, "R": 3}[edit[0]] + 3 * (truncated and edit != "D")
        roles, letters, cost = roles + "".join(way[-1]), letters + "I" * len(way[-1]), cost + 3 * len(way[-1])
        if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, letters) < best[:2]):
            best = cost, letters, roles
    return best


def spelled(signature):
    """The same answer by paths written out: no ranks, no trie."""
    paths = {"": (0, "")}
    follow = lambda end: "a" if end == "u" else "u"

    def widened(paths):
        out = dict(paths)
        for _ in range(3):
            for end, (cost, letters) in list(out.items()):
                got = (cost + 3, letters + "I")
                if follow(end) not in out or got < out[follow(end)]:
                    out[follow(end)] = got
        return out

    for letter in signature:
        after = {}
        for end, (cost, letters) in widened(paths).items():
            options = [(end, cost + 4, letters + "D")]
            if letter != "x":
                more = 3 * letter.isupper()
                options.append((follow(end), cost + 3 + more, letters + "R"))
                if letter.lower() == follow(end) or letter.lower() == "s" and end == "":
                    options.append((letter.lower(), cost + more, letters + "K"))
            for to, c, x in options:
                if to not in after or (c, x) < after[to]:
                    after[to] = (c, x)
        paths = after
    return min(v for end, v in widened(paths).items() if end in ("", "a"))


def test_every_short_signature_against_all_edits():
    trie = C.Trie()
    for n in range(3):
        for letters in itertools.product("suaoSUAx", repeat=n):
            rows = [(c.lower(), c == "x", c.isupper()) for c in letters]
            cost, audit, roles = brute(rows)
            assert trie.answer(trie.insert("".join(letters))) == (cost, audit) == spelled(letters)
            got = list(C.edited([r for r, _, _ in rows], [""] * n, audit))
            assert "".join(r[:1] for r, _ in got) == roles


def test_longer_signatures_against_all_edits_and_written_paths():
    pick = random.Random(5)
    trie = C.Trie()
    for n in (3, 3, 3, 3, 3, 3, 3, 3):
        letters = pick.choices("suaoSUAx", k=n)
        assert trie.answer(trie.insert("".join(letters))) == brute([(c.lower(), c == "x", c.isupper()) for c in letters])[:2]
    signatures = ["".join(pick.choices("suaoSUAOx", k=pick.randrange(30))) for _ in range(3000)]
    got = C.answered(signatures, trie)
    assert got == {s: spelled(s) for s in signatures}


def test_layers_are_computed_once_for_a_shared_prefix(monkeypatch):
    made = []
    plain = C.extended
    monkeypatch.setattr(C, "extended", lambda layer, letter: made.append(letter) or plain(layer, letter))
    signatures = ["uaua", "uaux", "ua", "uaua", "suaUa", "su"]
    C.answered(signatures, C.Trie())
    assert len(made) == len({s[:k] for s in signatures for k in range(1, len(s) + 1)})


def test_a_long_conversation():
    signature = "uaxoU" * 20_000
    trie = C.Trie()
    cost, audit = trie.answer(trie.insert(signature))
    assert len(audit.replace("I", "")) == len(signature) and cost > 0
    short = "uaxoU" * 12
    assert trie.answer(trie.insert(short)) == spelled(short)


def plainly(rows):
    """What the query has to give for rows of (turn, role, text) of one conversation, unordered."""
    blanks = " \t\n\x0b\x0c\r"
    rows = sorted(((-1 << 70 if t is None else t), r, x) for t, r, x in rows)
    seen, faults = [], []
    for _, role, text in rows:
        said = text.strip(blanks)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.append((role, text))
    turns = {t for t, _, _ in rows if t != -1 << 70}
    signature = "".join("x" if f in ("blank", "duplicate") else c.upper() if f else c for f, (_, role, _) in zip(faults, rows, strict=True) for c in [role[:1] if role[:1] in ("s", "u", "a") and role else "o"])
    cost, audit = spelled(signature)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    out, k = [], 0
    for edit in audit:
        role = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if edit == "K":
            role = rows[k][1]
        if edit != "D":
            out.append((role, "" if edit == "I" else rows[k][2]))
        k += edit != "I"
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)


def damaged(rows):
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        held[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return held


COLUMNS = [*C.NUMBERS, "audit", "repaired_sha256"]


def test_query_against_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in op13_conversation_repair(spark, FOLDER).collect()}
    assert got == {k: plainly(v) for k, v in damaged(rows).items()}
    assert len({v[6] for v in got.values()}) > 10


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, tmp_path, empty):
    long = "word " * 60_000 + "."
    rows = [
        (None, None, None, None), (None, 3, "user", "Yes."), (None, None, "user", "Hm."), (1, 5, "tool", "Result."), (1, None, "", "Nobody."), (1, 2, "user", long), (1, 2, "user", long), (1, 2, "assistant", "Cut"),
        (2, 1, "User", "Capital."), (2, 2, "assistant", " "), (3, 9, "system", "Alone."), (4, 1, "user", " \t\n"), (-9, 10**12, "user", "Far?"), (-9, -(10**12), "assistant", "Off!"),
    ]
    rows += [(k, 0, "user", "Only one.") for k in range(100, 160)]
    kept = [] if empty else rows
    spark.createDataFrame([(*r, "x", "y", 1) for r in kept], "conv_id long, turn long, role string, text string, id string, turns string, kind int").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in op13_conversation_repair(spark, str(tmp_path)).collect()}
    want = damaged(kept)
    assert got == {k: plainly(v) for k, v in want.items()}
    if not empty:
        assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got.values()  # all rows dropped
