"""Conversations brought into turns of user and assistant by the cheapest edits.

Each row of a conversation is sound or has a fault: blank (no character but white space), duplicate (role and text
stood in it before) or truncated (its last character is none of . ! ?); the first of these counts. Rows are kept,
given another role, deleted (blank and duplicate ones must be), or rows without text are inserted, so that the first letters of the
roles read (s?(ua)+)?. The edits of least total cost are taken; of several the one whose letters K, R, D, I come first.

What the edits are follows from a conversation's signature alone, a letter for the role and fault of each row. A
task's signatures go, sorted, into a prefix trie. A node holds a layer of the dynamic programme: for what the repaired
roles end with so far (nothing, s, u or a), the least cost, the rank of its letters among those of the layer, and
the step before. A layer is computed once for all signatures that begin alike, and a node where signatures end gives their
answer. Letters are compared by these ranks: a row's letters are inserts and one K, R or D, so no row's letters
begin another's and two paths through as many rows are told apart within them; what a path ends with follows
from its letters, so no two ends of a layer share them. Each row costs the same bounded work, however long the conversation.

Only the conversations are shuffled, once, to bring their rows together; signatures stay where they are, so one that
many conversations share is never a hot key. A conversation is a unit of work: its rows are in one task, since its result is one row.

Defined results: a null role or text counts as one space; rows stand by turn, nulls first, then by role and text; rows of a
null id are one conversation; a role is judged by its first letter, case counts; conversations without rows give zeros, no edits and no
turns; repeated rows are duplicates of each other; texts and conversations of any length are worked on whole; an empty
table gives an empty table; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import tidy

#: What the repaired roles end with so far.
NOTHING, S, U, A = range(4)
#: Where a user or an assistant leads, whichever of them may follow.
NEXT = {NOTHING: U, S: U, U: A, A: U}
NAMES = {U: "user", A: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: Letters of signatures: roles s, u, a and o (any other), as capitals where the row is truncated, and rows that have to go.
GONE = "x"
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
LEGAL = ("su", "ua", "au")

Layer = dict[int, tuple[int, int, int, str]]  # by end: cost, rank, end before, letters of the row
START: Layer = {NOTHING: (0, 0, NOTHING, "")}


def keeps(end: int, role: str) -> int | None:
    """What the roles end with if a row of this role is kept, or None."""
    if role == "s":
        return S if end == NOTHING else None
    return NEXT[end] if role == "ua"[NEXT[end] == A] else None


def extended(layer: Layer, letter: str) -> Layer:
    """The layer after a row more."""
    found: dict[int, tuple[int, int, str, int]] = {}

    def offer(to: int, cost: int, rank: int, letters: str, end: int) -> None:
        if to not in found or (cost, rank, letters) < found[to][:3]:
            found[to] = (cost, rank, letters, end)

    for end, (cost, rank, _, _) in layer.items():
        offer(end, cost + DELETE, rank, "D", end)  # before an insert, never after: D comes first
        if letter == GONE:
            continue
        at, paid, letters = end, cost + TRUNCATED * letter.isupper(), ""
        for _ in range(3):  # a third insert would end as the first does
            to = keeps(at, letter.lower())
            if to is not None:
                offer(to, paid, rank, letters + "K", end)
            offer(NEXT[at], paid + REROLE, rank, letters + "R", end)
            at, paid, letters = NEXT[at], paid + INSERT, letters + "I"
    order = sorted(found, key=lambda to: (found[to][1], found[to][2]))
    return {to: (found[to][0], i, found[to][3], found[to][2]) for i, to in enumerate(order)}


class Trie:
    """Signatures by their letters; each node has the layer after them, the node before, and how many letters lead to it."""

    #: Nodes from which on a task starts a new trie.
    MOST = 200_000

    def __init__(self):
        self.layers, self.before, self.next, self.answers = [START], [0], {}, {}

    def __len__(self) -> int:
        return len(self.layers)

    def insert(self, signature: str) -> int:
        node = 0
        for letter in signature:
            key = node, letter
            if key not in self.next:
                self.next[key] = len(self.layers)
                self.layers.append(extended(self.layers[node], letter))
                self.before.append(node)
            node = self.next[key]
        return node

    def answer(self, node: int) -> tuple[int, str]:
        """Cost and letters of the cheapest edits of the signatures that end at a node."""
        if node not in self.answers:
            closing = {NOTHING: "", A: "", U: "I", S: "II"}
            cost, _, end = min((cost + INSERT * len(closing[end]), rank, end) for end, (cost, rank, _, _) in self.layers[node].items())
            letters, at = [closing[end]], node
            while at:
                _, _, before, own = self.layers[at][end]
                letters.append(own)
                at, end = self.before[at], before
            self.answers[node] = cost, "".join(reversed(letters))
        return self.answers[node]


def answered(signatures: Iterable[str], trie: Trie) -> dict[str, tuple[int, str]]:
    return {s: trie.answer(trie.insert(s)) for s in sorted(set(signatures))}


def signature(roles: list[str], texts: list[str]) -> tuple[str, int, int, int]:
    """The letters of the rows, and how many are blank, duplicate and truncated."""
    seen: set[tuple[str, str]] = set()
    letters, blank, duplicate, truncated = [], 0, 0, 0
    for role, text in zip(roles, texts, strict=True):
        said = text.rstrip(BLANKS)
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if not said:
            blank += 1
            letter = GONE
        elif (role, text) in seen:
            duplicate += 1
            letter = GONE
        elif said[-1] not in ENDS:
            truncated += 1
            letter = letter.upper()
        seen.add((role, text))
        letters.append(letter)
    return "".join(letters), blank, duplicate, truncated


def edited(roles: list[str], texts: list[str], audit: str) -> Iterator[tuple[str, str]]:
    """Roles and texts after the edits."""
    end, row = NOTHING, 0
    for edit in audit:
        if edit == "K":
            end = S if roles[row][:1] == "s" else NEXT[end]
            yield roles[row], texts[row]
        elif edit != "D":
            end = NEXT[end]
            yield NAMES[end], texts[row] if edit == "R" else ""
        row += edit != "I"


def gathered(rows: DataFrame, copies: Column | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id_col and turns, the rows of each conversation in order. copies: how often a row stands; a conversation stays if all its rows go."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    row = F.struct(F.col(turn_col).cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"))
    often = F.array(row) if copies is None else F.array_repeat(row, copies)
    return rows.select(F.col(id_col).alias("id"), often.alias("turns")).groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("turns"))).alias("turns")).withColumnRenamed("id", id_col)


NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repaired(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id_col, NUMBERS, audit (the letters of the edits) and repaired (the turns after them) of each gathered conversation. gaps counts turns
    missing between the first and the last, illegal the neighbours whose roles do not follow each other."""

    def run(batches):
        trie = Trie()
        for batch in batches:
            trie = Trie() if len(trie) > Trie.MOST else trie
            turns = batch.column(1)
            at = turns.offsets.to_pylist()
            turn, role, text = (turns.values.field(i).to_pylist() for i in range(3))
            own = [(role[a:z], text[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)]
            signed = [signature(*x) for x in own]
            edits = answered((s[0] for s in signed), trie)
            numbers, audits, out = [], [], []
            for (roles, texts), (letters, *faults), a, z in zip(own, signed, at[:-1], at[1:], strict=True):
                known = {t for t in turn[a:z] if t is not None}
                cost, audit = edits[letters]
                illegal = sum(x[:1] + y[:1] not in LEGAL for x, y in zip(roles[:-1], roles[1:], strict=True))
                numbers.append((max(known) - min(known) + 1 - len(known) if known else 0, *faults, illegal, cost))
                audits.append(audit)
                out.append([{"role": r, "text": t} for r, t in edited(roles, texts, audit)])
            columns = [pa.array(c, pa.int64()) for c in zip(*numbers, strict=True)] or [pa.array([], pa.int64())] * len(NUMBERS)
            said = pa.array(out, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(audits, pa.string()), said], names=["id", *NUMBERS, "audit", "repaired"])

    ddl = conversations.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"id {ddl}", *(f"{c} long" for c in NUMBERS), "audit string", "repaired array<struct<role:string,text:string>>"])
    return conversations.select(F.col(id_col).alias("id"), "turns").mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
