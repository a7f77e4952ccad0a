"""Conversations formatted from reply trees.

Messages form trees by their parents. Self-joins double the distance that each message
looks up its tree: the n-th one gives every message its ancestor 2 ** n levels up, with the
score and the length of the branch so far. Branches are ranked in each tree by the sum of
their scores, and the chosen ones are spelled out from leaf to root by the same joins, so the
work follows the messages and the length of what is chosen, however deep a tree is.

The template marks turns; control strings inside roles and texts are broken by a ``~`` after
their first character, and a ``~`` is doubled, which ``parsed`` takes back. DataFrame functions
only.

Messages are told apart by tree and id, as they are typed, and numbered once; the joins go by number.

Defined results: a null text or role counts as empty; texts of any length stay whole; of several rows with
one message id in a tree the least by role, then text, then score, then parent stays; a message whose parent
is missing is a root; messages on a cycle, or under one, have no root and are left out; null scores count as
0; branches of one score rank by length, then by the id of their leaf, then by a hash of its role and text; a
null tree is a tree, and is not the one named like it; a message with a null id is a leaf of its own for each
row; an empty table gives an empty table; further columns are left out, so their names cannot clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.staging import staged

TURN, END = "<|turn|>", "<|end|>\n"
# Strings that chat templates give a meaning.
CONTROL = ["<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
BREAKS = "|".join(["~", *(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL)])


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, BREAKS, "~$0")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)~(.)", "$1")


def nodes_of(messages: DataFrame, tree: str, msg: str, parent: str, role: str, text: str, score: str | None) -> tuple[DataFrame, DataFrame]:
    """Messages by number: key, tree, msg, up (the parent's key, if it is there), score, hash; and key, tree, role, text."""
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    alike = messages.schema[msg].dataType == messages.schema[parent].dataType
    of = lambda c: F.col(c) if alike else F.col(c).cast("string")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.when(F.col(msg).isNull(), F.monotonically_increasing_id())
    rows = messages.select(
        F.col(tree).alias("tree"), of(msg).alias("msg"), row.alias("row"),
        F.struct(said(role).alias("role"), said(text).alias("text"), value.alias("score"), of(parent).alias("parent")).alias("m"),
    )
    rows = rows.groupBy("tree", "msg", "row").agg(F.min("m").alias("m"))
    rows = staged(rows.select(F.monotonically_increasing_id().alias("key"), "tree", "msg", "m.*"), "messages")
    # structs are equal if their fields are, nulls too
    there = rows.filter("msg IS NOT NULL").select(F.struct("tree", "msg").alias("above"), F.col("key").alias("up"))
    lower = rows.select("key", "tree", "msg", "score", F.xxhash64("role", "text").alias("hash"), F.struct("tree", F.col("parent").alias("msg")).alias("under"))
    links = staged(lower.join(there, F.col("under") == F.col("above"), "left").select("key", "tree", "msg", "up", "score", "hash"), "links")
    return links, rows.select("key", "tree", "role", "text")


def branches(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Leaves with the score and length of their branch: tree, msg, hash, key, score, n; and for each k (key, up): the ancestor 2 ** k levels up."""
    far = links.select("key", "up", "score", F.lit(1).cast("long").alias("n"))
    most = far.count()
    levels = []
    while 1 << len(levels) <= most:
        open_rows = far.filter(F.col("up").isNotNull())
        if open_rows.isEmpty():
            break
        levels.append(open_rows.select("key", "up"))
        above = far.select(F.col("key").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"), F.col("n").alias("n_more"))
        # branches that have reached their root are done
        farther = open_rows.join(above, "up").select("key", F.col("next").alias("up"), (F.col("score") + F.col("more")).alias("score"), (F.col("n") + F.col("n_more")).alias("n"))
        far = staged(farther.unionByName(far.filter("up IS NULL")), "reach")
    parents = links.select(F.col("up").alias("key")).filter("key is not null").distinct()
    leaves = far.filter("up is null").join(parents, "key", "left_anti").join(links.select("tree", "msg", "hash", "key"), "key")
    return leaves.select("tree", "msg", "hash", "key", "score", "n"), levels


def chosen_paths(links: DataFrame, texts: DataFrame, best: int) -> DataFrame:
    """The messages of the best branches of each tree: tree, leaf, rank, score, at (from 0 at the root), role, text."""
    leaves, levels = branches(links)
    order = W.partitionBy("tree").orderBy(F.desc("score"), F.desc("n"), "msg", "hash")
    leaves = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    path = leaves.select(F.col("key").alias("leaf"), "rank", "score", "n", "key", F.lit(0).cast("long").alias("down"))
    for k, level in enumerate(levels):
        path = staged(path, "paths")
        higher = path.join(level, "key").select("leaf", "rank", "score", "n", F.col("up").alias("key"), (F.col("down") + (1 << k)).alias("down"))
        path = path.unionByName(higher)
    return path.join(texts, "key").select("tree", "leaf", "rank", "score", (F.col("n") - 1 - F.col("down")).alias("at"), "role", "text")


def formatted(
    messages: DataFrame, tree: str = "tree", msg: str = "msg", parent: str = "parent", role: str = "role", text: str = "text",
    score: str | None = None, best: int = 1, learn: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """A row for each chosen branch: tree, rank, score, formatted, loss (spans of the learnt roles' texts in it, in code points)."""
    rows = chosen_paths(*nodes_of(messages, tree, msg, parent, role, text, score), best)
    head = F.concat(F.lit(TURN), F.regexp_replace(escaped(F.col("role")), "\n", "~n"), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("body", escaped(F.col("text"))).withColumn("turn", F.concat("head", "body", F.lit(END)))
    before = F.coalesce(F.sum(F.length("turn")).over(W.partitionBy("leaf").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = before + F.length("head")
    span = F.when(F.col("role").isin(*learn), F.struct(start.alias("start"), (start + F.length("body")).alias("end")))
    turns = rows.select("tree", "leaf", "rank", "score", F.struct("at", "turn", span.alias("span")).alias("t"))
    out = turns.groupBy("leaf").agg(F.first("tree").alias("tree"), F.first("rank").alias("rank"), F.first("score").alias("score"), F.sort_array(F.collect_list("t")).alias("t"))
    loss = F.filter("t.span", lambda s: s.isNotNull())
    return out.select(F.col("tree").alias(tree), "rank", "score", F.array_join("t.turn", "").alias("formatted"), loss.alias("loss"))


def parsed(chats: DataFrame) -> DataFrame:
    """chats with turns (role, text) and learnt (the texts under the loss spans), read back from formatted and loss."""
    pieces = F.split("formatted", re.escape(END), -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    halves = F.transform(pieces, lambda p: F.split(F.substring(p, len(TURN) + 1, 1 << 30), "\n", 2))
    role = lambda h: unescaped(F.regexp_replace(h[0], "(?<!~)((?:~~)*)~n", "$1\n"))
    turns = F.transform(halves, lambda h: F.struct(role(h).alias("role"), unescaped(h[1]).alias("text")))
    learnt = F.transform("loss", lambda s: unescaped(F.col("formatted").substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return chats.withColumn("turns", turns).withColumn("learnt", learnt)


def chained(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Flat conversations as trees without forks: conv, msg, parent, role, text. Equal turns follow each other by role, then text."""
    order = F.row_number().over(W.partitionBy(conv).orderBy(turn, role, text))
    return rows.select(conv, order.alias("msg"), role, text).withColumn("parent", F.col("msg") - 1)
