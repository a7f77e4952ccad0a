"""Benchmark passages in documents, by a prefix-filtered join of exact windows.

Each item gives the windows of ``window`` consecutive words (an item of fewer words is one
window). All words of a window must occur, so one of them, its rarest by the counts over all
documents, is its necessary prefix: document words are joined with these tokens alone. A
candidate must leave room for the whole window before the text's start and end (position
and length bounds), and is then compared word for word.

DataFrame functions only. Windows are broadcast in blocks of at most ``block`` windows, so the
size of a broadcast is bounded, and a larger benchmark takes more scans. Words are compared
with A-Z in lower case; candidates are looked up in full lower case, which is coarser.

Defined results: null and empty texts have no words and no hits; an item without words has no
windows; a null item id is not listed; repeated rows give repeated rows, repeated items count
once; a null document id is kept; texts of any length are read whole, their words as one array; empty tables give empty tables or no hits; further columns
are left out of hits, so their names cannot clash, and kept by decontaminated, whatever their names.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import unused
from ..functions.staging import staged

WINDOW, BLOCK = 10, 100_000
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands after the last word of each text; not a character.
END = "￿"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def cut(text: Column) -> Column:
    """The words, with an empty string before them if the text begins with a separator, and END after them."""
    return F.split(F.concat(F.coalesce(text.cast("string"), F.lit("")), F.lit(" " + END)), SEPARATORS, -1)


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: words (joined by blanks), n, ids of their items."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), cut(lower_ascii(F.col(text_col))).alias("w"))
    rows = rows.select("item", F.filter("w", lambda x: (x != "") & (x != END)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    rows = rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("w"))
    return rows.groupBy(F.array_join("w", " ").alias("words")).agg(F.first(F.size("w")).alias("n"), F.sort_array(F.collect_set("item")).alias("items"))


def rarity(docs: DataFrame, windows: DataFrame, text_col: str, block: int) -> DataFrame:
    """How often each word of the windows, in lower case, stands in the documents: token, often."""
    tokens = staged(windows.select(F.explode(F.split("words", " ")).alias("token")).select(F.lower("token").alias("token")).distinct(), "tokens")
    n_blocks = max(1, -(-tokens.count() // block))
    found = docs.select(F.explode(cut(F.col(text_col))).alias("word")).select(F.lower("word").alias("token"))
    parts = []
    for b in range(n_blocks):
        own = tokens.filter(F.pmod(F.xxhash64("token"), F.lit(n_blocks)) == b)
        parts.append(found.join(F.broadcast(own), "token", "left_semi").groupBy("token").agg(F.count("*").alias("often")))
    return tokens.join(reduce(DataFrame.unionByName, parts), "token", "left").select("token", F.coalesce("often", F.lit(0)).alias("often"))


def prefixed(windows: DataFrame, often: DataFrame) -> DataFrame:
    """The windows with their rarest token and the place of its first occurrence, from 0."""
    words = windows.select("words", "n", "items", F.posexplode(F.split("words", " ")).alias("place", "word")).withColumn("token", F.lower("word"))
    words = words.join(often, "token")
    return words.groupBy("words").agg(F.first("n").alias("n"), F.first("items").alias("items"), F.min(F.struct("often", "token", "place")).alias("rarest")).select("words", "n", "items", F.col("rarest.token").alias("token"), F.col("rarest.place").alias("place"))


def _hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, window: int, block: int) -> DataFrame:
    """What hits returns, with the hash of the text."""
    windows = staged(windows_of(items, item_id, item_text, window), "windows")
    table = staged(prefixed(windows, rarity(docs, windows, text_col, block)), "prefixes")
    n_blocks = max(1, -(-table.count() // block))
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), cut(F.col(text_col)).alias("w"))
    lead = F.when(F.element_at("w", 1) == "", 1).otherwise(0)
    words = source.select("id", "hash", "w", lead.alias("lead"), (F.size("w") - 1 - lead).alias("n_words"), F.posexplode("w").alias("at", "word"))
    # from literals: rows from Python would start workers that idle beside those of other operators
    end = {"n": F.lit(0), "token": F.lit(END), "place": F.lit(0)}
    end_row = table.sparkSession.range(1).select(*(end.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema))
    start = F.col("at") - F.col("place")
    found = []
    for b in range(n_blocks):
        own = table.filter(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == b)
        if b == 0:
            own = own.unionByName(end_row)
        fits = (start >= F.col("lead")) & (start + F.col("n") <= F.col("lead") + F.col("n_words"))
        same = lower_ascii(F.array_join(F.slice("w", start + 1, F.col("n")), " ")) == F.col("words")
        last = (F.col("n") == 0) & (F.col("at") == F.col("lead") + F.col("n_words"))
        joined = words.join(F.broadcast(own), (F.lower("word") == F.col("token")) & (last | ((F.col("n") > 0) & fits & same)))
        span = F.when(F.col("n") > 0, F.struct((start - F.col("lead")).alias("start"), (start - F.col("lead") + F.col("n")).alias("end")))
        found.append(joined.select("id", "hash", "n_words", span.alias("span"), "items", (F.col("n") == 0).cast("int").alias("row")))
    rows = reduce(DataFrame.unionByName, found).groupBy("id", "hash", "n_words").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.collect_set("items").alias("items"), F.sum("row").alias("copies"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["total"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("total")),
        lambda a: a["total"],
    )
    out = rows.select(F.col("id").alias(id_col), "hash", F.col("n_words").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten("items"))).alias("items"), "spans", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy")


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """A row for each row: id_col, n_words, n_hit (words inside occurrences of windows), items (sorted ids), spans (occurrences: start, end in words from 0)."""
    return _hits(docs, items, id_col, text_col, item_id, item_text, window, block).drop("hash")


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The rows of docs without hits."""
    bad = _hits(docs, items, id_col, text_col, item_id, item_text, window, block).filter("n_hit > 0")
    id_of, hash_of = unused(docs.columns, "id", "hash")
    bad = staged(bad.select(F.col(id_col).alias(id_of), F.col("hash").alias(hash_of)).distinct(), "contaminated")
    match = F.col(id_col).eqNullSafe(F.col(id_of)) & (F.xxhash64(text_col) == F.col(hash_of))
    return docs.join(bad, match, "left_anti")
