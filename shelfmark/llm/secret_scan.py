"""Secrets in texts: base matches, and weak parts of credentials where others complete them.

Base kinds are reported wherever they stand: ``assign`` (a key word with a value of 8 or more
characters), ``access`` (an access identifier) and ``hex`` (32 or more digits). Weak kinds are the parts of
multipart credentials in ``PATTERNS``. ``LINKS`` says what completes each of them, part by part, and in which
scope (a private key from its first line to its last is whole by itself): ``near`` (within ``reach`` code points: an interval join in bins of positions), ``line``, or ``block``
(lines without a blank one between them). A weak part is reported only if all parts that complete it
are there and do not overlap it.

DataFrame functions only; positions, lines and blocks come from the stretches between matches,
so a text is cut once for each kind. Spans count code points, ends exclusive.

Defined results: null and empty texts have no spans; texts of any length are searched whole; of spans
with one start the kind listed first comes first; repeated rows give repeated rows; a null id is kept, and ids may
have any type; an empty table gives an empty table; further columns are left out of ``scan`` and kept by
``redacted``, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import named, unused
from ..functions.staging import staged

REACH = 400

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KEY_START = r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
#: From the first line of a key to the last, of any length, line ends escaped or not; signs of minus stand in its two header lines alone.
WHOLE_KEY = KEY_START + r"(?:[^-]*Proc-Type:[^-]*DEK-Info:[^\n\\]*)?(?:[^-]*Comment:[^\n\\]*)?[^-]*-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
#: What each kind's matches look like, what a text must hold before it is searched, and what it must match then.
PATTERNS = {
    "assign": (ASSIGN, [], r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    "access": (r"AKIA[A-Z0-9]+", ["AKIA"], None),
    "hex": (r"[0-9a-f]+", [], r"[0-9a-f]{32}"),
    "secret": (r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", ["AKIA", "ASIA"], None),
    "endpoint": (r"https?://[^\s\"'<>]+|(?<![A-Za-z0-9.-])[a-z0-9.-]+\.amazonaws\.com", ["AKIA", "ASIA"], None),
    "temporary": (r"(?<![A-Za-z0-9])ASIA[A-Z0-9]{12,}", ["ASIA"], None),
    "client": (r"[a-z0-9._-]+@[a-z0-9-]+\.iam\.gserviceaccount\.com", ["iam.gserviceaccount.com"], None),
    "private_key": (WHOLE_KEY, ["PRIVATE KEY"], r"-----END [A-Z ]*PRIVATE KEY"),
    "key_start": (rf"(?!{WHOLE_KEY}){KEY_START}(?:\s*[A-Za-z0-9+/=\\\r\n]{{40,}})?", ["PRIVATE KEY"], None),
    "account": (r"AccountName=[a-z0-9]{3,24}", ["AccountKey="], None),
    "account_key": (r"AccountKey=[A-Za-z0-9+/]{86}==", ["AccountKey="], None),
    "sid": (r"(?<![A-Za-z0-9])AC[0-9a-f]{32}(?![A-Za-z0-9])", ["AC"], r"AC[0-9a-f]{32}"),
}
KINDS = list(PATTERNS)
BASE = KINDS[:3]
#: What completes a weak kind: sets of kinds, one of each set in the scope. A kind is completed by reported parts alone, if those come before it here.
LINKS = [
    ("secret", "near", [("access", "temporary")]),
    ("temporary", "near", [("secret",)]),
    ("endpoint", "near", [("access", "temporary"), ("secret", "assign", "hex")]),
    ("private_key", "block", []),
    ("client", "block", [("private_key", "key_start", "hex")]),
    ("key_start", "block", [("client",)]),
    ("account_key", "line", [("account",)]),
    ("account", "line", [("account_key",)]),
    ("sid", "block", [("hex", "assign")]),
]
EMPTY = "array<struct<kind:string,gap:int,size:int,counts:boolean,lines:int,blocks:int>>"


def matches(text: Column, kind: str) -> Column:
    """The stretches before the matches of a kind, with their line ends and blank lines, the matches' lengths, and whether each counts."""
    pattern, words, before = PATTERNS[kind]
    hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kind == "assign":
        counts = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x: F.length(x) >= 8)
    elif kind == "secret":
        counts = F.transform(hit, lambda x: x.rlike("[0-9]") & x.rlike("[a-z]") & x.rlike("[A-Z]"))
    else:
        counts = F.transform(hit, lambda x: F.length(x) >= {"access": 16}.get(kind, 8))
    if kind == "hex":  # short runs would be most of a text: the stretches before long runs alone are kept
        pattern = r"(?<![0-9a-f])[0-9a-f]{32,}"
        hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        counts = F.transform(hit, lambda x: F.lit(True))
    gaps = F.split(text, pattern, -1)
    found = F.transform(
        F.arrays_zip(gaps.alias("gap"), F.transform(hit, F.length).alias("size"), counts.alias("counts")),
        lambda z: F.struct(
            F.lit(kind).alias("kind"), F.length(z["gap"]).alias("gap"), z["size"].alias("size"), z["counts"].alias("counts"),
            F.regexp_count(z["gap"], F.lit("\n")).alias("lines"), F.regexp_count(z["gap"], F.lit(r"\n(?=[ \t\r]*\n)")).alias("blocks"),
        ),
    )
    holds = reduce(Column.__or__, (text.contains(w) for w in words)) if words else F.lit(True)
    return F.when(holds & text.rlike(before) if before else holds, F.filter(found, lambda z: z["size"].isNotNull()))


def parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (row, id, hash, kind, start, end, line, block), one of null kind for each row of docs; computed once."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("hash"))
    none = F.lit(None).cast("struct<kind:string,gap:int,size:int,counts:boolean,lines:int,blocks:int>")
    all_kinds = F.concat(F.array(none), *(F.coalesce(matches(F.col("text"), k), F.array().cast(EMPTY)) for k in KINDS))
    rows = staged(source.select("row", "id", "hash", F.posexplode(all_kinds).alias("i", "m")).select("row", "id", "hash", "i", "m.*"), "matches")
    order = W.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("size")).over(order)
    place = [(end - F.col("size")).alias("start"), end.alias("end"), F.sum("lines").over(order).alias("line"), F.sum("blocks").over(order).alias("block")]
    return rows.select("row", "id", "hash", "kind", "counts", *place).filter(F.col("kind").isNull() | F.col("counts")).drop("counts")


def near(weak: DataFrame, strong: DataFrame, reach: int) -> DataFrame:
    """The weak spans that a strong one of the same row comes within reach of, without overlapping it."""
    first, last = F.floor((F.col("start") - reach) / reach), F.floor((F.col("end") + reach) / reach)
    bins = strong.select("row", F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(first, last)).alias("bin"))
    placed = weak.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach))))
    apart = (F.col("s") >= F.col("end")) | (F.col("e") <= F.col("start"))
    found = placed.join(bins, ["row", "bin"]).filter(apart & (F.col("s") - F.col("end") <= reach) & (F.col("start") - F.col("e") <= reach))
    return found.select(PLACED).distinct()


PLACED = ["row", "kind", "start", "end", "line", "block"]


def within(weak: DataFrame, strong: DataFrame, scope: str) -> DataFrame:
    """The weak spans in whose line or block a strong one stands that does not overlap them."""
    there = strong.groupBy("row", scope).agg(F.min("end").alias("first_end"), F.max("start").alias("last_start"))
    return weak.join(there, ["row", scope]).filter((F.col("first_end") <= F.col("start")) | (F.col("last_start") >= F.col("end"))).select(PLACED)


def linked(found: DataFrame, reach: int) -> DataFrame:
    """The weak spans that all their parts complete."""
    of = lambda *kinds: found.filter(F.col("kind").isin(*kinds)).select(PLACED)
    reported: dict[str, DataFrame] = {k: of(k) for k in BASE}
    out = []
    for kind, scope, needs in LINKS:
        spans = of(kind)
        for some in needs:
            strong = reduce(DataFrame.unionByName, (reported.get(k, of(k)) for k in some))
            spans = near(spans, strong, reach) if scope == "near" else within(spans, strong, scope)
        reported[kind] = spans
        out.append(spans)
    return reduce(DataFrame.unionByName, out)


def _scan(docs: DataFrame, id_col: str, text_col: str, reach: int) -> DataFrame:
    """id, hash (of the text) and spans of each row."""
    found = staged(parts(docs, id_col, text_col), "parts")
    weak = staged(found.filter(~F.col("kind").isin(*BASE)), "weak")  # few, and read for each link
    strong = found.filter(F.col("kind").isin(*BASE)).select(PLACED).join(weak.select("row").distinct(), "row", "left_semi")
    together = linked(weak.select(PLACED).unionByName(staged(strong, "strong")), reach)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    none = [F.lit(None).cast(docs.schema[id_col].dataType).alias("id"), F.lit(None).cast("long").alias("hash")]
    together = together.select("row", *none, "kind", "start", "end", F.lit(0).alias("own"))
    base = found.filter(F.col("kind").isNull() | F.col("kind").isin(*BASE)).select("row", "id", "hash", "kind", "start", "end", F.lit(1).alias("own"))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "end", rank.alias("rank"), "kind"))
    rows = base.unionByName(together).groupBy("row").agg(F.max_by(F.struct("id", "hash"), "own").alias("of"), F.collect_list(span).alias("spans"))
    ordered = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]).cast("int"))
    return rows.select("of.id", "of.hash", ordered.alias("spans"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """A row for each row: id_col and spans, an array of (start, end, rank, kind) sorted by start, then kind as listed."""
    return _scan(docs, id_col, text_col, reach).select(F.col("id").alias(id_col), "spans")


def said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """docs with each stretch of spans that touch or overlap replaced by ``mark``."""
    id_of, hash_of, spans_of = unused(docs.columns, "id", "hash", "spans")
    spans = _scan(docs, id_col, text_col, reach).filter(F.size("spans") > 0)
    spans = spans.groupBy(F.col("id").alias(id_of), F.col("hash").alias(hash_of)).agg(F.first("spans").alias(spans_of))
    joined = docs.join(staged(spans, "spans"), F.col(id_col).eqNullSafe(F.col(id_of)) & (F.xxhash64(text_col) == F.col(hash_of)), "left")
    text = F.col(text_col)

    def step(a: Column, s: Column) -> Column:
        more = F.concat(a["text"], text.substr((a["end"] + 1).cast("int"), (s["start"] - a["end"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(a["end"], s["end"]).alias("end"), F.when((s["start"] <= a["end"]) & (a["text"] != ""), a["text"]).otherwise(more).alias("text"))

    kept = F.aggregate(
        spans_of,
        F.struct(F.lit(0).cast("long").alias("end"), F.lit("").alias("text")),
        step,
        lambda a: F.concat(a["text"], text.substr((a["end"] + 1).cast("int"), F.length(text))),
    )
    out = F.when(F.col(spans_of).isNotNull(), kept).otherwise(text)
    return joined.select(*(out.alias(c) if c == text_col else named(c) for c in docs.columns))
