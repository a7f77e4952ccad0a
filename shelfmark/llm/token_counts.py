"""Tokens attributed to the fields or sections of a document.

A document is encoded once, whole. The byte span of each token is joined with the
spans of the sections: sections are sorted and do not overlap, so the interval
join is a binary search. A token that crosses a boundary goes, by ``rule``, to the
section of its first character ("first"), of its last ("last"), or of most of its
characters ("most", the earlier of equals). The spans count code points.

The pattern must match all of a text, as those of byte-level encodings do.

Defined results: null text counts as empty: one empty section and no tokens; texts of any length are
encoded whole; repeated rows give repeated rows; a null id is kept, and ids may have any type; an empty table
gives an empty table; further columns are left out, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import cached, pieces, tidy
from .byte_bpe import token_bytes, tokenizer

RULES = ("first", "last", "most")


def token_lengths(path: str) -> np.ndarray:
    return cached(f"token lengths {path}", lambda: np.array([len(t) for t in token_bytes(path).to_pylist()], np.int64))


def attribute(data: np.ndarray, ids: np.ndarray, lengths: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many cross a boundary. data: a text's bytes; starts: where sections begin, in code points."""
    ends = np.cumsum(lengths[ids])
    at = np.cumsum((data & 0xC0) != 0x80)  # code points up to and with each byte
    if not len(ids):
        return np.zeros(len(starts), np.int64), 0
    first = at[ends - lengths[ids]] - 1
    last = at[ends - 1] - 1
    a = np.searchsorted(starts, first, side="right") - 1
    z = np.searchsorted(starts, last, side="right") - 1
    to = z if rule == "last" else a.copy()
    if rule == "most":
        bounds = np.append(starts, at[-1])
        for i in np.flatnonzero(a != z):
            held = [min(bounds[k + 1], last[i] + 1) - max(bounds[k], first[i]) for k in range(a[i], z[i] + 1)]
            to[i] = a[i] + int(np.argmax(held))
    return np.bincount(to, minlength=len(starts)), int((a != z).sum())


def _counted(docs: DataFrame, path: str, pattern: str, rule: str, sections) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches):
        import tiktoken  # noqa: F401

        encoding, lengths = tokenizer(path, pattern), token_lengths(path)
        for rows, data, at in pieces(batches, "text"):
            n_tokens, starts_out, counts_out, crossing = [], [], [], []
            cuts = rows.column(2).to_pylist()
            for i in range(rows.num_rows):
                own = data[at[i] : at[i + 1]]
                ids = encoding.encode_to_numpy(own.tobytes().decode("utf-8"), disallowed_special=())
                starts = sections(own, cuts[i])
                counts, over = attribute(own, ids.astype(np.int64), lengths, starts, rule)
                n_tokens.append(len(ids))
                starts_out.append(starts)
                counts_out.append(counts)
                crossing.append(over)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n_tokens, pa.int64()), pa.array(starts_out, pa.list_(pa.int64())), pa.array(counts_out, pa.list_(pa.int64())), pa.array(crossing, pa.int64())],
                names=["id", "n_tokens", "starts", "tokens", "n_crossing"],
            )

    ddl = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(tidy(run), f"id {ddl}, n_tokens long, starts array<long>, tokens array<long>, n_crossing long")


def by_line(docs: DataFrame, path: str, pattern: str, rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sections are lines, each with the line feed that ends it: id_col, n_tokens, starts, tokens, n_crossing."""

    def lines(data: np.ndarray, _) -> np.ndarray:
        after = np.flatnonzero(data == 10) + 1
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return np.concatenate([[0], at[after[after < len(data)]]])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("array<long>").alias("cuts"))
    return _counted(source, path, pattern, rule, lines).withColumnRenamed("id", id_col)


def by_field(docs: DataFrame, fields: list[str], path: str, pattern: str, rule: str = "first", id_col: str = "doc_id", joint: str = "\n") -> DataFrame:
    """Fields are encoded as one text with ``joint`` after each but the last; a joint belongs to the field before it."""

    def values(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    lengths = [F.length(values(f)) + len(joint) for f in fields]
    cuts, total = [F.lit(0).cast("long")], F.lit(0).cast("long")
    for x in lengths[:-1]:
        total = total + x
        cuts.append(total)
    source = docs.select(F.col(id_col).alias("id"), F.concat_ws(joint, *map(values, fields)).alias("text"), F.array(*cuts).alias("cuts"))
    return _counted(source, path, pattern, rule, lambda _, c: np.array(c, np.int64)).withColumnRenamed("id", id_col)
