import public_tokenizers
import pytest

from shelfmark.llm import token_counts
from shelfmark.llm.byte_bpe import tokenizer
from shelfmark.llm.queries import RANKS, op6_token_counts

PATTERN = public_tokenizers.PATTERN


def brute(text, starts, rule):
    encoding = tokenizer(RANKS, PATTERN)
    data, counts, crossing, at = text.encode(), [0] * len(starts), 0, 0
    bounds = [*starts, len(text)]
    for token in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(token))
        first = len(data[: at + 1].decode("utf-8", "ignore")) if (data[at] & 0xC0) == 0x80 else len(data[:at].decode())
        if (data[at] & 0xC0) == 0x80:
            first = len(data[:at].decode("utf-8", "ignore"))
        end = at + size
        last = len(data[:end].decode("utf-8", "ignore"))
        last = last - 1 if end == len(data) or (data[end] & 0xC0) != 0x80 else last
        at = end
        where = [max(k for k, s in enumerate(starts) if s <= c) for c in range(first, last + 1)]
        crossing += where[0] != where[-1]
        to = where[0] if rule == "first" else where[-1] if rule == "last" else max(sorted(set(where)), key=lambda k: (where.count(k), -k))
        counts[to] += 1
    assert bounds
    return counts, crossing


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_lines_against_brute_force(spark, rule):
    texts = ["", None, "a\nb\n", "one two\n \n\n\n three\n", "日本\n語🙂\n\n\n x", "word " * 5000 + "\nend", "\n\n\n\n"]
    rows = [(i, t, t) for i, t in enumerate(texts)] + [(3, texts[3], "")]
    got = token_counts.by_line(spark.createDataFrame(rows, "doc_id long, text string, tokens string"), RANKS, PATTERN, rule).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id] or ""
        lines = text.split("\n")
        starts, at = [], 0
        for line in lines[: len(lines) - (lines[-1] == "" and len(lines) > 1)]:
            starts.append(at)
            at += len(line) + 1
        assert r.starts == starts
        assert (list(r.tokens), r.n_crossing) == brute(text, starts, rule)
        assert r.n_tokens == sum(r.tokens)


def test_fields(spark):
    rows = [(1, "title", "body text"), (None, None, "x"), (2, "", "")]
    got = {r.doc_id: r for r in token_counts.by_field(spark.createDataFrame(rows, "doc_id long, a string, b string"), ["a", "b"], RANKS, PATTERN).collect()}
    assert got[1].starts == [0, 6] and sum(got[1].tokens) == got[1].n_tokens and got[None].starts == [0, 1] and got[2].n_tokens == 1


def test_empty_table(spark):
    assert token_counts.by_line(spark.createDataFrame([], "doc_id long, text string"), RANKS, PATTERN).count() == 0


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r for r in op6_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        starts = [0, *(k + 1 for k, c in enumerate(text) if c == "\n" and k + 1 < len(text))]
        lengths = [len(x) for x in tokenizer(RANKS, PATTERN).decode_tokens_bytes(tokenizer(RANKS, PATTERN).encode_ordinary(text))]
        data = text.encode()
        lead = [len(data[:k].decode("utf-8", "ignore")) for k in range(len(data) + 1)] if len(data) < 3000 else None
        if lead is not None:
            counts, crossing = brute(text, starts, "first")
            assert (got[i].section_tokens, got[i].most_tokens, got[i].n_crossing) == (",".join(map(str, counts)), max(counts), crossing)
        assert (got[i].n_tokens, got[i].n_sections) == (len(lengths), len(starts))
        assert sum(map(int, got[i].section_tokens.split(","))) == len(lengths)
