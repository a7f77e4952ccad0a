import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.llm import byte_bpe
from shelfmark.llm.arrow_text import coded, uncoded
from shelfmark.llm.queries import RANKS, op4_byte_bpe

PATTERN = public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, ids int, payload string"


def cut(texts):
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts = byte_bpe.pretoken_starts(data, at)
    out = [[] for _ in raw]
    for i, a, z in zip(np.searchsorted(at, starts, side="right") - 1, starts, np.append(starts[1:], len(data)), strict=False):
        out[i].append(bytes(data[a:z]).decode())
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'strevmld  \n\t1²é 　.,!ß漢")), max_size=20), max_size=5))
def test_pretokens_are_those_of_the_pattern(texts):
    assert cut(texts) == [regex.findall(PATTERN, t) for t in texts]


def test_round_trip_with_odd_rows(spark):
    texts = ["", None, "don't  stop\n\n now's", "the the the", "the the the", "日本語 ñandú 🙂", " ", "x" * 3000, "a " * 30000, "<|endoftext|>"]
    rows = [(None if i == 3 else i, t, None, 1, "p") for i, t in enumerate(texts)]
    rows.append(rows[4])
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    encoded = byte_bpe.encode(docs, RANKS, PATTERN)
    assert encoded.columns == ["doc_id", "ids"]
    reference = byte_bpe.tokenizer(RANKS, PATTERN)
    want = sorted((str(r[0]), reference.encode_ordinary(r[1] or "")) for r in rows)
    back = byte_bpe.decode(encoded, RANKS)
    got = back.collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
    assert all(bytes(r.decoded) == reference.decode_bytes(r.ids) for r in got)
    said = {r.doc_id: r for r in byte_bpe.digests(encoded, RANKS).collect()}
    ids = reference.encode_ordinary(texts[2])
    assert said[2].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert said[2].decoded_sha256 == hashlib.sha256(texts[2].encode()).hexdigest() and said[2].n_tokens == len(ids)
    assert said[1].n_tokens == 0 and said[1].ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_digests_are_made_where_ids_are_put_together(spark):
    texts = ["", None, "don't  stop", "the the the", "日本語 ñandú 🙂", "a " * 30000]
    docs = spark.createDataFrame([(None if i == 3 else i, t, None, 1, "p") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = byte_bpe.encoded_digests(docs, RANKS, PATTERN)
    want = byte_bpe.digests(byte_bpe.encode(docs, RANKS, PATTERN), RANKS)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = op4_byte_bpe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan[: plan.index("FlatMapGroupsInArrow")]  # no second worker beside the one that has the ids


def test_a_block_keeps_distinct_words_only():
    block, raw = byte_bpe.Block(), b" the cat and the dog" * 5000
    for _ in range(3):
        block.add(None, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), PATTERN)
    assert sum(map(len, block.words)) == 12
    numbers, words = block.close()
    words = words.to_pylist()
    assert words[0] == b" the" and all(b"".join(words[i] for i in v) == raw for v in numbers)


def test_a_block_keeps_no_batch():
    text, before = "the cat and the dog " * 5000, pa.total_allocated_bytes()

    def batches():  # as they come from the JVM: all columns of a batch lie in one buffer
        sink = pa.BufferOutputStream()
        rows = pa.RecordBatch.from_arrays([pa.array(range(80), pa.int64()), pa.array([text] * 80)], names=["id", "text"])
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_batch(rows)
        yield from pa.ipc.open_stream(sink.getvalue())

    block = next(byte_bpe.blocks_of(batches(), "id", "text", PATTERN))
    held = pa.total_allocated_bytes() - before
    assert block.bytes == 80 * len(text) and held < block.bytes / 4
    assert sum(block.ids, []) == list(range(80)) and sum(v.nbytes for v in block.numbers) < block.bytes / 2


def test_pieces_come_back_in_order(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECE_BYTES", 60)
    monkeypatch.setattr(byte_bpe, "WORDS", 7)
    texts = [None if i % 11 == 0 else f"row {i} of {i * i} " * (i % 7) for i in range(300)]
    docs = spark.createDataFrame([(i, t, None, 1, "p") for i, t in enumerate(texts)], SCHEMA).repartition(2)
    plain = byte_bpe.tokenizer(RANKS, PATTERN)
    got = {r.doc_id: list(r.ids) for r in byte_bpe.encode(docs, RANKS, PATTERN).collect()}
    assert got == {i: plain.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert byte_bpe.digests(byte_bpe.encode(empty, RANKS, PATTERN), RANKS).count() == 0


def test_whole_table_against_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    reference = byte_bpe.tokenizer(RANKS, PATTERN)
    want = {r.doc_id: reference.encode_ordinary(r.text) for r in docs.collect()}
    got = {r.doc_id: list(r.ids) for r in byte_bpe.encode(docs.select("*", F.lit(1).alias("key")), RANKS, PATTERN).collect()}
    assert got == want


OTHER = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""


def test_texts_are_cut_by_the_pattern_given(spark):
    texts = ["I'LL don't 12345  x\r\n\r\n y", "a\x1cb \x85 c", "日本語 1²3", "  ", "x-y_z.", "abc123"]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    for pattern in (OTHER, r"\p{L}+", r"\\s|[a-z]+|."):
        reference = byte_bpe.tokenizer(RANKS, pattern)
        got = {r.doc_id: list(r.ids) for r in byte_bpe.encode(docs, RANKS, pattern).collect()}
        assert got == {str(i): reference.encode_ordinary(t) for i, t in enumerate(texts)}
    assert byte_bpe.GPT2 == PATTERN


def test_many_small_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LEAST_SHARE", 1000)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("the same"), F.hex("id"), F.repeat(F.lit("x y "), 20)).alias("text")).repartition(7)
    reference = byte_bpe.tokenizer(RANKS, PATTERN)
    got = {r.doc_id: list(r.ids) for r in byte_bpe.encode(docs, RANKS, PATTERN).collect()}
    assert got == {r.doc_id: reference.encode_ordinary(r.text) for r in docs.collect()}


def test_a_column_with_the_name_of_the_result_is_replaced(spark):
    frame = spark.createDataFrame([(1, [464], "x", "y"), (2, None, "x", "y")], "doc_id long, ids array<int>, Decoded string, table string")
    got = byte_bpe.decode(frame, RANKS)
    assert got.columns == ["doc_id", "ids", "table", "decoded"]
    assert {r.doc_id: r.decoded and bytes(r.decoded) for r in got.collect()} == {1: byte_bpe.tokenizer(RANKS, PATTERN).decode_bytes([464]), 2: None}


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 20_000)))
def test_coded_numbers(values):
    assert uncoded(coded(np.array(values, np.uint32))).tolist() == values


def test_query_against_the_library(spark):
    reference = byte_bpe.tokenizer(RANKS, PATTERN)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r for r in op4_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = reference.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
