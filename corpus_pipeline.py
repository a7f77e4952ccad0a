"""A corpus from documents to tokens: each stage works on all that its predecessor kept.

toxicity: documents that score at least TOXIC_FROM go. A null or empty text scores as one without any weighted word,
and stays; of repeated rows all go or all stay.
near_dedup: of each group of near duplicates (85 %, as in op3) the one with the least id stays, all columns as they
are. Null and empty texts are near duplicates of nothing. Of rows equal in id and text, the one that comes first as
JSON stays. Rows without an id never name a group: they go where a row with an id is near, else they stay.
decontamination: documents with an occurrence of a benchmark window go. Null and empty texts have none.
secrets: all spans of op8 in a text are cut out, and n_chars is counted again; a null text stays null, with null n_chars.
byte_bpe: one row for each document: n_tokens, ids_sha256, decoded_sha256. A null text has no tokens.

Everywhere: texts of any length are worked on whole; an empty table passes as an empty table; columns other than
doc_id, text and n_chars pass unread, whatever their names, but for the last stage, whose rows have the columns above.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.staging import staged
from shelfmark.llm import byte_bpe, decontamination, queries, secret_scan, setsketch, toxicity

#: Bytes of a batch that goes to a Python worker, at most: an executor of the pipeline holds what all stages leave in its JVM.
BATCH_BYTES = 2 << 20


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.bound_batches(spark, BATCH_BYTES)
    return toxicity.filtered(docs, queries.toxicity_model(docs, spark, sf_dir), queries.TOXIC_FROM)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.bound_batches(spark, BATCH_BYTES)
    return setsketch.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.bound_batches(spark, BATCH_BYTES)
    return byte_bpe.encoded_digests(docs, queries.RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: Neither the fitted score nor the tokenizer can be said in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
