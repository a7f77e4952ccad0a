"""The queries of the training-corpus operators: (spark, folder of tables) to a DataFrame."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import staged
from . import byte_bpe, chat_format, conversation_repair, decontamination, importance, mpeg_audio, quality_trees, secret_scan, setsketch, substring_dedup, token_counts, toxicity, warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Bytes of a batch that goes to a Python worker, at most: long texts make large batches of few rows.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on the session's batches have at most that many bytes, or fewer where it says so."""
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not size.rstrip("b").isdigit() or not 0 < int(size.rstrip("b")) <= most:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one that holds control strings, formatted and read back."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    back = chat_format.parsed(chat_format.formatted(chat_format.chained(rows.unionByName(odd)), "conv_id"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: Documents that score at least this count as toxic.
TOXIC_FROM = 0.3


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def toxicity_model(docs: DataFrame, spark: SparkSession, folder: str) -> toxicity.Model:
    """Fitted on labels that are not held out."""
    return toxicity.fit(docs, table(spark, folder, "labels").filter(~held_out()))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, spark, folder))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return setsketch.groups(table(spark, folder, "documents"))


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return byte_bpe.encoded_digests(docs, RANKS, public_tokenizers.PATTERN)


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    got = decontamination.hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each line of every document; n_crossing counts tokens that cross a line's end."""
    got = token_counts.by_line(table(spark, folder, "documents"), RANKS, public_tokenizers.PATTERN)
    return got.select("doc_id", "n_tokens", F.size("tokens").cast("long").alias("n_sections"), "n_crossing", F.array_join("tokens", ",").alias("section_tokens"), F.array_max("tokens").alias("most_tokens"))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each passage of a document that other documents hold too: its span in code points, its words, the
    document with the first copy, which may be itself, and whether this is a later copy. Documents without such a passage have no row."""
    got = substring_dedup.repeats(table(spark, folder, "documents")).select("doc_id", F.explode(F.filter("passages", lambda p: p["others"])).alias("p"))
    return got.select("doc_id", F.col("p.first_id").alias("first_doc_id"), F.concat_ws(":", "p.start", "p.end").alias("span"), F.col("p.words").alias("words"), F.col("p.copy").alias("is_copy"))


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    got = secret_scan.scan(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    return got.select("doc_id", *map(count, secret_scan.BASE), F.sha2(secret_scan.said(base), 256).alias("base_sha256"), secret_scan.said(F.col("spans")).alias("spans"))


def op9_media_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Texts padded to a multiple of 64 bytes, packed into MPEG audio and read back."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.octet_length(text)
    padded = F.greatest(F.lit(64), F.ceil(size / 64) * 64).cast("int")
    docs = table(spark, folder, "documents").select("doc_id", size.cast("long").alias("n_bytes"), F.concat(text, F.unhex(F.repeat(F.lit("00"), padded - size))).alias("payload"))
    back = mpeg_audio.unpacked(mpeg_audio.store(docs, "payload").drop("payload"))
    seek = F.sha2(F.array_join("offsets", ","), 256)
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", "version", "layer", "sample_rate", "channels", "n_frames", F.concat_ws("/", "duration_num", "duration_den"), "crc_checked", "crc_errors", seek).alias("feature"),
    )


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written to WARC archives and read back."""
    pages = table(spark, folder, "pages")
    archives, _ = warc.write(pages)
    back = warc.read(spark, archives, payloads=False)
    number = lambda c: F.col(c).cast(pages.schema["page_id"].dataType)
    return back.select(number("page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_page").alias("refers_to"))


def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    """All documents weighed towards the benchmark, and the five in a hundred that are drawn."""
    got = importance.ranks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


def op12_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    stats = staged(quality_trees.statistics(table(spark, folder, "documents")), "statistics")
    forest = quality_trees.fit(stats, table(spark, folder, "labels"))
    return quality_trees.score(stats, forest).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations whose rows are dropped, emptied, cut, repeated or misnamed by a hash of their place, gathered."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", said("conv_id"), said("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    rows = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    return conversation_repair.gathered(rows, F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    got = conversation_repair.repaired(damaged(table(spark, folder, "conversations")))
    said = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return got.select("conv_id", *conversation_repair.NUMBERS, "audit", F.sha2(said, 256).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_toxicity, op3_minhash_near_dedup, op4_byte_bpe, op5_decontamination, op6_token_counts, op7_substring_dedup, op8_secret_scan, op9_media_columns, op10_warc, op11_importance, op12_quality_rules, op13_conversation_repair)}

LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"


def breaks_sql(column: str) -> str:
    """How many marks escaping adds to a text."""
    return " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in ["~", *chat_format.CONTROL])


ORACLES: dict[str, str] = {
    "op1_chat_format": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
                     coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learnt,
                     CAST(sum({len(chat_format.TURN) + 1 + len(chat_format.END)} + length(role) + {breaks_sql("role")} + length(role) - length(replace(role, chr(10), '')) + length(text) + {breaks_sql("text")}) AS BIGINT) AS formatted_chars
              FROM c GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars FROM a""",
    "op3_minhash_near_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.c),
        g AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN g ON g.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op5_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN (SELECT DISTINCT n FROM bw) ON i + n - 1 <= len(w)),
        h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (x, n)),
        c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, octet_length(encode(body)) AS n, sha256(body) AS digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
        FROM f""",
}
