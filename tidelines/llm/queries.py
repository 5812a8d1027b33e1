"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, chat, fingerprints, jaccard, mixing, quality, token_counts, toxicity, warc
from ._common import fresh_path, read_vocabulary, table


def _vocabulary(name: str) -> bytes:
    import public_tokenizers

    return read_vocabulary(public_tokenizers.path(name))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path, least_bytes=100)
    read = warc.read_archives(spark, path)
    page = lambda c: F.when(F.col(c) != "null", F.col(c)).cast("bigint")
    return read.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, books = ann.build_index(table(spark, sf_dir, "embeddings"))
    return ann.search(index, books, index.where(ann.every_fiftieth(F.col("vec_id"))).select("vec_id", "v"), k=5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score_documents(docs, model).select("doc_id", toxicity.held_out(docs["doc_id"]).alias("held_out"), "score", "predicted")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, _vocabulary("piece_bpe_32k.model"), limit=4096).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    # a turn's tokens, and four for its marks
    turns = turns.withColumn("n", token_counts.token_count(turns["text"], _vocabulary("piece_bpe_32k.model")) + 4)
    return chat.digest_windows(chat.format_conversations(turns, budget=1024, history=256, n_tokens_col="n"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.join_components(table(spark, sf_dir, "documents"), width=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source", "n_chars", "copy", "n_copies", F.round("order_key", 9).alias("order_key"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = _vocabulary("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode_documents(encoded, ranks)
    return decoded.select("doc_id", "n_tokens", byte_bpe.ids_digest_column(F.col("token_ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs)).select("doc_id", "score", "keep", "weak_label", "votes")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_ann": op2_ann,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_chat": op5_chat,
    "op6_fingerprints": op6_fingerprints,
    "op7_jaccard": op7_jaccard,
    "op8_mixing": op8_mixing,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_quality": op10_quality,
    "pipeline": pipeline,
}

#: Mixing in SQL: hash-seeded uniform numbers against the Poisson distribution function of each piece of a rate (of 500 at most,
#: so that all its terms lie below 789), then one row by copy.
OP8_SQL = """
WITH counts AS (SELECT source, count(*) AS n_rows FROM documents GROUP BY source),
sums AS (SELECT sum(sqrt(n_rows)) AS all_weight, sum(n_rows) AS all_rows FROM counts),
rates AS (SELECT source, CAST(all_rows AS DOUBLE) * sqrt(n_rows) / (all_weight * n_rows) AS rate FROM counts, sums),
split AS (SELECT source, greatest(1, CAST(ceil(rate / 500) AS INTEGER)) AS pieces, rate / greatest(1, ceil(rate / 500)) AS r FROM rates),
terms AS (SELECT source, k, exp(-r + k * ln(r) - lgamma(k + 1)) AS p FROM split, range(0, 789) AS t(k) WHERE k <= ceil(r + 12 * sqrt(r) + 20)),
steps AS (SELECT source, list(s ORDER BY k) AS steps FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS s FROM terms) GROUP BY source),
keyed AS (SELECT row_number() OVER () AS row, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, d.* FROM documents d),
drawn AS (SELECT row, len(list_filter(steps, lambda s: s <= CAST(CAST('0x' || substr(md5('mix:' || key || CASE WHEN i > 1 THEN '/' || i ELSE '' END), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)) AS n
          FROM keyed k JOIN split s ON k.source IS NOT DISTINCT FROM s.source JOIN steps t ON k.source IS NOT DISTINCT FROM t.source, range(1, pieces + 1) AS r(i)),
counted AS (SELECT row, CAST(sum(n) AS INTEGER) AS n_copies FROM drawn GROUP BY row)
SELECT doc_id, text, lang, source, n_chars, CAST(c AS INTEGER) AS copy, n_copies,
       round(CAST(CAST('0x' || substr(md5('mix/order:' || key || '#' || c), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0, 9) AS order_key
FROM keyed JOIN counted USING (row), range(1, n_copies + 1) AS r(c)
"""

ORACLE_SQL: dict[str, str] = {"op8_mixing": OP8_SQL}
