"""The query of each operator: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseaudit.llm import byte_bpe, centroids, chat, collocations, fingerprint, html_text, language_id, language_model, mixing, ngram_join, ogg, substring_dedup, toxicity
from clauseaudit.llm.common import read_documents


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read_documents(spark, sf_dir), k=3, percent=90)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    more = spark.sql("SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, :text AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)", {"text": tricky})
    return chat.digests(chat.format_chat(turns.unionByName(more)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_documents(spark, sf_dir), columns=["doc_id"])


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(read_documents(spark, sf_dir).select("doc_id", "text"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_documents(spark, sf_dir))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read_documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = substring_dedup.remove(read_documents(spark, sf_dir).select("doc_id", "text"))
    return x.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


def op10_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.store(read_documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_documents(spark, sf_dir)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("centroid")


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_byte_bpe, op2_ngram_join, op3_chat, op4_mixing, op5_lm_score, op6_language_id, op7_fingerprint, op8_toxicity, op9_substring_dedup, op10_media_ogg, op11_collocations, op12_centroids, op13_html_text)}
ORACLE: dict[str, str] = {"op3_chat": chat.SQL, "op11_collocations": collocations.SQL, "op12_centroids": centroids.SQL, "op13_html_text": html_text.SQL}
