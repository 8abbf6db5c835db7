"""The corpus pipeline: toxic texts go, one document of each near-duplicate group stays, repeated passages are cut, sources are
mixed to their weights, and the rest is encoded.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns the columns of documents; the last
returns digests of the encoded texts, one row for each copy that the mix takes.  Nulls, empty texts, ties and empty tables are
handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clauseaudit.llm import byte_bpe, mixing, ngram_join, substring_dedup, toxicity
from clauseaudit.llm.common import Scratch, read_documents, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the learned classifier does not call toxic."""
    return toxicity.keep_clean(small_batches(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by five-word shingles at a similarity of 0.8."""
    return ngram_join.keep_one(small_batches(docs), k=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of 20 words that start earlier elsewhere."""
    return substring_dedup.clean(small_batches(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's budget of words, in epochs of whole documents."""
    return mixing.draw(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text."""
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: A trained classifier is no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs, scratch = read_documents(spark, sf_dir), Scratch(spark)
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.cut(stage(spark, docs, sf_dir))
        if len(scratch.held) > 1:
            scratch.free(before)
    return STAGES[-1][1](spark, docs, sf_dir)
