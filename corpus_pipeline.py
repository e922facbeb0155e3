"""A corpus pipeline of five stages: language, near duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir), docs with the columns of `documents`, and works on all that the stage before
kept. All but the last return those columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontam, langid, ngram_join, secrets
from graphloom.llm.common import column_names, materialize

#: SQL can't express the classifier, so run() is tested against a plain version instead.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach; `und` goes."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group of near duplicates."""
    return ngram_join.distinct_documents(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by their kinds."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its tokens' count and digest, and the digest of what they decode to."""
    coded = bpe.encode_documents(docs)
    ids, decoded = coded.columns[-2:]
    n, ids_digest, decoded_digest = column_names(docs, "n_tokens", "ids_sha256", "decoded_sha256")
    return coded.withColumns(
        {n: (F.octet_length(ids) / 4).cast("long"), ids_digest: F.sha2(ids, 256), decoded_digest: F.sha2(decoded, 256)}
    ).drop(ids, decoded)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("secret_spans", secret_spans),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
