"""A corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from geoloom.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from geoloom.llm.common import shared_dir
from pyspark.sql import DataFrame, SparkSession


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go; learned from the labels of the same folder."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.keep_last_copies(docs)


def stage_ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8) the smallest doc_id stays."""
    return ngram_join.keep_representatives(docs, words=5, percent=80)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.take_mix(docs)


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    import public_tokenizers

    return bpe.bpe_roundtrip(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", stage_toxicity),
    ("exact_dedup", stage_exact_dedup),
    ("ngram_join", stage_ngram_join),
    ("mixing", stage_mixing),
    ("bpe", stage_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents of `sf_dir`, each stage's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: None: learning, near copies and tokenisation aren't expressible in SQL; tested against brute force.
ORACLE_SQL = None
