"""A training corpus from `documents`, in stages that each read what the one before wrote.

quality -> toxicity -> one document of each near-duplicate group -> secrets masked ->
packed into windows. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import jaccard_join, packing, quality, secrets_scan, toxicity
from riskloom.llm.common import read_table
from riskloom.session import shared_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality trees accept."""
    labels = quality.training_rows(read_table(spark, sf_dir, "labels"), 3, 1)
    return quality.keep_good(docs, quality.fit_quality(docs, labels)).select(COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon model does not find toxic."""
    labels = toxicity.training_rows(read_table(spark, sf_dir, "labels"), 5, 0)
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, labels)).select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of their sets of
    five-word shingles."""
    return jaccard_join.keep_one(docs).select(COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked and their length counted anew."""
    masked = secrets_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", one_of_each),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: SQL cannot express the trained stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read back."""
    docs = read_table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage-{n}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
