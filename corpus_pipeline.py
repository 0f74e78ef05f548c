"""Corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, secret scan, packing.

Each stage is (name, function(spark, docs, sf_dir) -> DataFrame). run() writes every stage's result as Parquet and gives the
next one what it reads back. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.cluster import ship
from lodestone.llm import exact_dedup, ngram_join, packing, quality, secret_scan
from lodestone.llm.common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ship(spark)
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    ship(spark)
    return exact_dedup.without(docs, materialize(exact_dedup.redundant(docs), "marks"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of similar documents, the one with the smallest id stays."""
    ship(spark)
    return exact_dedup.without(docs, materialize(ngram_join.redundant(docs), "marks"))


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    ship(spark)
    return secret_scan.redact(docs, secret_scan.model_of(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of sequences of 1024 tokens."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", near_dedup_stage),
    ("secret_scan", secret_scan_stage),
    ("packing", packing_stage),
]

#: Tokenisation, the classifier and packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
