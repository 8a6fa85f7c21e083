"""Corpus pipeline: quality filter, exact and near duplicates, benchmark decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. SQL can't express the trained classifier or the segmentation, so there is no ORACLE_SQL; the tests
compare the stages with brute force.

A null text counts as an empty one throughout; empty texts are equal to each other, so one of them stays. Duplicates are
told and dropped row by row, so rows that repeat a doc_id with other texts stay and those with the same text don't. A row
without a doc_id is a document like others, but in the decontamination stage, which it passes. Extra columns, whatever their names, go along up to the last stage. Empty tables give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm import decontaminate, exact, jaccard, quality, sentencepieces
from lexmill.llm.text import cut, documents, ensure_checkpoints, semi_join, with_places


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality 1; empty ones, scored 0.5, stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.good_documents(docs, labels)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    rows, places = with_places(docs)
    gone = cut(exact.exact_dedup(rows, places).filter("not kept").select(*places))
    return semi_join(rows, gone, places, "left_anti").drop(*places)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates."""
    rows, places = with_places(docs)
    gone = cut(jaccard.clustered(rows, places).filter("not kept").select(*places))
    return semi_join(rows, gone, places, "left_anti").drop(*places)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    gone = cut(decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct())
    return semi_join(docs, gone, "doc_id", "left_anti")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids, which decode to the text."""
    return sentencepieces.encode(docs).select("doc_id", F.size("ids").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", leak_stage),
    ("SentencePiece encoding and decoding", token_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet to the shared checkpoint folder and read again."""
    docs = documents(spark, sf_dir)
    ensure_checkpoints(docs)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
