"""From raw documents to token ids: quality filter, exact and near deduplication, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, the next one's docs; all but the
last return the columns of docs. Null and empty texts pass the filters unless they are copies of
one another, empty tables stay empty, extra columns go through, rows that repeat an id and a text
are kept or dropped together. Rows without an id cannot be named by a decision of the two
deduplications and stay. Very long texts are read whole by every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, decontaminate, exact_dedup, near_dedup, quality_cnn
from tidemark.llm._runtime import clear, ready, shared_dir, table

#: Scores and near-duplicate components are not for SQL; the stages are tested against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels outside the held-out fold."""
    return quality_cnn.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, case of A-Z aside, the one with the smallest id."""
    return exact_dedup.drop_duplicates(docs, keep="min")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more on shingles of five words, the document with the smallest id."""
    return near_dedup.drop_near_duplicates(docs, shingle_words=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: its token ids, their number, and the digest of the bytes that they decode to."""
    rows = byte_bpe.round_trip(docs)
    return rows.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminated), ("encode", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again; what a stage stored on its way is deleted behind it."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        clear(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
