"""Exact duplicates: 128-bit content hash groups, confirmed byte by byte.

Native DataFrame operations throughout. Nulls count as empty texts, so all of them form one group
with the empty texts. Texts of any length are hashed and compared whole. Ties on the id cannot
occur between different rows of one id; repeated rows of one id count as members of their group
each. A null id is never the one that stays if its group has another. An empty table gives an
empty result. Other columns are left alone.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._runtime import ready, stored, table

NAME = "op4_exact_dedup"


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def normalised(text: Column) -> Column:
    """A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def fingerprints(docs: DataFrame, text_col: str, id_col: str, content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """Per row: doc_id, content_hash (16 bytes), text_sha256."""
    norm = normalised(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), content_hash(norm).alias("content_hash"), F.sha2(norm, 256).alias("text_sha256"))


def _texts(docs: DataFrame, text_col: str, id_col: str, content_hash: Callable[[Column], Column]) -> DataFrame:
    """Per row: doc_id, content_hash, the normalised text."""
    norm = normalised(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), content_hash(norm).alias("content_hash"), norm.alias("norm"))


def _rekeyed(c: str) -> Column:
    """The same key as an expression of its own, so that a join deals both sides out anew and Spark may split a hot key."""
    return F.unhex(F.hex(c))


def exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "min", content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. keep: which id of a group stays, "min" or "max".

    Counts per hash are combined before the shuffle, so a group of any size is one row per task.
    Texts are moved only for hashes that occur more than once, and each task sends the least and
    the greatest text of a hash: they differ exactly if different texts share the hash. Such
    hashes, if there are any, are grouped again by the text itself.
    """
    spark = ready(docs.sparkSession)
    pick = {"min": F.min, "max": F.max}[keep]
    rows = stored(fingerprints(docs, text_col, id_col, content_hash), "exact-rows")
    groups = stored(rows.groupBy("content_hash").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "exact-groups")
    shared = groups.select(_rekeyed("content_hash").alias("content_hash"))
    spread = _texts(docs, text_col, id_col, content_hash).join(shared, "content_hash", "left_semi").groupBy("content_hash").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    clash = stored(spread.where("low <> high").select("content_hash"), "exact-clash")
    sizes = groups.select(_rekeyed("content_hash").alias("content_hash"), "keep_id", "group_size")
    out = rows.join(sizes, "content_hash", "left")
    if not clash.isEmpty():
        out = out.join(clash, "content_hash", "left_anti").unionByName(_regrouped(docs, rows, clash, text_col, id_col, pick, content_hash))
    return out.select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id")).alias("kept"),
        "text_sha256",
    )


def _regrouped(docs: DataFrame, rows: DataFrame, clash: DataFrame, text_col: str, id_col: str, pick: Callable, content_hash: Callable[[Column], Column]) -> DataFrame:
    """Rows of hashes that different texts share, grouped by hash and text."""
    texts = _texts(docs, text_col, id_col, content_hash).join(clash, "content_hash", "left_semi")
    sizes = texts.groupBy("content_hash", "norm").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return texts.join(sizes, ["content_hash", "norm"]).select("content_hash", "doc_id", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")


def without_dropped(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id has a kept row in decided (doc_id, kept), or none at all; rows without an id stay. All columns stay."""
    gone = decided.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone.hint("shuffle_hash"), docs[id_col] == gone["__gone"], "left_anti")


def drop_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "min") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return without_dropped(docs, exact_duplicates(docs, text_col, id_col, keep), id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
