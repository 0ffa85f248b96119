"""Operator 9: exact dedup by 128-bit content hash, with the bytes compared inside every hash group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import WHITE, documents


def squeezed(text: Column) -> Column:
    """The text without ASCII white space."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def content_hash(norm: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(norm.cast("binary")))


def exact_groups(docs: DataFrame, hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space. Of equal texts the one
    with the most code points stays, then the smallest doc_id.

    The aggregate's key is (hash, normalised text): Spark compares the bytes of
    the texts wherever hashes agree, so a collision makes two groups. Copies
    collapse inside each map task first, so a group with a third of all rows
    sends one row per task. The members then join their group on (hash, sha256),
    a plain join that AQE splits where a group is hot; its keys carry no text.

    Null text counts as empty; all empty texts are one group. A null doc_id
    loses to any id; where a group has null ids only, keep_id is null and its
    rows are all kept. Rows repeated with one doc_id are rows of one document:
    each counts in group_size and all carry the same decision. An empty table
    gives no rows. Other columns of ``docs`` are not looked at.
    """
    rows = documents(docs).select(
        "doc_id", F.char_length("text").alias("len"), squeezed(F.col("text")).alias("norm"))
    rows = rows.withColumn("h", hash_of(F.col("norm"))).withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256))
    groups = rows.groupBy("h", "norm", "sha").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct((-F.col("len")).alias("l"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"))
              ).alias("best"))
    groups = groups.select(F.col("h").alias("gh"), F.col("sha").alias("gsha"), "group_size",
                           F.col("best.id").alias("keep_id"))
    return rows.select("doc_id", "h", "sha").join(
        groups, (F.col("h") == F.col("gh")) & (F.col("sha") == F.col("gsha"))
    ).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
             F.col("sha").alias("text_sha256"))


def keep_exact(docs: DataFrame) -> DataFrame:
    """The documents that stay, one row per distinct text, with all columns of ``docs``.

    A document is an id with its text, so of several texts with one id each stays
    or goes by its own group; a text that only documents without an id have is
    represented by one of them. Of rows that agree in the kept id and in the text
    without white space the longest stays, then the smallest row. The aggregate
    is partial in each map task, so a hot text sends one row per task.
    """
    keep = exact_groups(docs).select("keep_id", F.col("text_sha256").alias("__keep")).distinct()
    cols = docs.columns
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("__sha", F.sha2(squeezed(text).cast("binary"), 256))
    rows = rows.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col("keep_id")) & (F.col("__sha") == F.col("__keep")),
                     "left_semi")
    rank = F.struct(-F.char_length(text), *[F.col(f"`{c}`").cast("string") for c in cols])
    best = F.min_by(F.struct(*[F.col(f"`{c}`") for c in cols]), rank).alias("__row")
    return rows.groupBy(F.col("doc_id").alias("__id"), "__sha").agg(best).select("__row.*")


# Deleting white space with six plain replaces would read worse than this in DuckDB; the result is the same.
EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
