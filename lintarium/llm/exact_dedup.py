"""Exact duplicates by a content sort: range partitions of normalised bytes, external sort, neighbour comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintarium.llm.common import SPACE, partitions, text_of

#: Leading characters that order the ranges; the digest behind them parts texts that begin alike.
PREFIX = 24


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, salts: int = 64, hot_share: float = 0.25) -> DataFrame:
    """One row per document with the document that stays for its text.

    Two texts are equal when they are the same bytes after white space is deleted. Of equal texts the one with
    the most code points before that stays, then the smallest id; a null id comes last, and of repeated rows with
    one id exactly one is ``kept``. Null text counts as empty, and empty texts are equal to each other. An empty
    table gives an empty result. Other columns are ignored, or with ``carry`` returned in a struct ``_row``.

    Range partitioning samples splitters over (leading bytes, digest, salt); each range is sorted on the whole
    normalised text by Spark's external sort, and the window compares every row with its neighbour in full. A
    first pass counts digests; a group with more than ``hot_share`` of an average partition is salted over
    ``salts`` ranges; what stays of it and how many rows it has come from an aggregate of the hot rows alone. The hot
    list has at most partitions / hot_share digests, so it may be broadcast.
    """
    spark = docs.sparkSession
    norm = F.regexp_replace(text_of(docs, text_col), F.lit(SPACE + "+"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        norm.alias("_norm"),
        F.char_length(text_of(docs, text_col)).alias("_points"),
        *([F.struct("*").alias("_row")] if carry else []),
    ).withColumns({"_prefix": F.substring("_norm", 1, PREFIX), "_hash": F.xxhash64("_norm")})

    counts = rows.groupBy("_hash").agg(F.count("*").alias("_n"))
    n = docs.count()
    hot = counts.where(F.col("_n") > max(16, n * hot_share / partitions(spark))).select(F.col("_hash").alias("_hot"))
    rows = rows.join(F.broadcast(hot), rows["_hash"] == F.col("_hot"), "left")
    rows = rows.withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int")).otherwise(F.lit(0)))

    ranged = rows.repartitionByRange("_prefix", "_hash", "_salt")
    group = Window.partitionBy("_prefix", "_hash", "_salt", "_norm")
    order = group.orderBy(F.desc("_points"), F.asc_nulls_last("_id"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = ranged.select(
        "_id",
        F.sha2("_norm", 256).alias("text_sha256"),
        F.row_number().over(order).alias("_rank"),
        F.first("_id").over(whole).alias("_keep"),
        F.count("*").over(whole).alias("_size"),
        F.col("_salt"),
        *(["_row"] if carry else []),
    )
    # Hot groups are summed up before they move: at most partitions / hot_share rows, a few more where digests collide.
    merged = rows.where("_hot is not null").groupBy(F.sha2("_norm", 256).alias("_sha")).agg(
        F.min(F.struct((-F.col("_points")).alias("p"), F.col("_id").isNull().alias("z"), F.col("_id").alias("id"), F.col("_salt").alias("s"))).alias("_top"),
        F.count("*").alias("_all"),
    )
    out = marked.join(F.broadcast(merged), marked["text_sha256"] == F.col("_sha"), "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_sha").isNull(), F.col("_keep")).otherwise(F.col("_top.id")).alias("keep_id"),
        F.coalesce("_all", "_size").cast("long").alias("group_size"),
        ((F.col("_rank") == 1) & (F.col("_sha").isNull() | (F.col("_top.s") == F.col("_salt")))).alias("kept"),
        "text_sha256",
        *(["_row"] if carry else []),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, whatever their names.

    One row of each text as in ``content_sort``: null and empty texts are one group, ties go to the smallest id, of
    repeated rows one stays, and an empty table gives an empty result.
    """
    return content_sort(docs, id_col, text_col, carry=True).where("kept").select("_row.*")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return content_sort(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm, row_number() OVER w AS rank,
         first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id ASC NULLS LAST)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, rank = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""
