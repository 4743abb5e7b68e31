"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintarium.llm.common import text_of

#: Rows in a numbering block, on average, and the least number of blocks of a shard.
BLOCK_ROWS, LEAST_BLOCKS = 50_000, 64


def _draw(key: Column, shard: int) -> Column:
    """52 bits of the MD5 of key and shard, plus one, as a number in (0, 1]."""
    return (_digits(F.concat(key, F.lit(f"#{shard}"))) + 1) / F.lit(float(1 << 52))


def _digits(text: Column) -> Column:
    """52 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 13), 16, 10).cast("long")


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of the key: each shard draws by hash, and the largest of -weight / ln(draw) wins, then the smaller shard.

    A shard's draw depends on key and shard alone. So a new last shard only takes rows into itself, a removed one only
    gives its own away, and shares follow the weights. A shard of weight zero gets nothing.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    scores = [F.struct((F.lit(float(w)) / -F.ln(_draw(key, i) - F.lit(2.0**-53))).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights) if w > 0]
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return (-best["i"]).cast("int")


def shard(docs: DataFrame, weights: list[float], grown: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, place in the shard and grown shard of every document.

    Returns id, size (UTF-8 bytes of the text, null as none, plus one), text_crc32, law, shard, slot, grown_shard.
    The key is the id as text; a null id is the empty key. Repeated rows go to one shard and get slots of their own.
    Slots count from 0 without gaps: a shard's rows fall into blocks by hash of key and text, blocks are counted, and a
    row's slot is the rows in earlier blocks plus its rank in its block, so no task numbers a whole shard, not even of
    rows that share an id or have none, unless their texts are equal too. Text is read once and not moved. Columns
    of any name are ignored, texts may have any length, and an empty table gives an empty result.
    """
    rows_in_all = docs.count()
    blocks = max(LEAST_BLOCKS, math.ceil(rows_in_all / len(weights) / BLOCK_ROWS))
    key, data = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.encode(text_of(docs, text_col), "UTF-8")
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(data).cast("long") + 1).alias("size"),
        F.crc32(data).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        (rendezvous(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        key.alias("_key"),
    ).withColumn("_block", (_digits(F.concat("_key", F.lit("@"), F.col("text_crc32").cast("string"))) % blocks).cast("int"))
    counts = rows.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    offset = F.sum("_n").over(Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    starts = counts.select(F.col("shard").alias("_s"), F.col("_block").alias("_b"), offset.alias("_start"))
    in_block = Window.partitionBy("shard", "_block").orderBy(F.asc_nulls_last("_id"), "text_crc32", "size")
    ranked = rows.withColumn("_rank", F.row_number().over(in_block))
    out = ranked.join(starts, (F.col("shard") == F.col("_s")) & (F.col("_block") == F.col("_b")))
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_rank") - 1).cast("long").alias("slot"), "grown_shard")


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), [1.0] * 8, [1.0] * 9)


_DIGITS = "CAST(('0x' || substr(md5({}), 1, 13)) AS BIGINT)"


def _best(shards: int) -> str:
    """The shard with the largest -1 / ln(draw), of equal ones the smallest, as SQL over the column k."""
    draws = ", ".join(f"{{'s': 1.0 / -ln(({_DIGITS.format(f"k || '#{i}'")} + 1) / 4503599627370496.0 - 1.1102230246251565e-16), 'i': {-i}}}" for i in range(shards))
    return f"CAST(-(list_max([{draws}])).i AS INTEGER)"


# CRC-32 byte by byte, with its table of 256 made from the polynomial.
ORACLE = f"""
WITH RECURSIVE b(n, step, c) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT n, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM b WHERE step < 8
), t AS (
  SELECT list(c ORDER BY n) AS t FROM b WHERE step = 8
), d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, coalesce(text, '') AS x, hex(encode(coalesce(text, ''))) AS h FROM documents
), c AS (
  SELECT doc_id, k, CAST(strlen(x) + 1 AS BIGINT) AS size,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(strlen(x)), lambda i: CAST(('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2)) AS BIGINT))), lambda a, v: xor(a >> 8, t.t[CAST(xor(a, v) & 255 AS INTEGER) + 1])), 4294967295) AS text_crc32
  FROM d, t
), s AS (
  SELECT *, {_best(8)} AS shard, {_best(9)} AS grown_shard,
         {_DIGITS.format("k || '@' || CAST(text_crc32 AS VARCHAR)")} % greatest({LEAST_BLOCKS}, CAST(ceil(count(*) OVER () / 8 / {BLOCK_ROWS}.0) AS BIGINT)) AS block FROM c
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY block, doc_id NULLS LAST, text_crc32, size) - 1 AS slot, grown_shard
FROM s
"""
