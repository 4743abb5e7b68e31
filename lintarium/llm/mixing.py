"""Mixing sources to target weights: repetition rates by source, whole copies and one drawn copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintarium.llm.common import text_of, word_count, written

#: Documents in a stratum, on average.
STRATUM = 128


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of the parts; null counts as the empty text."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(F.encode(joined, "UTF-8")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target of each source of a table (source, source_size), one row a source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times all sizes. A target
    stops at ``most`` times its source's size, and what is over is dealt to the others by weight until none is
    above: sources sorted by size for each weight are capped as long as their cap is below what is dealt to them.
    A source of size zero has target zero. The windows see one row a source.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy(F.lit(0))
    s = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(most))
    s = s.withColumn("_ratio", F.col("_cap") / F.col("_w")).withColumn("_total", F.sum("source_size").over(every) * F.lit(share))
    by_ratio = Window.orderBy("_ratio", F.asc_nulls_last("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    s = s.withColumn("_level", level)
    # The level is that of the first source whose cap is not below it; all before it are capped.
    s = s.withColumn("_at", F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_level"))).over(every))
    return s.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_at._level") * F.col("_w"), F.col("_cap"))).cast("double").alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """How often the mix takes each document: (id, size, source, source_size, target, copies, taken).

    Size is the number of words, zero for null text. Each document is taken floor(target / source_size) times, and
    once more with the fraction as probability. The draws are seeded by hashes and stratified: a source's documents
    fall by hash into strata of about ``STRATUM``, a stratum is ordered by size and sampled at even steps from a
    hashed start. So each document keeps its probability, the words taken come near the target even where a few
    documents hold most words, and no task gets more than a stratum of a hot source. Reruns agree; repeated rows of
    one id are drawn apart. Null is a source of its own. An empty table gives an empty result. ``carry`` adds the whole
    row in a struct ``_row``; then sizes are not written but counted twice, so that the text moves once.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(text_of(docs, text_col)).alias("size"), F.crc32(F.encode(text_of(docs, text_col), "UTF-8")).alias("_crc"), *([F.struct("*").alias("_row")] if carry else []))
    rows = rows if carry else written(rows, "mix-sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    sums = written(sums, "mix-sources")  # one row a source
    t = targets(sums.select("source", "source_size"), weights, share, most)
    rates = t.join(sums.select("source", "_docs"), t["source"].eqNullSafe(sums["source"])).select(
        t["source"].alias("_source"), t["source_size"], t["target"], F.ceil(F.col("_docs") / STRATUM).alias("_strata"),
        F.when(t["source_size"] > 0, t["target"] / t["source_size"]).otherwise(F.lit(0.0)).alias("_rate"),
    )
    rows = rows.join(rates, rows["source"].eqNullSafe(rates["_source"]))
    rows = rows.withColumn("_u", _unit(F.lit(seed), F.col("_id"))).withColumn("_stratum", F.floor(F.col("_u") * F.col("_strata")).cast("long"))
    w = Window.partitionBy("source", "_stratum").orderBy("size", "_u", F.asc_nulls_last("_id"), "_crc")
    rank, start, fraction = F.row_number().over(w), _unit(F.lit(seed), F.col("source"), F.col("_stratum")), F.col("_rate") - F.floor("_rate")
    drawn = F.floor(start + rank * fraction) - F.floor(start + (rank - 1) * fraction)
    out = rows.withColumn("copies", (F.floor("_rate") + drawn).cast("long"))
    return out.select(F.col("_id").alias(id_col), "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["_row"] if carry else []))


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents with all their columns, whatever their names, each row as often as ``mix`` takes it.

    Null and empty texts have size zero: they are taken as often as their source's rate says and add no words. Rows that
    share an id are drawn one by one, ordered by their texts; an empty table gives an empty result.
    """
    drawn = mix(docs, carry=True, **how).where("copies > 0")
    return drawn.select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_k"), "_row").select("_row.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


_UNIT = "CAST(('0x' || substr(md5({}), 1, 13)) AS BIGINT) / 4503599627370496.0"
ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source
), x AS (
  SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / w AS ratio, 1.5 * sum(source_size) OVER () AS total FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM x
), t AS (
  SELECT source, source_size, docs,
         least(cap, coalesce((SELECT arg_min(level, ratio) FROM l AS m WHERE m.ratio >= m.level) * w, cap)) AS target
  FROM l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t
), u AS (
  SELECT d.doc_id, d.size, d.source, r.source_size, r.target, r.rate,
         {_UNIT.format("'mix:' || coalesce(CAST(doc_id AS VARCHAR), '')")} AS u, ceil(r.docs / 128.0) AS strata
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), k AS (
  SELECT *, CAST(floor(u * strata) AS BIGINT) AS stratum FROM u
), n AS (
  SELECT *, row_number() OVER (PARTITION BY source, stratum ORDER BY size, u, doc_id NULLS LAST) AS rank, rate - floor(rate) AS f,
         {_UNIT.format("'mix:' || coalesce(source, '') || ':' || CAST(stratum AS VARCHAR)")} AS start FROM k
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * (floor(rate) + floor(start + rank * f) - floor(start + (rank - 1) * f)) AS BIGINT) AS taken
FROM n
"""
