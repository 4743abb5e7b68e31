"""Operators over ordered rows: windows of lines, runs, next events, newest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_windows(lines: DataFrame, size: int, doc: str, line: str = "line_no", text: str = "text") -> DataFrame:
    """(doc, line, window) of every run of ``size`` lines that follow each other in a document."""
    order = Window.partitionBy(doc).orderBy(line)
    cells = [F.col(text), *[F.lead(text, k).over(order) for k in range(1, size)]]
    rows = lines.select(doc, line, *[c.alias(f"_w{k}") for k, c in enumerate(cells)])
    return rows.where(F.col(f"_w{size - 1}").isNotNull()).select(doc, line, F.concat_ws("\n", *[f"_w{k}" for k in range(size)]).alias("window"))


def copies_of_first(windows: DataFrame, doc: str, line: str = "line_no", window: str = "window") -> DataFrame:
    """Every window that occurred before in order of (doc, line), with the place of the first.

    The first occurrences come from a partial aggregate and are joined back, so a window that very many documents share is
    never sorted in one task; large sides of the join can be split at run time.
    """
    key = F.xxhash64(window)
    rows = windows.withColumn("_key", key)
    first = rows.groupBy("_key", window).agg(F.min(F.struct(F.col(doc).alias("d"), F.col(line).alias("l"))).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    first = first.select(F.col("_key").alias("_k"), F.col(window).alias("_w"), "_first")
    out = rows.join(first, (F.col("_key") == F.col("_k")) & (F.col(window) == F.col("_w")))
    return out.where((F.col(doc) != F.col("_first.d")) | (F.col(line) != F.col("_first.l"))).select(doc, line, F.col("_first.d").alias(f"first_{doc}"), F.col("_first.l").alias(f"first_{line}"))


def runs(rows: DataFrame, keys: list[str], order: str, least: int = 1) -> DataFrame:
    """Gaps and islands: (keys, first, last, length) of every run of consecutive numbers with at least ``least`` rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    islands = rows.withColumn("_island", F.col(order) - F.row_number().over(w))
    out = islands.groupBy(*keys, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))
    return out.where(F.col("length") >= least).drop("_island")


def not_followed_by(events: DataFrame, keys: list[str], order: str, kind: Column, follower: Column) -> DataFrame:
    """Rows of a kind whose next row of the same key isn't a follower, or that have none: dead stores and the like."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = events.withColumn("_kind", kind).withColumn("_next", F.lead(F.coalesce(follower, F.lit(False))).over(w))
    return out.where("_kind and not coalesce(_next, false)").drop("_kind", "_next")


def newest(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in an order; Spark cuts each task's rows to ``n`` a key before they move."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def change(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Each value minus that of the row before in the order of its key; null at the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumns({f"{v}_delta": F.col(v) - F.lag(v).over(w) for v in values})
