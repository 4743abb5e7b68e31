"""Scores, counts, trends, heatmaps and deltas over findings and scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintarium.functions.severity import DIMENSIONS, grade


def scores(findings: DataFrame, weight: Column, kloc: float, dimension: str = "dimension", dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(dimension, score, grade): 100 less the weights per thousand lines, between 0 and 100, in single precision.

    The given dimensions are always there, others where they have findings.
    """
    spark = findings.sparkSession
    sums = findings.groupBy(F.col(dimension).alias("dimension")).agg(F.sum(weight).alias("_w"))
    every = spark.createDataFrame([(d,) for d in dimensions], "dimension string").unionByName(sums.select("dimension")).distinct()
    penalty = F.coalesce("_w", F.lit(0)).cast("float") / F.lit(max(kloc, 1.0)).cast("float")
    score = (F.lit(100.0).cast("float") - F.least(F.greatest(penalty.cast("float"), F.lit(0.0).cast("float")), F.lit(100.0).cast("float"))).cast("float")
    return every.join(sums, "dimension", "left").select("dimension", score.alias("score"), grade(score).alias("grade"))


def counts(findings: DataFrame, by: str) -> DataFrame:
    return findings.groupBy(by).agg(F.count("*").alias("n"))


def tag_counts(findings: DataFrame, tags: str) -> DataFrame:
    """(tag, n) over an array column."""
    return findings.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def top_rules(findings: DataFrame, rule: str, severity: str, n: int = 10) -> DataFrame:
    """The rules with most findings, ties by id, with their most common severity (of equally common ones the least).

    Counted by (rule, severity) and then by rule, so both steps add up in the map tasks first.
    """
    pairs = findings.groupBy(rule, severity).agg(F.count("*").alias("_c"))
    best = F.min_by(severity, F.struct((-F.col("_c")).alias("c"), F.col(severity).alias("s")))
    out = pairs.groupBy(rule).agg(F.sum("_c").alias("n"), best.alias(severity))
    return out.orderBy(F.desc("n"), F.asc(rule)).limit(n)


def top_files(findings: DataFrame, file: str, weight: Column, n: int = 10) -> DataFrame:
    out = findings.groupBy(file).agg(F.count("*").alias("n"), F.sum(weight).cast("long").alias("weight"))
    return out.orderBy(F.desc("n"), F.asc(file)).limit(n)


def heatmap(findings: DataFrame, scan: str, file: str, weight: Column, n: int | None = 25, scans: list | None = None) -> DataFrame:
    """(file, findings, weight, peak, last_scan) over all scans, heaviest first, ties by file; with ``scans`` also per_scan, the findings in each of them."""
    by_scan = findings.groupBy(file, scan).agg(F.count("*").alias("_n"), F.sum(weight).alias("_w"))
    out = by_scan.groupBy(file).agg(F.sum("_n").alias("findings"), F.sum("_w").cast("long").alias("weight"), F.max("_n").alias("peak"), F.max(scan).alias("last_scan"), *([F.array(*[F.coalesce(F.sum(F.when(F.col(scan) == s, F.col("_n"))), F.lit(0)) for s in scans]).alias("per_scan")] if scans else []))
    return out.orderBy(F.desc("weight"), F.asc(file)).limit(n) if n else out


def trends(findings: DataFrame, scan: str, severity: str, values: tuple[str, ...]) -> DataFrame:
    """A row for each scan with its findings by severity."""
    each = [F.count_if(F.col(severity) == v).alias(v) for v in values]
    return findings.groupBy(scan).agg(*each, F.count("*").alias("total"))


def delta(findings: DataFrame, scan: Column, severity: str, before, after) -> DataFrame:
    """(severity, old, new, delta) between two scans; a severity that one lacks counts zero there."""
    at = findings.select(F.col(severity), scan.alias("_scan")).where(F.col("_scan").isin(before, after))
    sums = at.groupBy(severity).agg(F.count_if(F.col("_scan") == before).alias("old"), F.count_if(F.col("_scan") == after).alias("new"))
    return sums.withColumn("delta", F.col("new") - F.col("old"))


def worst(findings: DataFrame, rule: str, level: Column) -> DataFrame:
    """(rule, worst, n) of every rule: its gravest finding and how many it has."""
    return findings.groupBy(rule).agg(F.max(level).alias("worst"), F.count("*").alias("n"))


def suites(findings: DataFrame, suite: str, failure: Column, error: Column) -> DataFrame:
    """(suite, tests, failures, errors) of each suite, and of all with a null suite."""
    return findings.rollup(suite).agg(F.count("*").alias("tests"), F.count_if(failure).alias("failures"), F.count_if(error).alias("errors"))
