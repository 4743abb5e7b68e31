"""Severities, dimensions, weights and grades as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities in order, their weights in scores and in heatmaps, and grade limits.
SEVERITIES = ("info", "low", "medium", "high", "critical")
SCORE_WEIGHTS = {"info": 0, "low": 1, "medium": 4, "high": 12, "critical": 30}
HEAT_WEIGHTS = {"info": 1, "low": 2, "medium": 5, "high": 10, "critical": 20}
GRADES = (("A", 90), ("B", 80), ("C", 70), ("D", 60))
DIMENSIONS = ("security", "test_quality", "maintainability", "documentation", "complexity")


def lookup(key: Column, table: dict, default=None) -> Column:
    """The table's value for the key, as one CASE that stays in generated code."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def rank(severity: Column) -> Column:
    """Place of the severity in the order; unknown and null severities come below all."""
    return F.coalesce(lookup(severity, {s: i for i, s in enumerate(SEVERITIES)}, -1), F.lit(-1))


def weight(severity: Column) -> Column:
    return lookup(severity, SCORE_WEIGHTS, 0)


def heat(severity: Column) -> Column:
    return lookup(severity, HEAT_WEIGHTS, 0)


def of_rank(r: Column) -> Column:
    return lookup(r, dict(enumerate(SEVERITIES)))


def grade(score: Column) -> Column:
    out = F.when(score >= GRADES[0][1], GRADES[0][0])
    for letter, least in GRADES[1:]:
        out = out.when(score >= least, letter)
    return out.otherwise("F")
