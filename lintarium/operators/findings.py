"""What happens to findings after the rules: suppression, overrides, baselines, taxonomies and the order of the report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintarium.functions.severity import SEVERITIES, rank
from lintarium.functions.text import glob_regex
from lintarium.sources.tables import written

DIRECTIVE = r"^\s*(?:lint|lintarium):\s*(ignore-file|ignore)\s*(.*)$"


def union(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL of the findings of all rules."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def directives(comments: DataFrame, pattern: str = DIRECTIVE) -> DataFrame:
    """(project if there is one, path, line, rule_id, file_scoped) of every rule named in a suppression comment; ids are compared whole."""
    c = comments.withColumn("_kind", F.regexp_extract("text", pattern, 1)).where("_kind <> ''")
    ids = F.filter(F.transform(F.split(F.regexp_extract("text", pattern, 2), ","), lambda x: F.trim(x)), lambda x: x != "")
    return c.select(*[k for k in ("project", "path", "line") if k in comments.columns], F.explode(ids).alias("rule_id"), (F.col("_kind") == "ignore-file").alias("file_scoped"))


def suppress(findings: DataFrame, suppressions: DataFrame, path: str = "path", line: str = "line", rule: str = "rule_id") -> DataFrame:
    """Findings without those that a directive on their line, the line before or for their file names: a left anti join.

    The join is an equi join on file and rule, and on the project where both sides have one; the lines are the rest of
    its condition.
    """
    scope = [F.col("project").alias("_project")] if "project" in findings.columns and "project" in suppressions.columns else []
    s = suppressions.select(*scope, F.col(path).alias("_path"), F.col(rule).alias("_rule"), F.col(line).alias("_line"), F.col("file_scoped").alias("_file"))
    own = (findings[path] == s["_path"]) & (findings[rule] == s["_rule"])
    if scope:
        own = own & findings["project"].eqNullSafe(s["_project"])
    return findings.join(s, own & (s["_file"] | (s["_line"] == findings[line]) | (s["_line"] == findings[line] - 1)), "left_anti")


def without(findings: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Findings whose key isn't in the baseline; null keys are never in it."""
    return findings.join(baseline.select(*keys).distinct(), keys, "left_anti")


def taxonomy(findings: DataFrame, owasp: list[str] = (), cwe: list[str] = ()) -> DataFrame:
    """Findings with one of the OWASP and one of the CWE tags, whatever their case; an empty list lets all pass."""
    for column, wanted in (("owasp", owasp), ("cwe", cwe)):
        if wanted:
            names = [w.upper() for w in wanted]
            findings = findings.where(F.exists(column, lambda x: F.upper(x).isin(*names)))  # noqa: B023
    return findings


def override(findings: DataFrame, by_glob: list[tuple[str, str, str]] = (), by_rule: dict[str, str] | None = None, path: str = "path", rule: str = "rule_id", severity: str = "severity") -> DataFrame:
    """New severities by (rule, glob, severity), of which the first glob in order that matches counts, else by rule.

    ``ignore`` drops the finding. The globs of the configuration become one CASE expression, so no join is needed.
    """
    by_rule = by_rule or {}
    for _, _, s in by_glob:
        _known(s)
    for s in by_rule.values():
        _known(s)
    new: Column | None = None
    for r, g, s in sorted(by_glob):
        hit = (F.col(rule) == r) & F.col(path).rlike(glob_regex(g))
        new = F.when(hit, s) if new is None else new.when(hit, s)
    for r, s in by_rule.items():
        new = F.when(F.col(rule) == r, s) if new is None else new.when(F.col(rule) == r, s)
    if new is None:
        return findings
    out = findings.withColumn("_new", new).where("_new is null or _new <> 'ignore'")
    return out.withColumn(severity, F.coalesce("_new", severity)).drop("_new")


def _known(severity: str) -> None:
    if severity not in (*SEVERITIES, "ignore"):
        raise ValueError(f"unknown severity {severity!r}")


def in_order(findings: DataFrame) -> DataFrame:
    """By file, offset and rule; end and message make the order total."""
    return findings.orderBy("path", "start", "rule_id", "end", "message")


def with_positions(rows: DataFrame, *keys: str) -> DataFrame:
    """All rows with their position, from 0, in the order of ``keys``, which must be total.

    Ranges of rows are sorted each for itself and written with their place in the range; the sizes of the ranges before
    come to it. No task holds all rows.
    """
    spots = written(rows.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id()), "in-order")
    # The id has the range in its upper bits and the row of the range in its lower 33.
    part = F.shiftright("_at", 33).cast("int")
    before, at = [], 0
    for r in sorted(spots.groupBy(part.alias("p")).count().collect(), key=lambda r: r["p"]):
        before.append((r["p"], at))
        at += r["count"]
    starts = rows.sparkSession.createDataFrame(before, "_part int, _before long")
    placed = spots.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn("position", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before", "_at")


def fails(findings: DataFrame, threshold: str) -> bool:
    """Whether a finding is at least as severe; stops at the first."""
    return not findings.where(rank(F.col("severity")) >= SEVERITIES.index(threshold)).limit(1).isEmpty()


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Each distinct key with status new, resolved or persisting: one full outer join of the distinct keys."""
    a, b = (t.select(*keys).distinct().withColumn(n, F.lit(True)) for t, n in ((old, "_old"), (new, "_new")))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "resolved").otherwise("persisting")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))
