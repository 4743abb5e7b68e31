"""What a viewer asks of the history: projects, scans, summaries, differences, trends, heatmaps and editor diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintarium.functions.severity import SEVERITIES, heat, lookup
from lintarium.operators import findings as ops
from lintarium.plans import analytics
from lintarium.sources.history import History

KEYS = ["path", "line", "rule_id", "message"]


def projects(h: History) -> DataFrame:
    """(project, scans, latest) of every project."""
    return h.scans().groupBy("project").agg(F.count("*").alias("scans"), F.max("scan_id").alias("latest"))


def _kept(h: History, project: str) -> DataFrame:
    return h.findings(project).join(h.scans(project).select("scan_id"), "scan_id", "left_semi")


def scan_analytics(h: History, project: str, scan_id: str) -> dict[str, DataFrame]:
    """Counts by severity, dimension and tag, and the top rules and files of a scan."""
    f = h.findings(project).where(F.col("scan_id") == scan_id)
    return {
        "severity": analytics.counts(f, "severity"),
        "dimension": analytics.counts(f, "dimension"),
        "cwe": analytics.tag_counts(f, "cwe"),
        "owasp": analytics.tag_counts(f, "owasp"),
        "top_rules": analytics.top_rules(f, "rule_id", "severity"),
        "top_files": analytics.top_files(f, "path", heat(F.col("severity"))),
    }


def summary(h: History, project: str) -> dict:
    """The latest scan and what changed since the one before: counts by severity, scores and the total."""
    last = [r["scan_id"] for r in h.scans(project).orderBy(F.desc("scan_id")).limit(2).collect()]
    if not last:
        return {"project": project, "latest": None, "delta": None, "parse_failure_total": 0}
    failed = h.scans(project).agg(F.sum("parse_failures").alias("n")).first()["n"]
    out = {"project": project, "latest": last[0], "delta": None, "parse_failure_total": failed or 0}
    if len(last) == 2:
        rows = analytics.delta(_kept(h, project), F.col("scan_id"), "severity", last[1], last[0]).collect()
        s = h.scores(project).groupBy("dimension").agg(*[F.max(F.when(F.col("scan_id") == i, F.col("score"))).alias(n) for i, n in ((last[1], "old"), (last[0], "new"))]).collect()
        out["delta"] = {"previous": last[1], "findings": sum(r["delta"] for r in rows), "severity": {r["severity"]: r["delta"] for r in rows}, "scores": {r["dimension"]: (r["new"] or 0.0) - (r["old"] or 0.0) for r in s}}
    return out


def scan_diff(h: History, project: str, old: str, new: str) -> DataFrame:
    """(path, line, rule_id, message, status) between two scans, in order of the keys."""
    f = h.findings(project)
    return ops.diff(f.where(F.col("scan_id") == old), f.where(F.col("scan_id") == new), KEYS).orderBy(*KEYS)


def trends(h: History, project: str) -> DataFrame:
    """A row a scan with its findings by severity, also for scans without findings."""
    t = analytics.trends(_kept(h, project), "scan_id", "severity", SEVERITIES)
    return h.scans(project).select("scan_id", "captured_at", "label").join(t, "scan_id", "left").fillna(0).orderBy("scan_id")


def heatmap(h: History, project: str, n: int = 25) -> DataFrame:
    """The heaviest files with their findings in each scan, in order of the scans."""
    scans = [r["scan_id"] for r in h.scans(project).select("scan_id").collect()]  # as many as the history keeps
    return analytics.heatmap(_kept(h, project), "scan_id", "path", heat(F.col("severity")), n, scans)


def diagnostics(findings: DataFrame) -> DataFrame:
    """Findings as an editor wants them: lines from 0, severities 1 to 4."""
    level = lookup(F.col("severity"), {"critical": 1, "high": 1, "medium": 2, "low": 3, "info": 4}, 4)
    return findings.select("path", (F.col("line") - 1).alias("line"), level.alias("severity"), F.col("rule_id").alias("code"), "message")
