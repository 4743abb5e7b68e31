"""A run from a source tree to a report: scan, parse, rules, suppression, overrides, scores, baseline and history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lintarium.functions.severity import weight
from lintarium.operators import findings as ops
from lintarium.plans import analytics, report
from lintarium.plans.config import Config
from lintarium.plans.rules import Project, analyze
from lintarium.sources import plugins, tree
from lintarium.sources.history import config_hash
from lintarium.sources.facts import parse
from lintarium.sources.tables import local_scratch, written
from lintarium.streaming import watch


@dataclass
class Report:
    findings: DataFrame
    scores: DataFrame
    stats: dict

    def scored(self) -> dict[str, float]:
        return {r["dimension"]: float(r["score"]) for r in self.scores.collect()}

    def render(self, kind: str) -> str:
        more = {"stats": self.stats} if kind == "json" else {}
        return report.render(kind, report.rows_of(self.findings), self.scored(), **more)


def run(files: DataFrame, config: Config | None = None, only: list[str] | None = None, cache: str | None = None, extra: DataFrame | None = None, **history) -> Report:
    """Findings, scores and counts of a table of files; ``extra`` are findings from elsewhere, which are treated alike.

    With ``cache``, a folder of facts, only files that it doesn't know with this content and configuration are parsed.

    Suppressions go before overrides, scores come from what is left, and later filters don't change them. A thousand
    lines are taken as 80,000 bytes.
    """
    config = config or Config()
    known, hits = watch.cached_facts(files, cache, config_hash({**vars(config), "disabled": sorted(config.disabled)})) if cache else (None, None)
    project = Project(files, config.thresholds, given=known, **history)
    raw = analyze(project, only)
    if extra is not None:
        raw = ops.union([raw, extra.select(*raw.columns)])
    if config.disabled:
        raw = raw.where(~F.col("rule_id").isin(*sorted(config.disabled)))
    # Counted on the way to the one table that is written.
    before, after = Observation("before"), Observation("after")
    raw = raw.observe(before, F.count(F.lit(1)).alias("n"))
    marks = ops.directives(project.of("comment").select("project", "path", "line", F.col("attrs")["text"].alias("text")))
    left = ops.suppress(raw, marks).observe(after, F.count(F.lit(1)).alias("n"))
    final = written(ops.override(left, config.overrides, config.severities), "final")
    totals = files.agg(F.count_if(F.col("language").isNotNull()).alias("files"), F.sum(F.when(F.col("language").isNotNull(), F.col("n_bytes"))).alias("bytes")).first()
    failed = project.of("parse_error").count()
    scores = analytics.scores(final, weight(F.col("severity")), (totals["bytes"] or 0) / 80 / 1000)
    suppressed = before.get.get("n", 0) - after.get.get("n", 0)
    return Report(final, scores, {"files_scanned": totals["files"], "parse_failures": failed, "suppressed": suppressed, **({"cache_hits": hits} if cache else {})})


def run_tree(spark: SparkSession, root: str, project: str = "project", config: Config | None = None, only: list[str] | None = None, git: bool = False, cache: str | None = None, since: str | None = None, programs: str | None = None) -> Report:
    """A run over a folder; ``git`` adds its commits and tags, ``since`` names a commit whose public names are compared, and ``programs`` is a folder of plugins."""
    config = config or (Config.load(root) if "://" not in root else Config())
    files = tree.scan(spark, root, project, config.exclude)
    more = {"commits": tree.git_commits(spark, root, project), "tags": tree.git_tags(spark, root, project)} if git else {}
    if since:
        old = tree.scan(spark, tree.snapshot(root, since, local_scratch(spark, "snapshot")), project, config.exclude)
        more["baseline"] = written(parse(old), "baseline")
        then, now = (_version(t) for t in (old, files))
        if then and now:
            more["versions"] = {project: (then, now)}
    found = [plugins.findings(p, root, files, project) for p in plugins.discover(programs)] if programs else []
    return run(files, config, only, cache, ops.union(found) if found else None, **more)


def _version(files: DataFrame) -> str | None:
    """The version that the project's own pyproject.toml declares."""
    row = tree.manifests(files.where("path = 'pyproject.toml'")).select(F.get_json_object("doc", "$.project.version").alias("v")).first()
    return row["v"] if row else None


def filtered(r: Report, baseline: DataFrame | None = None, owasp: list[str] = (), cwe: list[str] = ()) -> Report:
    """The report without what a baseline holds and with the tags asked for; its scores stay."""
    found = ops.taxonomy(r.findings, owasp, cwe)
    if baseline is not None:
        # A baseline that was read from a report names no project and holds for all.
        found = ops.without(found, baseline, [k for k in ("project", "path", "rule_id", "start") if k != "project" or k in baseline.columns])
    return Report(found, r.scores, r.stats)
