"""Scan history: findings and scores of every scan by project, labels, retention, and the cache of parsed files."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintarium.operators.sequences import newest
from lintarium.sources.tables import exists

SCANS = "project string, scan_id string, captured_at string, config_hash string, total long, files long, parse_failures long"


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


class History:
    """Parquet tables under one folder that all executors reach, partitioned by project.

    Appends are whole files that Spark commits, so a failed scan leaves nothing that is read: a scan counts once its row
    in ``scans`` is there, which is written last.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def record(self, project: str, findings: DataFrame, scores: DataFrame, files: int = 0, config: dict | None = None, at: datetime | None = None, parse_failures: int = 0) -> str:
        """Appends a scan and returns its id, which sorts by time."""
        when = (at or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        ident = f"{when}-{hashlib.sha256(f'{project}{when}'.encode()).hexdigest()[:6]}"
        keys = {"project": F.lit(project), "scan_id": F.lit(ident)}
        findings.withColumns(keys).write.mode("append").partitionBy("project", "scan_id").parquet(f"{self.path}/findings")
        scores.withColumns(keys).write.mode("append").partitionBy("project", "scan_id").parquet(f"{self.path}/scores")
        total = self.findings(project).where(F.col("scan_id") == ident).count()
        row = [(project, ident, when, config_hash(config or {}), total, files, parse_failures)]
        self.spark.createDataFrame(row, SCANS).coalesce(1).write.mode("append").partitionBy("project").parquet(f"{self.path}/scans")
        return ident

    def _read(self, name: str, schema: str | None = None) -> DataFrame:
        at = f"{self.path}/{name}"
        if not exists(self.spark, at):
            return self.spark.createDataFrame([], schema or "project string, scan_id string")
        reader = self.spark.read.option("basePath", at)
        return reader.parquet(at).withColumns({k: F.col(k).cast("string") for k in ("project", "scan_id") if k in (schema or "project scan_id")})

    def scans(self, project: str | None = None) -> DataFrame:
        """Scans that are kept, oldest first, with their labels."""
        dropped = self._read("dropped", "project string, scan_id string")
        rows = self._read("scans", SCANS).join(dropped, ["project", "scan_id"], "left_anti")
        labels = self._read("labels", "project string, scan_id string, label string, at string")
        rows = labelled(rows, labels)
        return (rows.where(F.col("project") == project) if project else rows).orderBy("scan_id")

    def findings(self, project: str | None = None) -> DataFrame:
        rows = self._read("findings")
        return rows.where(F.col("project") == project) if project else rows

    def scores(self, project: str | None = None) -> DataFrame:
        rows = self._read("scores")
        return rows.where(F.col("project") == project) if project else rows

    def label(self, project: str, scan_id: str, text: str | None) -> None:
        """Sets a label, or clears it with none; the latest counts."""
        row = [(project, scan_id, text, datetime.now(timezone.utc).isoformat())]
        self.spark.createDataFrame(row, "project string, scan_id string, label string, at string").coalesce(1).write.mode("append").parquet(f"{self.path}/labels")

    def drop(self, scans: DataFrame) -> None:
        """Marks scans (project, scan_id) as gone; files of their partitions go with ``vacuum``."""
        scans.select("project", "scan_id").write.mode("append").parquet(f"{self.path}/dropped")

    def retain(self, keep: int = 100) -> None:
        """Drops all but the newest scans of each project."""
        rows = self.scans().select("project", "scan_id")
        self.drop(rows.join(newest(rows, ["project"], [F.desc("scan_id")], keep), ["project", "scan_id"], "left_anti"))

    def vacuum(self) -> None:
        """Deletes the partitions of dropped scans."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for r in self._read("dropped", "project string, scan_id string").distinct().toLocalIterator():
            for name in ("findings", "scores"):
                at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/project={r['project']}/scan_id={r['scan_id'].replace(':', '%3A')}")
                at.getFileSystem(conf).delete(at, True)


def labelled(scans: DataFrame, labels: DataFrame) -> DataFrame:
    """Scans (project, scan_id, ...) with the latest of their labels (project, scan_id, label, at), or null."""
    last = newest(labels, ["project", "scan_id"], [F.desc("at")]).select("project", "scan_id", "label")
    return scans.join(last, ["project", "scan_id"], "left")


def hashes(files: DataFrame) -> DataFrame:
    """(project, path, content_hash) of every file."""
    return files.select("project", "path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"))


def split_by_cache(files: DataFrame, cache: DataFrame, config: str) -> tuple[DataFrame, DataFrame]:
    """(files that must be parsed, cached facts that hold). cache: facts with content_hash and config_hash.

    Facts of files that are gone, have changed or belong to another configuration drop out by semi joins.
    """
    now = hashes(files)
    same = cache.where(F.col("config_hash") == config)
    held = same.join(now, ["project", "path", "content_hash"], "left_semi")
    known = held.select("project", "path").distinct()
    return files.join(known, ["project", "path"], "left_anti"), held
