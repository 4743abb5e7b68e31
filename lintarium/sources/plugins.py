"""Plugins: programs that judge a whole project and print findings, described by a manifest and run once a project."""

from __future__ import annotations

import os
import re
import shutil
import tomllib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintarium.sources import tree

MANIFEST = "lintarium-plugin.toml"
KEYS = {"name", "version", "output", "command", "description", "rule_id_prefix", "extensions", "timeout_seconds", "max_output_bytes", "license", "homepage"}
FINDING = ("project", "path", "rule_id", "dimension", "severity", "message", "start", "end", "line", "cwe", "owasp")


@dataclass(frozen=True)
class Plugin:
    name: str
    version: str
    output: str
    command: tuple[str, ...]
    folder: str
    prefix: str
    timeout: float = 60
    most: int = 32 << 20

    @staticmethod
    def load(text: str, folder: str) -> Plugin:
        """A plugin from its manifest; the folder's name stands in for a name that is missing. What isn't valid is a ValueError."""
        doc = tomllib.loads(text)
        if extra := set(doc) - KEYS:
            raise ValueError(f"unknown key {sorted(extra)[0]!r}")
        name, command, output = doc.get("name", os.path.basename(folder.rstrip("/"))), doc.get("command"), doc.get("output")
        if not re.fullmatch(r"[a-z0-9][a-z0-9-]{0,63}", str(name)):
            raise ValueError(f"bad plugin name {name!r}")
        if not str(doc.get("version", "")):
            raise ValueError("a plugin needs a version")
        if output not in ("ndjson", "sarif"):
            raise ValueError(f"unknown output {output!r}")
        if not isinstance(command, list) or not command or not all(isinstance(c, str) and c for c in command):
            raise ValueError("a plugin needs a command")
        timeout, most = doc.get("timeout_seconds", 60), doc.get("max_output_bytes", 32 << 20)
        if timeout <= 0 or most <= 0:
            raise ValueError("limits must be positive")
        return Plugin(name, str(doc["version"]), output, tuple(command), folder, doc.get("rule_id_prefix", f"{name}/"), timeout, most)

    def argv(self, root: str) -> list[str] | None:
        """The command line; None where the program is neither in the plugin's folder nor on the path."""
        own = Path(self.folder, self.command[0])
        program = str(own.resolve()) if own.is_file() else shutil.which(self.command[0])
        return program and [program, *self.command[1:], "--project-root", root, "--output-format", self.output]


def discover(folder: str) -> list[Plugin]:
    """The plugins in the subfolders of a folder, by name; a folder that isn't there has none."""
    if not os.path.isdir(folder):
        return []
    found = [Plugin.load(p.read_text(), str(p.parent)) for p in sorted(Path(folder).glob(f"*/{MANIFEST}"))]
    names = [p.name for p in found]
    if len(set(names)) < len(names):
        raise ValueError("two plugins have one name")
    return found


def findings(plugin: Plugin, root: str, files: DataFrame, project: str = "project") -> DataFrame:
    """Findings of one run, with their places in the files; a run that fails is a finding itself."""
    spark: SparkSession = files.sparkSession
    argv = plugin.argv(os.path.abspath(root))
    text, failed = tree.run_plugin(argv, root, plugin.timeout, plugin.most) if argv else ("", "binary-missing")
    if failed:
        severity = "info" if failed == "binary-missing" else "medium"
        row = [(project, "", f"PLUGIN/{plugin.name}-{failed}", "plugin", severity, f"plugin {plugin.name}: {failed}", 0, 0, 1, [], [])]
        return spark.createDataFrame(row, "project string, path string, rule_id string, dimension string, severity string, message string, start long, end long, line int, cwe array<string>, owasp array<string>")
    if plugin.output == "sarif":
        found = tree.sarif_findings(spark.createDataFrame([(text,)], "value string"), project, plugin.prefix, plugin.name)
    else:
        found = tree.plugin_findings(spark.createDataFrame([(x,) for x in text.split("\n")], "value string"), plugin.name, project, plugin.prefix)
    base = os.path.abspath(root).rstrip("/") + "/"
    found = found.withColumn("path", F.when(F.startswith("path", F.lit(base)), F.substring("path", len(base) + 1, 1 << 20)).otherwise(F.regexp_replace("path", r"^\./", "")))
    return tree.located(found, files).select(*FINDING)
