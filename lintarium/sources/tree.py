"""Source trees, manifests, lock files, git history and plugin output as tables."""

from __future__ import annotations

import json
import os
import re
import subprocess
import threading
import tomllib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintarium.functions.severity import SEVERITIES, lookup
from lintarium.functions.text import glob_regex
from lintarium.sources.tables import ship

# Languages by extension.
LANGUAGES = {"rs": "rust", "py": "python", "pyi": "python", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "js", "tsx": "js", "mts": "js", "cts": "js"}
FILES = "project string, path string, language string, content string, n_bytes long"


#: Folders that hold no sources of a project. Hidden files that rules ask for; all other hidden ones are skipped.
SKIPPED = {".git", "node_modules", "target", "__pycache__", ".venv"}
HIDDEN = re.compile(r"^(\.github(/.*)?|\.gitlab-ci\.yml|\.circleci(/config\.yml)?)$")


def ignore_rules(text: str, base: str) -> list[tuple[re.Pattern, bool, bool]]:
    """(pattern over paths, whether it takes back, whether only folders are meant) of a file of ignore rules in the folder ``base``."""
    out, prefix = [], f"{base}/" if base else ""
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        back, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
        folder, line = line.endswith("/"), line.rstrip("/")
        if not line:
            continue
        anchored = "/" in line
        glob = (line.removeprefix("/") if anchored else f"**/{line}").replace("{", "[{]")
        out.append((re.compile("^" + re.escape(prefix) + glob_regex(glob)[1:]), back, folder))
    return out


def ignored(path: str, folder: bool, rules: list[tuple[re.Pattern, bool, bool]]) -> bool:
    """Whether the last rule that matches, if one does, ignores the path."""
    for pattern, back, only in reversed(rules):
        if (folder or not only) and pattern.match(path):
            return not back
    return False


def walk(store: pafs.FileSystem, base: str, exclude: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """(path, bytes) of the files under a folder in order of their path parts; rules of .gitignore and .ignore files hold from their folder on."""
    globs = [re.compile(glob_regex(g)) for g in exclude]
    out: list[tuple[str, int]] = []

    def visit(at: str, rules: list) -> None:
        inside = store.get_file_info(pafs.FileSelector(f"{base}/{at}" if at else base))
        names = {i.base_name: i for i in inside}
        for name in (".gitignore", ".ignore"):
            if name in names:
                with store.open_input_stream(names[name].path) as f:
                    rules = [*rules, *ignore_rules(f.read().decode("utf-8", "replace"), at)]
        for name in sorted(names):
            path, folder = f"{at}/{name}" if at else name, names[name].type == pafs.FileType.Directory
            if name in SKIPPED or (name.startswith(".") or HIDDEN.match(path)) and not HIDDEN.match(path) or ignored(path, folder, rules):
                continue
            if folder:
                visit(path, rules)
            elif not any(g.search(path) for g in globs):
                out.append((path, names[name].size))

    visit("", [])
    return out


def scan(spark: SparkSession, root: str, project: str = "project", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files under a folder: (project, path relative to it, language, content, n_bytes).

    Names are listed on the driver, where ignore rules and exclude globs cut off whole folders; contents are read by the
    executors, in tasks of some files each. Spark's own readers pass over names that begin with an underscore or a dot,
    ``__init__.py`` and ``.github`` among them, so they are used only for stores that Arrow doesn't know, without those
    files and ignore rules. Contents that aren't UTF-8 are null; hidden files have no language.
    """
    try:
        store, base = pafs.FileSystem.from_uri(root if "://" in root else "file://" + os.path.abspath(root.removeprefix("file:")))
    except (pa.ArrowInvalid, OSError):
        store = None
    if store is None:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        base = re.sub(r"^[a-z]+:/*", "/", root.rstrip("/"))
        path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape(base) + "/", "")
        rows = raw.withColumn("path", path).where(~F.col("path").rlike(r"(^|/)(\.git|node_modules|target|__pycache__|\.venv)/"))
        for g in exclude:
            rows = rows.where(~F.col("path").rlike(glob_regex(g)))
        rows = rows.select("path", "content", F.col("length").alias("n_bytes"))
    else:
        found = walk(store, base, exclude)
        ship(spark)
        tasks = max(1, min(len(found), max(2 * spark.sparkContext.defaultParallelism, sum(n for _, n in found) >> 25)))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                paths, held, size = [], [], 0
                for path in b.column(0).to_pylist():
                    with store.open_input_stream(f"{base}/{path}", compression=None) as f:
                        held.append(f.read())
                    paths.append(path)
                    size += len(held[-1])
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(held, pa.binary())], names=["path", "content"])
                        paths, held, size = [], [], 0
                if paths:
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(held, pa.binary())], names=["path", "content"])

        listed = spark.createDataFrame(found, "path string, n long").repartition(tasks).select("path")
        rows = listed.mapInArrow(read, "path string, content binary").withColumn("n_bytes", F.octet_length("content").cast("long"))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    language = F.when(~F.col("path").rlike(r"(^|/)\."), lookup(F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)), LANGUAGES))
    return rows.select(F.lit(project).alias("project"), "path", language.alias("language"), text.alias("content"), "n_bytes")


MANIFESTS = "project string, path string, kind string, doc string, error string"


def manifests(files: DataFrame) -> DataFrame:
    """Cargo.toml, pyproject.toml and package.json as JSON documents; what can't be parsed has its error instead."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for project, path, content in zip(b["project"], b["path"], b["content"]):
                name = path.rsplit("/", 1)[-1]
                kind = {"Cargo.toml": "cargo", "pyproject.toml": "pyproject", "package.json": "npm"}[name]
                try:
                    doc, error = json.dumps(json.loads(content) if kind == "npm" else tomllib.loads(content), default=str), None
                except (ValueError, TypeError) as e:
                    doc, error = None, str(e)
                out.append((project, path, kind, doc, error))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MANIFESTS.split(", ")])

    wanted = files.where(F.regexp_extract("path", r"([^/]+)$", 1).isin("Cargo.toml", "pyproject.toml", "package.json")).select("project", "path", "content")
    return wanted.mapInPandas(run, MANIFESTS)


DEPENDENCIES = "project string, path string, kind string, section string, name string, spec string, attrs map<string,string>"


def dependencies_of(kind: str, doc: dict) -> list[tuple[str, str, str | None, dict]]:
    """(section, name, version, attributes) of every dependency of a manifest."""
    out: list[tuple[str, str, str | None, dict]] = []
    if kind == "cargo":
        for section in ("dependencies", "dev-dependencies", "build-dependencies"):
            for name, spec in (doc.get(section) or {}).items():
                table = spec if isinstance(spec, dict) else {"version": spec}
                out.append((section, name, table.get("version"), {k: json.dumps(v) if isinstance(v, list) else str(v).lower() if isinstance(v, bool) else str(v) for k, v in table.items()}))
    elif kind == "npm":
        for section in ("dependencies", "devDependencies"):
            for name, spec in (doc.get(section) or {}).items():
                out.append((section, name, str(spec), {}))
    else:
        for text in (doc.get("project") or {}).get("dependencies") or []:
            if m := re.match(r"\s*([A-Za-z0-9._-]+)\s*(?:\[[^\]]*\])?\s*([^;]*)", str(text)):
                out.append(("dependencies", m[1], m[2].strip() or None, {}))
        for name, spec in (((doc.get("tool") or {}).get("poetry") or {}).get("dependencies") or {}).items():
            if name != "python":
                out.append(("dependencies", name, spec if isinstance(spec, str) else spec.get("version") if isinstance(spec, dict) else None, {}))
    return out


def dependencies(found: DataFrame) -> DataFrame:
    """The dependencies that manifests name."""
    ship(found.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(p, path, kind, *d) for p, path, kind, doc in zip(b["project"], b["path"], b["kind"], b["doc"]) for d in dependencies_of(kind, json.loads(doc))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DEPENDENCIES.replace("map<string,string>", "map").split(", ")])

    return found.where("doc is not null").select("project", "path", "kind", "doc").mapInPandas(run, DEPENDENCIES)


LOCKED = "project string, path string, name string, version string, time string, line int"


def locked_in(name: str, text: str) -> list[tuple[str, str, str | None, int]]:
    """(package, version, time, line) of every package in a lock file."""
    out: list[tuple[str, str, str | None, int]] = []
    if name == "package-lock.json":
        doc = json.loads(text)
        at = {m[1]: text.count("\n", 0, m.start()) + 1 for m in re.finditer(r'"((?:node_modules/)?[^"\n]+)"\s*:\s*\{', text)}
        for key, p in {**(doc.get("dependencies") or {}), **(doc.get("packages") or {})}.items():
            if key and isinstance(p, dict) and p.get("version"):
                out.append((key.rsplit("node_modules/", 1)[-1], p["version"], p.get("time"), at.get(key, 1)))
        return out
    if name.endswith((".txt",)):
        for i, row in enumerate(text.splitlines(), 1):
            if m := re.match(r"\s*([A-Za-z0-9._-]+)\s*==\s*([^\s;#]+)", row):
                out.append((m[1], m[2], None, i))
        return out
    current, at = None, 1
    for i, row in enumerate(text.splitlines(), 1):
        if m := re.match(r'\s*name\s*=\s*"([^"]+)"', row):
            current, at = m[1], i
        elif current and (m := re.match(r'\s*version\s*=\s*"([^"]+)"', row)):
            out.append((current, m[1], None, at))
            current = None
    return out


def locked(files: DataFrame) -> DataFrame:
    """Packages of lock files and pinned requirements; files that can't be read give none."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for project, path, content in zip(b["project"], b["path"], b["content"]):
                try:
                    out += [(project, path, *x) for x in locked_in(path.rsplit("/", 1)[-1], content)]
                except (ValueError, TypeError):
                    continue
            yield pd.DataFrame(out, columns=["project", "path", "name", "version", "time", "line"])

    names = F.regexp_extract("path", r"([^/]+)$", 1).rlike(r"^(Cargo\.lock|poetry\.lock|uv\.lock|pdm\.lock|package-lock\.json|requirements.*\.txt)$")
    return files.where(names & F.col("content").isNotNull()).select("project", "path", "content").mapInPandas(run, LOCKED)


def git_lines(root: str, *args: str, timeout: int = 60) -> list[str]:
    """Lines that git prints for a working copy on the driver; none where there is no git or no repository."""
    try:
        p = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=timeout)
    except (OSError, subprocess.TimeoutExpired):
        return []
    return p.stdout.splitlines() if p.returncode == 0 else []


def commits(lines: DataFrame, project: str = "project") -> DataFrame:
    """(project, author, ts) from lines ``author|ISO time``; malformed lines are skipped."""
    parts = F.split("value", r"\|")
    rows = lines.select(F.lit(project).alias("project"), F.trim(parts[0]).alias("author"), F.try_to_timestamp(F.try_element_at(parts, F.lit(2))).alias("ts"))
    return rows.where("author <> '' and ts is not null")


def git_commits(spark: SparkSession, root: str, project: str = "project", days: int | None = 365) -> DataFrame:
    since = [f"--since={days} days ago"] if days else []
    rows = [(x,) for x in git_lines(root, "log", "--pretty=%ae|%aI", *since)]
    return commits(spark.createDataFrame(rows, "value string"), project)


def git_tags(spark: SparkSession, root: str, project: str = "project") -> DataFrame:
    """(project, name, ts, ord), newest first from 0."""
    rows = [(project, *x.split("|", 1), i) for i, x in enumerate(git_lines(root, "for-each-ref", "--sort=-creatordate", "--format=%(refname:short)|%(creatordate:iso-strict)", "refs/tags")) if "|" in x]
    return spark.createDataFrame(rows, "project string, name string, ts string, ord int").withColumn("ts", F.try_to_timestamp("ts"))


def snapshot(root: str, ref: str, into: str) -> str:
    """Unpacks a commit of a working copy into a folder, for a scan of the past; returns the folder."""
    archive = subprocess.run(["git", "-C", root, "archive", ref], capture_output=True, check=True, timeout=600)
    subprocess.run(["tar", "-x", "-C", into], input=archive.stdout, check=True, timeout=600)
    return into


NDJSON = "rule_id string, severity string, message string, file string, line int, dimension string, col int, end_line int, end_col int, byte_offset_start int, byte_offset_end int, details string, cwe array<string>, owasp array<string>, _bad string"
_FIELDS = [x.split()[0] for x in NDJSON.split(", ")[:-1]]


def _prefixed(prefix: str, rule: Column) -> Column:
    return F.when(F.startswith(rule, F.lit(prefix)), rule).otherwise(F.concat(F.lit(prefix), rule))


def plugin_findings(lines: DataFrame, plugin: str, project: str = "project", prefix: str = "") -> DataFrame:
    """Findings from NDJSON lines (column ``value``), with col, and start and end where the line gives offsets.

    A line must have an id, a known severity, a file, a line, a message and a dimension, and no unknown fields; a bad line
    becomes a finding that says so. Blank lines are skipped, and ids get the prefix unless they have it.
    """
    j = F.from_json("value", NDJSON, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(F.trim(F.regexp_replace("value", r"\s", "")) != "").select("value", j.alias("j"), F.json_object_keys("value").alias("k"))
    lacks = reduce(lambda a, b: a | b, [F.col(f"j.{f}").isNull() for f in _FIELDS[:6]])
    extra = F.size(F.array_except("k", F.array(*map(F.lit, _FIELDS)))) > 0
    bad = F.coalesce(F.col("j").isNull() | F.col("j._bad").isNotNull() | lacks | ~F.col("j.severity").isin(*SEVERITIES) | (F.col("j.line") < 0) | F.col("k").isNull() | extra, F.lit(True))
    good = lambda c: F.when(~bad, F.col(f"j.{c}"))
    return rows.select(
        F.lit(project).alias("project"),
        F.when(bad, f"PLUGIN/{plugin}-output-parse-error").otherwise(_prefixed(prefix, F.col("j.rule_id"))).alias("rule_id"),
        F.coalesce(good("dimension"), F.lit("plugin")).alias("dimension"),
        F.coalesce(good("severity"), F.lit("medium")).alias("severity"),
        F.coalesce(good("file"), F.lit("")).alias("path"),
        F.greatest(F.coalesce(good("line"), F.lit(1)), F.lit(1)).alias("line"),
        F.when(bad, F.substring("value", 1, 200)).otherwise(F.coalesce("j.message", F.lit(""))).alias("message"),
        F.greatest(F.coalesce(good("col"), F.lit(1)), F.lit(1)).alias("col"),
        good("byte_offset_start").cast("long").alias("start"),
        good("byte_offset_end").cast("long").alias("end"),
        F.coalesce(good("cwe"), F.array().cast("array<string>")).alias("cwe"),
        F.coalesce(good("owasp"), F.array().cast("array<string>")).alias("owasp"),
    )


def located(found: DataFrame, files: DataFrame) -> DataFrame:
    """Findings (project, path, line, col, start, end) with offsets: given ones stay, others are at line and column of the file.

    A column beyond the file, or a line that it doesn't have, is its end; without the file offsets are 0. One equi join.
    """
    texts = files.select(F.col("project").alias("_p"), F.col("path").alias("_f"), F.col("content").alias("_c"))
    rows = found.join(texts, (F.col("project") == F.col("_p")) & (F.col("path") == F.col("_f")), "left")
    before = F.expr("CASE WHEN line > 1 THEN octet_length(substring_index(_c, '\n', line - 1)) + 1 ELSE 0 END")
    at = F.least(before + F.col("col") - 1, F.octet_length("_c")).cast("long")
    start = F.coalesce("start", at, F.lit(0).cast("long"))
    return rows.withColumns({"start": start, "end": F.coalesce("end", start)}).drop("_p", "_f", "_c")


_REGION = "physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int, startColumn: int, byteOffset: int, byteLength: int>>"
SARIF = f"runs array<struct<results: array<struct<ruleId: string, level: string, message: struct<text: string>, locations: array<struct<{_REGION}>>>>>>"


def sarif_findings(documents: DataFrame, project: str = "project", prefix: str = "", plugin: str = "sarif") -> DataFrame:
    """Findings from SARIF documents (column ``value``): error, warning and note become high, medium and low, others info.

    A document that can't be read becomes a finding that says so.
    """
    parsed = documents.select("value", F.from_json("value", SARIF)["runs"].alias("runs"))
    none = F.array().cast("array<string>")
    broken = parsed.where("runs is null").select(
        F.lit(project).alias("project"), F.lit(f"PLUGIN/{plugin}-output-parse-error").alias("rule_id"), F.lit("plugin").alias("dimension"), F.lit("medium").alias("severity"), F.lit("").alias("path"), F.lit(1).alias("line"),
        F.substring("value", 1, 200).alias("message"), F.lit(1).alias("col"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), none.alias("cwe"), none.alias("owasp"),
    )
    r = parsed.select(F.explode("runs").alias("r")).select(F.explode("r.results").alias("x"))
    place = F.try_element_at(F.col("x.locations"), F.lit(1))["physicalLocation"]
    region = place["region"]
    found = r.select(
        F.lit(project).alias("project"), _prefixed(prefix, F.coalesce("x.ruleId", F.lit("unknown"))).alias("rule_id"), F.lit("plugin").alias("dimension"),
        lookup(F.col("x.level"), {"error": "high", "warning": "medium", "note": "low"}, "info").alias("severity"),
        F.coalesce(place["artifactLocation"]["uri"], F.lit("")).alias("path"), F.greatest(F.coalesce(region["startLine"], F.lit(1)), F.lit(1)).alias("line"), F.coalesce("x.message.text", F.lit("")).alias("message"),
        F.greatest(F.coalesce(region["startColumn"], F.lit(1)), F.lit(1)).alias("col"), region["byteOffset"].cast("long").alias("start"), (region["byteOffset"] + region["byteLength"]).cast("long").alias("end"), none.alias("cwe"), none.alias("owasp"),
    )
    return found.unionByName(broken)


def run_plugin(command: list[str], cwd: str, timeout: float = 60, most: int = 32 << 20) -> tuple[str, str | None]:
    """Output of a plugin process on the driver, and what went wrong: binary-missing, timeout, output-too-large, spawn-failed.

    Output is read as it comes, and the process is ended once there is more than ``most`` or the time is over.
    """
    try:
        p = subprocess.Popen(command, cwd=cwd, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, stdin=subprocess.DEVNULL)
    except FileNotFoundError:
        return "", "binary-missing"
    except OSError:
        return "", "spawn-failed"
    late = threading.Event()
    timer = threading.Timer(timeout, lambda: (late.set(), p.kill()))
    timer.start()
    held, size = [], 0
    try:
        while part := p.stdout.read1(1 << 16):
            held.append(part)
            size += len(part)
            if size > most:
                return "", "output-too-large"
        p.wait()
    finally:
        timer.cancel()
        p.kill()
        p.wait()
        p.stdout.close()
    return ("", "timeout") if late.is_set() else (b"".join(held).decode("utf-8", "replace"), None)
