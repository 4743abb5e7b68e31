"""Command line: analyze, diff, report, watch and baseline."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from lintarium.functions.severity import SEVERITIES
from lintarium.operators import findings as ops
from lintarium.plans import engine, report
from lintarium.session import session
from lintarium.sources import tree
from lintarium.sources.history import History
from lintarium.sources.tables import local_scratch, shared_root
from lintarium.streaming.watch import watch

KEYS = ["path", "line", "rule_id", "message"]


def _findings(spark, path: str):
    rows, scores = report.from_json(Path(path).read_text())
    schema = "rule_id string, dimension string, severity string, message string, path string, start long, end long, line int, cwe array<string>, owasp array<string>"
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema), scores


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="lintarium", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze", help="analyse a folder")
    a.add_argument("path")
    a.add_argument("--format", default="terminal", choices=["terminal", "json", "sarif", "markdown", "checkstyle", "junit"])
    a.add_argument("--output")
    a.add_argument("--fail-on", choices=SEVERITIES)
    a.add_argument("--baseline", help="a JSON report; only findings that it lacks are shown")
    a.add_argument("--owasp", action="append", default=[])
    a.add_argument("--cwe", action="append", default=[])
    a.add_argument("--history", help="folder of the scan history to append to")
    a.add_argument("--project", default="project")
    a.add_argument("--git", action="store_true", help="also judge commits and tags")
    a.add_argument("--cache", help="folder of facts of files that were parsed before")
    a.add_argument("--plugins", help="folder of plugins, one in each subfolder")
    a.add_argument("--since", help="a commit; public names of Python that it has are compared with those of now")
    b = sub.add_parser("baseline", help="save a JSON report, of the folder or of a commit")
    b.add_argument("path")
    b.add_argument("output")
    b.add_argument("--ref")
    d = sub.add_parser("diff", help="compare two JSON reports; 1 if there is something new")
    d.add_argument("old")
    d.add_argument("new")
    r = sub.add_parser("report", help="render a JSON report again")
    r.add_argument("input")
    r.add_argument("--format", default="markdown", choices=["terminal", "json", "sarif", "markdown", "checkstyle", "junit"])
    w = sub.add_parser("watch", help="analyse again whenever files come")
    w.add_argument("path")
    w.add_argument("--once", action="store_true")
    w.add_argument("--state", help="folder that keeps what was seen and parsed; the shared folder's if none is named")
    o = top.parse_args(args)
    if o.command == "report":
        print(report.render(o.format, *report.from_json(Path(o.input).read_text())), end="")
        return 0
    spark = session()
    if o.command == "analyze":
        found = engine.run_tree(spark, o.path, o.project, git=o.git, cache=o.cache, since=o.since, programs=o.plugins)
        if o.history:
            History(spark, o.history).record(o.project, found.findings.drop("project"), found.scores, found.stats["files_scanned"], parse_failures=found.stats["parse_failures"])
        base = _findings(spark, o.baseline)[0] if o.baseline else None
        shown = engine.filtered(found, base, o.owasp, o.cwe)
        text = shown.render(o.format)
        Path(o.output).write_text(text) if o.output else print(text, end="")
        return int(bool(o.fail_on) and ops.fails(shown.findings, o.fail_on))
    if o.command == "baseline":
        at = tree.snapshot(o.path, o.ref, local_scratch(spark, "snapshot")) if o.ref else o.path
        Path(o.output).write_text(engine.run_tree(spark, at).render("json"))
        return 0
    if o.command == "diff":
        rows = ops.diff(_findings(spark, o.old)[0], _findings(spark, o.new)[0], KEYS).orderBy(*KEYS).collect()
        for x in rows:
            print(f"{x['status']:<10} {x['path']}:{x['line']} {x['rule_id']} {x['message']}")
        return int(any(x["status"] == "new" for x in rows))

    state = o.state or f"{shared_root(spark)}/watch"

    def again(batch, _) -> None:
        # Only the files of the burst are parsed, the others come from the cache.
        if not batch.limit(1).isEmpty():
            print(engine.run_tree(spark, o.path, cache=f"{state}/facts").render("terminal"), flush=True)

    q = watch(spark, o.path, f"{state}/stream", again, once=o.once)
    while q.isActive:
        time.sleep(0.25)
    if q.exception():
        raise q.exception()
    return 0


if __name__ == "__main__":
    sys.exit(main())
