"""Reports: JSON, SARIF, Markdown, Checkstyle, JUnit and the terminal.

A report is for people and tools, so it is rendered on the driver from findings in order; what is counted in it comes
from the findings that it shows. Large results belong in a table instead.
"""

from __future__ import annotations

import json
from collections import Counter
from itertools import groupby
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame

from lintarium.functions.severity import DIMENSIONS, GRADES, SEVERITIES
from lintarium.operators.findings import in_order

# Severities in the words of other formats.
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
CHECKSTYLE = {"critical": "error", "high": "error", "medium": "warning", "low": "info", "info": "info"}
COLOURS = {"critical": "35", "high": "31", "medium": "33", "low": "36", "info": "37"}


def letter(score: float) -> str:
    return next((g for g, least in GRADES if score >= least), "F")


def rows_of(findings: DataFrame) -> list[dict]:
    """Findings as dictionaries in the order of the report."""
    return [r.asDict(recursive=True) for r in in_order(findings).toLocalIterator()]


def _dimensions(scores: dict[str, float]) -> list[str]:
    return [*[d for d in DIMENSIONS if d in scores], *sorted(d for d in scores if d not in DIMENSIONS)]


def as_json(findings: list[dict], scores: dict[str, float], stats: dict | None = None) -> str:
    ordered = {d: scores[d] for d in _dimensions(scores)}
    body = [{"rule_id": f["rule_id"], "dimension": f["dimension"], "severity": f["severity"], "message": f["message"], "location": {"file": f["path"], "span": {"start": f["start"], "end": f["end"]}, "start": {"line": f["line"]}}, "cwe": f.get("cwe") or [], "owasp": f.get("owasp") or []} for f in findings]
    return json.dumps({"schema_version": 1, "scores": ordered, "grades": {d: letter(s) for d, s in ordered.items()}, "findings": body, "stats": stats or {}}, indent=2)


def as_sarif(findings: list[dict], tool: str = "lintarium") -> str:
    worst: dict[str, int] = {}
    for f in findings:
        worst[f["rule_id"]] = max(worst.get(f["rule_id"], 0), SEVERITIES.index(f["severity"]))
    rules = [{"id": r, "defaultConfiguration": {"level": SARIF_LEVELS[SEVERITIES[w]]}} for r, w in sorted(worst.items())]
    place = lambda f: {"physicalLocation": {"artifactLocation": {"uri": f["path"]}, "region": {"startLine": f["line"], "byteOffset": f["start"], "byteLength": f["end"] - f["start"]}}}
    results = [{"ruleId": f["rule_id"], "level": SARIF_LEVELS[f["severity"]], "message": {"text": f["message"]}, "locations": [place(f)]} for f in sorted(findings, key=lambda f: (f["path"], f["line"], f["start"], f["rule_id"]))]
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": results}]}, indent=2)


def as_markdown(findings: list[dict], scores: dict[str, float]) -> str:
    out = ["# Report", "", "| Dimension | Score | Grade | Findings |", "|---|---|---|---|"]
    counts = Counter(f["dimension"] for f in findings)
    out += [f"| {d} | {scores[d]:.1f} | {letter(scores[d])} | {counts[d]} |" for d in _dimensions(scores)]
    for d in _dimensions(scores):
        own = [f for f in findings if f["dimension"] == d]
        if own:
            out += ["", f"## {d}", "", "| Severity | Rule | Place | Message |", "|---|---|---|---|"]
            out += [f"| {f['severity']} | {f['rule_id']} | {f['path']}:{f['line']} | {f['message'].replace('|', chr(92) + '|')} |" for f in own]
    return "\n".join(out) + "\n"


def as_checkstyle(findings: list[dict]) -> str:
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<checkstyle version="8.0">']
    for path, group in groupby(sorted(findings, key=lambda f: (f["path"], f["line"], f["start"], f["rule_id"])), key=lambda f: f["path"]):
        out.append(f"  <file name={quoteattr(path)}>")
        out += [f'    <error line="{f["line"]}" severity="{CHECKSTYLE[f["severity"]]}" message={quoteattr(f["message"])} source={quoteattr(f["rule_id"])}/>' for f in group]
        out.append("  </file>")
    return "\n".join([*out, "</checkstyle>"]) + "\n"


def as_junit(findings: list[dict]) -> str:
    bad = {"critical", "high", "medium"}
    n = lambda fs: f'tests="{len(fs)}" failures="{sum(f["severity"] in bad and f["severity"] != "critical" for f in fs)}" errors="{sum(f["severity"] == "critical" for f in fs)}"'
    out = ['<?xml version="1.0" encoding="UTF-8"?>', f"<testsuites {n(findings)}>"]
    for d, group in groupby(sorted(findings, key=lambda f: f["dimension"]), key=lambda f: f["dimension"]):
        own = list(group)
        out.append(f"  <testsuite name={quoteattr(d)} {n(own)}>")
        for f in own:
            tag = "error" if f["severity"] == "critical" else "failure" if f["severity"] in bad else "system-out"
            text = escape(f"{f['path']}:{f['line']} {f['message']}")
            inner = f"<system-out>{text}</system-out>" if tag == "system-out" else f"<{tag} type={quoteattr(f['severity'])} message={quoteattr(f['message'])}>{text}</{tag}>"
            out.append(f"    <testcase name={quoteattr(f['rule_id'])} classname={quoteattr(f['path'])}>{inner}</testcase>")
        out.append("  </testsuite>")
    return "\n".join([*out, "</testsuites>"]) + "\n"


def as_terminal(findings: list[dict], scores: dict[str, float], colour: bool = False) -> str:
    paint = lambda s, c: f"\x1b[{c}m{s}\x1b[0m" if colour else s
    out = [f"{d:<18} {'#' * round(scores[d] / 5):<20} {scores[d]:5.1f} {letter(scores[d])}" for d in _dimensions(scores)]
    out += [f"{f['path']}:{f['line']}: {paint(f['severity'], COLOURS[f['severity']])} {f['rule_id']} {f['message']}" for f in findings]
    return "\n".join(out) + "\n"


def render(kind: str, findings: list[dict], scores: dict[str, float], **more) -> str:
    made = {"json": lambda: as_json(findings, scores, **more), "sarif": lambda: as_sarif(findings, **more), "markdown": lambda: as_markdown(findings, scores), "checkstyle": lambda: as_checkstyle(findings), "junit": lambda: as_junit(findings), "terminal": lambda: as_terminal(findings, scores, **more)}
    if kind not in made:
        raise ValueError(f"unknown format {kind!r}")
    return made[kind]()


def from_json(text: str) -> tuple[list[dict], dict[str, float]]:
    """Findings and scores of a stored JSON report or scan, to be rendered again."""
    doc = json.loads(text)
    doc = doc.get("report", doc)
    rows = [{**{k: f[k] for k in ("rule_id", "dimension", "severity", "message")}, "path": f["location"]["file"], "start": f["location"].get("span", {}).get("start", 0), "end": f["location"].get("span", {}).get("end", 0), "line": f["location"].get("start", {}).get("line", 1), "cwe": f.get("cwe", []), "owasp": f.get("owasp", [])} for f in doc.get("findings", [])]
    return rows, doc.get("scores", {})
