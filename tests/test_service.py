"""Questions to the history, and the command line."""

from __future__ import annotations

import json
from datetime import datetime, timezone

import pytest

from lintarium import __main__ as cli
from lintarium.plans import service
from lintarium.sources.history import History

FINDINGS = "path string, rule_id string, dimension string, severity string, message string, start int, end int, line int, cwe array<string>, owasp array<string>"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    h = History(spark, str(tmp_path_factory.mktemp("history")))
    row = lambda path, severity, line: (path, f"R-{severity}", "security", severity, "m", 0, 1, line, ["CWE-1"], [])
    scans = [[row("a", "high", 1), row("b", "low", 2)], [row("a", "high", 1), row("a", "critical", 3)], []]
    scores = spark.createDataFrame([("security", 90.0)], "dimension string, score double")
    ids = [h.record("p", spark.createDataFrame(s, FINDINGS), scores, at=datetime(2024, 1, i + 1, tzinfo=timezone.utc), parse_failures=i) for i, s in enumerate(scans)]
    return h, ids


def test_summaries_and_trends(stored):
    h, ids = stored
    assert service.projects(h).first()["scans"] == 3
    s = service.summary(h, "p")
    assert s["latest"] == ids[2] and s["delta"]["findings"] == -2 and s["delta"]["severity"] == {"high": -1, "critical": -1} and s["delta"]["scores"] == {"security": 0.0}
    assert s["parse_failure_total"] == 3 and [r["per_scan"] for r in service.heatmap(h, "p").collect()] == [[1, 2, 0], [1, 0, 0]]
    assert [(r["high"], r["low"], r["critical"], r["total"]) for r in service.trends(h, "p").collect()] == [(1, 1, 0, 2), (1, 0, 1, 2), (0, 0, 0, 0)]
    assert [(r["path"], r["findings"], r["weight"], r["peak"], r["last_scan"]) for r in service.heatmap(h, "p").collect()] == [("a", 3, 40, 2, ids[1]), ("b", 1, 2, 1, ids[0])]
    assert {(r["path"], r["line"], r["status"]) for r in service.scan_diff(h, "p", ids[0], ids[1]).collect()} == {("a", 1, "persisting"), ("b", 2, "resolved"), ("a", 3, "new")}
    got = service.scan_analytics(h, "p", ids[0])
    assert got["cwe"].first()["n"] == 2 and [r["path"] for r in got["top_files"].collect()] == ["a", "b"]
    assert service.summary(h, "nobody")["latest"] is None
    assert service.diagnostics(h.findings("p")).where("line = 2 and severity = 1").count() == 1


def test_command_line(spark, tmp_path, capsys):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("x = eval('1')\n")
    old, new = str(tmp_path / "old.json"), str(tmp_path / "new.json")
    assert cli.main(["analyze", str(src), "--format", "json", "--output", old, "--fail-on", "high"]) == 1
    assert json.loads(open(old).read())["findings"]
    (src / "b.py").write_text("y = eval('2')\n")
    assert cli.main(["analyze", str(src), "--format", "json", "--output", new, "--baseline", old]) == 0
    assert {f["location"]["file"] for f in json.loads(open(new).read())["findings"]} == {"b.py"}
    assert cli.main(["diff", old, old]) == 0 and cli.main(["diff", old, new]) == 1
    assert cli.main(["report", old, "--format", "sarif"]) == 0
    assert "SEC002-eval-sink" in capsys.readouterr().out
