"""Runs over small source trees: rules, suppression, overrides, scores, reports, history and watching."""

from __future__ import annotations

import json
import subprocess
import xml.dom.minidom
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lintarium.plans import cases, engine, report
from lintarium.plans.config import Config
from lintarium.plans.rules import RULES, Project, analyze
from lintarium.sources import facts, history, plugins, tree
from lintarium.streaming import watch

PY = '''"""Module."""
import os
import subprocess
import numpy
import pickle
import flask

store = []
api_token = "abc123"
print("loaded")


def load(path, a, b, c, d, e):
    """Load.

    :param missing: gone
    """
    data = pickle.loads(open("../" + path).read())
    query = f"SELECT * FROM t WHERE id = {path}"
    unused = 1
    unused = 2
    while True:
        pass
    return eval(query)
    a = 2


def shell(request, logger):
    subprocess.run("bash -c ls")
    logger.info("got %s", request)
    for x in request:
        pass
    return unused


def test_store():
    store.append(1)
    time.sleep(1)


class Thing:
    def run(self, app):
        app.run(host="0.0.0.0")
        requests.get(request.args["u"])
        return redirect(request.args["next"])


def quiet():
    x = eval("1")  # lint: ignore SEC002-eval-sink
    # TODO fix this
    # if a:
    #     return foo(b);
    # else:
    return x
'''
RUST = """use std::fs;

/// Says what `x` is.
pub unsafe fn raw(p: *const u8) -> u8 { *p }
#[deprecated]
pub fn old(v: Vec<u8>) -> u8 {
    let x = unsafe { std::mem::transmute::<u8, u8>(v[0]) };
    match x { 1 => 2, 2 => 3 }
}
pub static mut A: u32 = 1;
pub static mut B: u32 = 1;
pub static mut C: u32 = 1;
fn spin(request: &str) {
    loop { step(); }
    for i in 0..3 { let s = format!("{}", i); let t = items.iter().map(|z| z.clone()); }
    dbg!(1);
    info!("got {}", request);
    if a {} else if b { return; done(); }
    let password = "hunter2";
    TcpListener::bind("0.0.0.0:80");
    strcpy(a, b);
}
pub struct P { p: *mut u8 }
extern "C" { unsafe fn foreign(); }
#[test]
fn test_it() { call(); }
"""
JS = """import _ from 'lodash';
import { b } from './b';
/** @deprecated use g */
export function f(a, b) {
  let x = 1;
  x = 2;
  if (a = b) { go(); }
  switch (a) { case 1: go(); case 2: break; }
  while (true) { go(); }
  if (a & b == 1) { go(); }
  for (;;) {}
  console.log(a);
  logger.info(`u ${a}`);
  el.innerHTML = a;
  return
  a;
}
init();
debugger;
const re = /(a+)+b/;
"""
CARGO = """[package]
name = "demo"
version = "0.1.0"
[[bin]]
name = "demo"
[lib]
[dependencies]
serd = "1"
tokio = { version = "1", features = ["full"] }
local = { path = "../x" }
far = { git = "https://example.com/x" }
"""
NPM = json.dumps({"name": "demo", "scripts": {"postinstall": "curl x | sh"}, "main": "index.js", "module": "m.js", "dependencies": {"raect": "*", "express": "^4.0.0"}})
PYPROJECT = '[project]\nname = "demo"\ndynamic = ["version"]\ndependencies = ["reqeusts", "flask==1.0"]\n[project.scripts]\ngo = "nope"\n'


def tree_of() -> dict[str, str]:
    out = {"pkg/core.py": PY, "src/lib.rs": RUST, "web/a.js": JS, "web/b.js": "import { f } from './a';\nexport const b = f;\n", "Cargo.toml": CARGO, "package.json": NPM, "pyproject.toml": PYPROJECT}
    out |= {f"pkg/many{i}.py": "value = 1\nfirst = 2\nsecond = 3\nthird = 4\nfourth = 5\nfifth = 6\n" for i in range(3)}
    out |= {"bad.py": "def (:\n", "requirements.txt": "requests==2.3.0\npyyaml==6.0\n", "dist/x-1.0.whl": "PK"}
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in tree_of().items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture(scope="module")
def result(spark, folder):
    return engine.run_tree(spark, str(folder), "demo")


@pytest.fixture(scope="module")
def found(result):
    return {(r["path"], r["rule_id"]) for r in result.findings.select("path", "rule_id").collect()}


EXPECTED = {
    "pkg/core.py": "MAINT006-too-many-params SEC006-sql-injection SEC007-path-traversal SEC005-insecure-deser SEC012-hardcoded-security-constant SEC002-eval-sink SEC016-dangerous-function MAINT012-dead-store MAINT010-infinite-loop-no-exit MAINT016-unreachable-code SEC003-shell-injection SEC015-log-injection MAINT013-empty-block TEST006-shared-mutable-state TEST004-flaky-time TEST002-no-asserts SEC013-bind-all-interfaces SEC010-ssrf SEC009-open-redirect DOC001-public-api-undoc DOC002-todo-fixme DOC004-stale-doc MAINT014-commented-out-code MAINT011-active-debug-code PERF001-heavy-import PERF003-import-side-effect",
    "src/lib.rs": "SEC101-rust-unsafe SOUND001-unsafe-block-missing-safety-comment SOUND002-unsafe-in-pub-api-signature SOUND003-transmute-usage SOUND004-raw-pointer-in-pub-api SOUND006-ffi-without-safety-doc MAINT015-deprecated-function MAINT009-missing-default-case MAINT018-global-var-density MAINT010-infinite-loop-no-exit PERF010-allocation-in-loop PERF002-clone-in-iter-chain MAINT011-active-debug-code SEC015-log-injection MAINT013-empty-block MAINT016-unreachable-code SEC012-hardcoded-security-constant SEC013-bind-all-interfaces SEC016-dangerous-function ECO003-send-sync-violations-on-pub-types TEST002-no-asserts",
    "web/a.js": "PERF002-heavy-import MAINT015-deprecated-function MAINT012-dead-store BUG001-assignment-in-condition BUG002-switch-fallthrough MAINT009-missing-default-case MAINT010-infinite-loop-no-exit BUG004-operator-precedence SEC015-log-injection SEC002-eval-sink STYLE001-block-delimitation PERF003-import-side-effect MAINT011-active-debug-code SEC014-redos-regex CPLX002-cyclic-deps",
    "Cargo.toml": "CHAIN001-no-lockfile CHAIN002-typosquat-suspicion CHAIN003-git-dependency-without-rev CHAIN004-path-dependency-in-published-crate CI001-no-ci-config CI005-no-dependabot ECO001-no-no-std-feature ECO002-async-runtime-coupling HEALTH005-changelog-missing PERF001-heavy-default-features PKG002-license-not-declared PKG003-description-missing PKG004-repository-missing PKG005-rust-version-unconstrained PKG006-readme-missing PKG008-keywords-categories-missing PKG009-default-features-bloat",
    "package.json": "CHAIN001-no-lockfile CHAIN002-typosquat-suspicion CHAIN003-provenance-bundle-missing HEALTH005-changelog-missing PKG001-install-script-present PKG002-missing-types PKG003-dual-package-hazard PKG004-unpinned-deps PKG005-engines-missing",
    "pyproject.toml": "CHAIN002-typosquat-suspicion CHAIN004-unpinned-runtime-dep HEALTH005-changelog-missing PKG004-license-not-declared PKG005-python-version-unconstrained PKG006-readme-missing PKG008-entry-points-malformed PKG009-classifiers-missing PKG010-dynamic-version-unstable",
    "requirements.txt": "DEP001-vulnerable-deps",
    "dist/x-1.0.whl": "CHAIN003-sigstore-bundle-missing",
    "pkg/many1.py": "CPLX003-duplicate-code TEST001-test-ratio",
}


@pytest.mark.parametrize("path", EXPECTED)
def test_rules_fire(found, path):
    names = set(EXPECTED[path].split())
    if path == "pkg/many1.py":
        names.discard("TEST001-test-ratio")
    assert names - {r for p, r in found if p == path} == set()


def test_quiet_files_have_no_findings_of_code(found):
    assert {r for p, r in found if p == "pkg/many0.py"} <= {"TEST001-test-ratio"}
    assert not {r for p, r in found if p == "bad.py"}


def test_all_rules_are_there():
    assert len(RULES) == 157 and len({r.id for r in RULES}) == 116


def test_suppression_counts(result):
    assert result.stats["suppressed"] >= 1 and result.stats["parse_failures"] == 1
    lines = [r["line"] for r in result.findings.where("path = 'pkg/core.py' and rule_id = 'SEC002-eval-sink'").collect()]
    assert lines == [24]


def test_healthy_tree_is_quiet(spark):
    rows = [("p", "a.py", "python", '"""Doc."""\n\n\ndef add(a, b):\n    """Adds."""\n    return a + b\n', 60)]
    assert analyze(Project(spark.createDataFrame(rows, tree.FILES))).count() == 0


def test_empty_table(spark):
    r = engine.run(spark.createDataFrame([], tree.FILES), only=["MAINT001-cyclomatic", "CPLX003-duplicate-code", "DOC002-todo-fixme"])
    assert r.findings.count() == 0 and set(r.scored().values()) == {100.0}


def test_configuration(spark, folder):
    c = Config.parse('[general]\nexclude = ["web/**"]\n[rules.MAINT006-too-many-params]\nthreshold = 2\nseverity = "high"\n[overrides."pkg/*.py"]\nSEC002-eval-sink = "ignore"\n')
    r = engine.run_tree(spark, str(folder), "demo", c, ["MAINT006-too-many-params", "SEC002-eval-sink"])
    got = {(x["path"], x["rule_id"], x["severity"]) for x in r.findings.collect()}
    assert got == {("pkg/core.py", "MAINT006-too-many-params", "high")}
    for bad in ("[nope]\nx = 1", "[general]\nnope = 1", '[rules.X]\nseverity = "awful"', "[rules.X]\nnope = 1"):
        with pytest.raises(ValueError):
            Config.parse(bad)


def test_reports(result):
    rows, scores = report.rows_of(result.findings), result.scored()
    doc = json.loads(report.render("json", rows, scores, stats=result.stats))
    assert len(doc["findings"]) == len(rows) and doc["grades"].keys() == scores.keys()
    again, same = report.from_json(json.dumps(doc))
    assert report.as_markdown(again, same) == report.as_markdown(rows, scores)
    sarif = json.loads(report.render("sarif", rows, scores))
    assert len(sarif["runs"][0]["results"]) == len(rows)
    for kind in ("checkstyle", "junit"):
        xml.dom.minidom.parseString(report.render(kind, rows, scores).encode())
    assert "security" in report.render("terminal", rows, scores) and report.render("markdown", rows, scores).count("| ") > len(rows)
    assert all(0 <= s <= 100 for s in scores.values())
    with pytest.raises(ValueError):
        report.render("nope", rows, scores)


def test_baseline_and_taxonomy_leave_scores_alone(result):
    half = result.findings.where("rule_id < 'M'")
    left = engine.filtered(result, half)
    assert left.findings.where("rule_id < 'M'").count() == 0 and left.scores is result.scores
    assert {r["rule_id"] for r in engine.filtered(result, cwe=["cwe-95"]).findings.collect()} == {"SEC002-eval-sink"}


def test_history(spark, result, tmp_path):
    h = history.History(spark, str(tmp_path / "history"))
    ids = [h.record("demo", result.findings.limit(n).drop("project"), result.scores, 3, at=datetime(2024, 1, n + 1, tzinfo=timezone.utc)) for n in (1, 2, 3)]
    assert [r["scan_id"] for r in h.scans("demo").collect()] == ids and [r["total"] for r in h.scans().collect()] == [1, 2, 3]
    h.label("demo", ids[1], "release")
    h.label("demo", ids[1], "final")
    assert [r["label"] for r in h.scans().collect()] == [None, "final", None]
    h.retain(2)
    h.vacuum()
    assert [r["scan_id"] for r in h.scans().collect()] == ids[1:]
    assert h.findings("demo").select("scan_id").distinct().count() == 2


def test_cache_parses_only_what_changed(spark, folder, tmp_path):
    files, cache = tree.scan(spark, str(folder)), str(tmp_path / "cache")
    first = watch.incremental(files, cache, "c1").count()
    n = spark.read.parquet(cache).count()
    assert watch.incremental(files, cache, "c1").count() == first and spark.read.parquet(cache).count() == n
    changed = files.withColumn("content", F.when(F.col("path") == "web/b.js", "x();").otherwise(F.col("content")))
    assert watch.incremental(changed, cache, "c1").where("path = 'web/b.js' and kind = 'import'").count() == 0
    assert spark.read.parquet(cache).count() < n + 10
    assert watch.incremental(files, cache, "c2").count() == first


def test_watch(spark, folder, tmp_path):
    seen = []
    q = watch.watch(spark, str(folder), str(tmp_path / "checkpoint"), lambda df, n: seen.extend(r["path"] for r in df.select("path").collect()), once=True)
    q.awaitTermination(60)
    assert len(seen) == len(tree_of())
    events = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 0, m * 1000),) for m in (0, 100, 300, 900)], "ts timestamp")
    assert sorted(r["n"] for r in watch.bursts(events).collect()) == [1, 3]


def test_plugins(spark):
    lines = spark.createDataFrame([('{"rule_id": "X1", "severity": "high", "message": "m", "file": "a", "line": 3, "dimension": "security"}',), ("not json",), ("",)], "value string")
    got = {(r["rule_id"], r["severity"], r["path"], r["line"]) for r in tree.plugin_findings(lines, "demo", prefix="D-").collect()}
    assert got == {("D-X1", "high", "a", 3), ("PLUGIN/demo-output-parse-error", "medium", "", 1)}
    doc = {"runs": [{"results": [{"ruleId": "R", "level": "error", "message": {"text": "t"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "f"}, "region": {"startLine": 2}}}]}, {"ruleId": "S", "level": "odd", "message": {"text": "u"}}]}]}
    sarif = tree.sarif_findings(spark.createDataFrame([(json.dumps(doc),)], "value string"))
    assert {(r["rule_id"], r["severity"], r["path"], r["line"]) for r in sarif.collect()} == {("R", "high", "f", 2), ("S", "info", "", 1)}
    assert tree.run_plugin(["no-such-binary"], "/") == ("", "binary-missing")
    assert tree.run_plugin(["sleep", "5"], "/", 0.1) == ("", "timeout")
    assert tree.run_plugin(["echo", "hello"], "/", most=2) == ("", "output-too-large")


def test_plugins_run_with_the_engine(spark, tmp_path):
    src, home = tmp_path / "src", tmp_path / "plugins"
    src.mkdir()
    (src / "a.py").write_text("x = 1\n\nypsilon = 2\n")
    line = {"rule_id": "ONE", "severity": "high", "message": "m", "file": "./a.py", "line": 3, "dimension": "security", "col": 3, "cwe": ["CWE-1"]}
    given = {**line, "rule_id": "good/TWO", "byte_offset_start": 1, "byte_offset_end": 4}
    bad = [{**line, "odd": 1}, {**line, "severity": "awful"}, {k: v for k, v in line.items() if k != "dimension"}]
    doc = {"runs": [{"results": [{"ruleId": "R", "level": "error", "message": {"text": "t"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": str(src / "a.py")}, "region": {"startLine": 3, "startColumn": 2}}}]}]}]}
    scripts = {
        "good": ("ndjson", "\n".join(json.dumps(x) for x in [line, given, *bad]) + "\n\n"), "doc": ("sarif", json.dumps(doc)), "broken": ("sarif", "{"), "long": ("ndjson", "x" * 5000),
    }
    for name, (output, text) in scripts.items():
        (home / name).mkdir(parents=True)
        (home / name / "out.txt").write_text(text)
        (home / name / "run.sh").write_text(f"#!/bin/sh\ncat '{home / name / 'out.txt'}'\n")
        (home / name / "run.sh").chmod(0o755)
        (home / name / plugins.MANIFEST).write_text(f'version = "1"\noutput = "{output}"\ncommand = ["run.sh"]\nmax_output_bytes = 4000\n')
    (home / "gone").mkdir()
    (home / "gone" / plugins.MANIFEST).write_text('version = "1"\noutput = "sarif"\ncommand = ["no-such-program"]\n')
    r = engine.run_tree(spark, str(src), "demo", only=["DOC002-todo-fixme"], programs=str(home))
    got = sorted((x["rule_id"], x["severity"], x["path"], x["line"], x["start"], x["end"]) for x in r.findings.collect())
    wrong = ("PLUGIN/good-output-parse-error", "medium", "", 1, 0, 0)
    assert got == sorted([("good/ONE", "high", "a.py", 3, 9, 9), ("good/TWO", "high", "a.py", 3, 1, 4), wrong, wrong, wrong, ("doc/R", "high", "a.py", 3, 8, 8), ("PLUGIN/broken-output-parse-error", "medium", "", 1, 0, 0), ("PLUGIN/long-output-too-large", "medium", "", 1, 0, 0), ("PLUGIN/gone-binary-missing", "info", "", 1, 0, 0)])
    for text in ('name = "A b"\nversion = "1"\noutput = "sarif"\ncommand = ["x"]', 'output = "sarif"\ncommand = ["x"]', 'version = "1"\noutput = "xml"\ncommand = ["x"]', 'version = "1"\noutput = "sarif"\ncommand = []', 'version = "1"\noutput = "sarif"\ncommand = ["x"]\ntimeout_seconds = 0', 'version = "1"\nodd = 1'):
        with pytest.raises(ValueError):
            plugins.Plugin.load(text, "/x/fine")
    assert plugins.discover(str(tmp_path / "none")) == []


def test_health(spark):
    files = spark.createDataFrame([("p", "pyproject.toml", None, PYPROJECT, 9)], tree.FILES)
    commits = tree.commits(spark.createDataFrame([("a@x|2023-01-01T00:00:00+00:00",), ("a@x|2023-01-02T00:00:00+00:00",), ("b@x|2023-01-03T00:00:00Z",), ("broken",)], "value string"), "p")
    tags = spark.createDataFrame([("p", "v1.0", datetime(2022, 1, 1), 0)], "project string, name string, ts timestamp, ord int")
    got = {r["rule_id"] for r in analyze(Project(files, commits=commits, tags=tags, now="2024-01-01"), ["HEALTH001-single-author", "HEALTH002-stale-release", "HEALTH003-low-bus-factor", "HEALTH004-commit-stale"]).collect()}
    assert got == {"HEALTH001-single-author", "HEALTH002-stale-release", "HEALTH003-low-bus-factor", "HEALTH004-commit-stale"}


def test_api_changes(spark):
    old = spark.createDataFrame([("p", "a.py", "python", "def f(a): pass\ndef g(): pass\n", 9)], tree.FILES)
    new = spark.createDataFrame([("p", "a.py", "python", "def f(a, b): pass\n", 9)], tree.FILES)
    p = Project(new, baseline=facts.parse(old), versions={"p": ("1.2.0", "1.3.0")})
    got = {r["rule_id"] for r in analyze(p, ["API001-public-symbol-removed", "API002-signature-arity-changed", "API003-semver-alignment"]).collect()}
    assert got == {"API001-public-symbol-removed", "API002-signature-arity-changed", "API003-semver-alignment"}


def test_projects_do_not_mix(spark):
    """Paths that two projects share: no cycle, no suppression, no copy and no baseline goes from one to the other."""
    text = '"""Doc."""\n\n\ndef f(x):\n    """Says what x is."""\n    return eval(x)\n'
    rows = [("A", "m.py", "python", text, 60), ("B", "m.py", "python", "# lint: ignore-file SEC002-eval-sink\n" + text, 90), ("A", "pkg/a.py", "python", "import pkg.b\n", 9), ("B", "pkg/b.py", "python", "import pkg.a\n", 9), ("A", "pkg/b.py", "python", "x = 1\n", 9), ("B", "pkg/a.py", "python", "x = 1\n", 9)]
    r = engine.run(spark.createDataFrame(rows, tree.FILES), only=["SEC002-eval-sink", "CPLX002-cyclic-deps"])
    assert [(x["project"], x["path"], x["rule_id"]) for x in r.findings.collect()] == [("A", "m.py", "SEC002-eval-sink")]
    assert r.stats["suppressed"] == 1
    other = r.findings.withColumn("project", F.lit("B"))
    assert engine.filtered(r, other).findings.count() == 1 and engine.filtered(r, other.drop("project")).findings.count() == 0


def test_every_rule_has_a_case_that_fires_and_one_that_does_not():
    named = {r for f in cases.FAMILIES.values() for r in f.rules}
    assert named == {r.id for r in RULES}
    assert {r[1] for f in cases.FAMILIES.values() for r in cases.rows(f)} == named
    for f in cases.FAMILIES.values():
        for rule in f.rules:
            quiet = set(f.projects) - {p for p, r, *_ in cases.rows(f) if r == rule}
            assert quiet, rule


def test_run_with_a_cache(spark, folder, tmp_path):
    cache, only = str(tmp_path / "cache"), ["SEC002-eval-sink", "DOC002-todo-fixme"]
    first = engine.run_tree(spark, str(folder), "demo", only=only, cache=cache)
    again = engine.run_tree(spark, str(folder), "demo", only=only, cache=cache)
    plain = engine.run_tree(spark, str(folder), "demo", only=only)
    key = lambda r: sorted(tuple(x) for x in r.findings.select("path", "line", "rule_id", "message").collect())
    assert key(first) == key(again) == key(plain)
    assert first.stats["cache_hits"] == 0 and again.stats["cache_hits"] == again.stats["files_scanned"]
    # Contents that are gone leave the cache once they are most of it.
    files = tree.scan(spark, str(folder), "demo")
    for i in range(4):
        watch.incremental(files.withColumn("content", F.concat("content", F.lit(f"\n# {i}\n"))), cache, "c")
    kept = spark.read.parquet(cache).where("kind = 'file'").count()
    assert kept <= 3 * files.where("language is not null").count() + 16


def test_walk_follows_ignore_rules(spark, tmp_path):
    texts = {
        ".gitignore": "# rules\n*.log\n/build/\n!keep.log\ndocs/**/tmp\nliteral{a,b}\n", "a.log": "", "keep.log": "", "build/x.py": "", "pkg/build/x.py": "", "pkg/__init__.py": "x = 1\n", "pkg/.hidden.py": "", "_top.py": "",
        "pkg/.gitignore": "own.py\n!deep.log\n", "pkg/own.py": "", "pkg/deep.log": "", "own.py": "", "docs/a/tmp/x.py": "", "docs/a/b.py": "", ".github/workflows/ci.yml": "x", ".github/tool.py": "", ".other/x.py": "", ".git/config": "",
        "node_modules/m.js": "", "sub/.ignore": "*.rs\n", "sub/a.rs": "", "sub/b.js": "", "z.rs": "",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r["path"]: r["language"] for r in tree.scan(spark, str(tmp_path), exclude=("z.*",)).collect()}
    assert got == {"keep.log": None, "pkg/build/x.py": "python", "pkg/__init__.py": "python", "_top.py": "python", "pkg/deep.log": None, "own.py": "python", "docs/a/b.py": "python", ".github/workflows/ci.yml": None, ".github/tool.py": None, "sub/b.js": "js"}
    assert tree.scan(spark, str(tmp_path), exclude=("**",)).count() == 0


def test_api_rules_against_a_commit(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@x", "-c", "user.name=a", *a], check=True, capture_output=True)
    (tmp_path / "pyproject.toml").write_text('[project]\nname = "demo"\nversion = "1.2.0"\n')
    (tmp_path / "__init__.py").write_text("def gone():\n    return 1\n")
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    (tmp_path / "pyproject.toml").write_text('[project]\nname = "demo"\nversion = "1.3.0"\n')
    (tmp_path / "__init__.py").write_text("x = 1\n")
    only = ["API001-public-symbol-removed", "API003-semver-alignment", "HEALTH003-low-bus-factor"]
    r = engine.run_tree(spark, str(tmp_path), "demo", only=only, git=True, since="HEAD")
    assert {x["rule_id"] for x in r.findings.collect()} == set(only)


def test_offsets_are_bytes(spark):
    text = "# é\nx = 'ü'\n"
    rows = spark.createDataFrame([("p", "a.py", "python", text, 9)], tree.FILES)
    s = facts.parse(rows).where("kind = 'string'").first()
    assert text.encode()[s["start"] : s["end"]].decode() == "'ü'" and s["line"] == 2
