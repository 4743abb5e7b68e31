"""Small projects for the rules, and the findings that each must give: for every rule one project that it marks and one that it leaves alone.

A family of projects is one table of files. Expected findings are written out as ``rule path:line severity``, with - for
an empty path; a project without an entry must have none of the family's rules.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintarium.functions.severity import lookup
from lintarium.plans import rules
from lintarium.sources import facts, tree


@dataclass
class Family:
    """Projects by name with their files by path, the rules that are judged, and the expected findings by project."""

    rules: list[str]
    projects: dict[str, dict[str, str]]
    expected: dict[str, str]
    #: Bytes of files that are larger than their text says.
    sizes: dict[str, int] = field(default_factory=dict)
    #: Lines of ``author|time`` and (tag, time) by project.
    commits: dict[str, list[str]] = field(default_factory=dict)
    tags: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    #: Files of an earlier version by project, with the two versions.
    earlier: dict[str, tuple[dict[str, str], str, str]] = field(default_factory=dict)


NOW = "2024-06-01"


def files(spark: SparkSession, projects: dict[str, dict[str, str]], sizes: dict[str, int] | None = None) -> DataFrame:
    rows = [(project, path, text, (sizes or {}).get(f"{project}/{path}", len(text.encode()))) for project, tree_ in projects.items() for path, text in tree_.items()]
    table = spark.createDataFrame(rows, "project string, path string, content string, n_bytes long")
    language = lookup(F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)), tree.LANGUAGES)
    return table.select("project", "path", language.alias("language"), "content", "n_bytes")


def found(spark: SparkSession, f: Family) -> DataFrame:
    """(project, rule_id, path, line, severity) that the family's rules give for its projects."""
    table, more = files(spark, f.projects, f.sizes), {}
    if f.commits or f.tags:
        lines = [(p, *x.split("|")) for p, xs in f.commits.items() for x in xs]
        more["commits"] = spark.createDataFrame(lines, "project string, author string, ts string").withColumn("ts", F.to_timestamp("ts"))
        tags = [(p, name, datetime.fromisoformat(at), i) for p, xs in f.tags.items() for i, (name, at) in enumerate(xs)]
        more["tags"] = spark.createDataFrame(tags, "project string, name string, ts timestamp, ord int")
    if f.earlier:
        more["baseline"] = facts.parse(files(spark, {p: x[0] for p, x in f.earlier.items()}))
        more["versions"] = {p: x[1:] for p, x in f.earlier.items()}
    out = rules.analyze(rules.Project(table, now=NOW, **more), f.rules)
    return out.select("project", "rule_id", "path", "line", "severity")


def rows(f: Family) -> list[tuple[str, str, str, int, str]]:
    """The expected findings."""
    out = []
    for project, text in f.expected.items():
        for line in filter(None, map(str.strip, text.splitlines())):
            rule, place, severity = line.split()
            path, at = place.rsplit(":", 1)
            out.append((project, rule, path.removeprefix("-"), int(at), severity))
    return out


def sql(f: Family) -> str:
    """The expected findings as a query."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(p)}, {quoted(r)}, {quoted(path)}, CAST({line} AS INTEGER), {quoted(s)})" for p, r, path, line, s in rows(f))
    return f"SELECT * FROM (VALUES {values}) AS t(project, rule_id, path, line, severity)"


FAMILIES: dict[str, Family] = {}

# --- measures of functions and files ---------------------------------------------------------------------------------

_IFS = lambda n, pad="    ": "".join(f"{pad}if a == {i}:\n{pad}    a += 1\n" for i in range(n))
_NEST = "    for x in a:\n        if x:\n            while x:\n                if a:\n                    x = a\n"
_BRACES = lambda n: "".join(f"    if a == {i} {{ a += 1; }}\n" for i in range(n))
_CASES = lambda n: "".join(f"  if (a === {i}) {{ a += 1; }}\n" for i in range(n))

FAMILIES["rules_measures"] = Family(
    ["MAINT001-cyclomatic", "MAINT002-cognitive", "MAINT003-fn-length", "MAINT004-file-length", "MAINT005-deep-nesting", "MAINT006-too-many-params", "MAINT007-return-complexity", "MAINT008-large-impl-block", "CPLX001-fan-out"],
    {
        "loud": {
            "a.py": f"def f(a):\n{_IFS(10)}    return a\n\n\ndef g(a, b, c, d, e, f):\n    return a\n",
            "b.py": "def h(a):\n    for x in a:\n        if x:\n            while x:\n                if a:\n                    for y in a:\n                        x = y\n    return a\n",
            "c.py": "def r(a):\n" + "".join(f"    if a == {i}:\n        return {i}\n" for i in range(5)) + "    return a\n",
            "d.py": "def long(a):\n" + "".join(f"    a = a + {i}\n" for i in range(81)) + "    return a\n",
            "e.py": "x = 1\n" * 601,
            "f.py": "class C:\n" + "".join(f"    def m{i}(self):\n        return {i}\n\n" for i in range(31)),
            "g.py": "".join(f"import m{i}\n" for i in range(21)),
            "k.py": f"def k(a):\n{_NEST}{_NEST}    return a\n",
            "l.rs": f"fn f(mut a: u32) -> u32 {{\n{_BRACES(10)}    a\n}}\nfn g(a: u8, b: u8, c: u8, d: u8, e: u8, f: u8) {{ }}\n",
            "j.js": f"function f(a) {{\n{_CASES(10)}  return a;\n}}\nfunction g(a, b, c, d, e, h) {{ return a; }}\n",
        },
        "calm": {
            "a.py": f"def f(a):\n{_IFS(9)}    return a\n\n\ndef g(a, b, c, d, e):\n    return a\n",
            "c.py": "def r(a):\n    if a == 1:\n        return 1\n    if a == 2:\n        return 2\n    return a\n",
            "d.py": "def short(a):\n" + "".join(f"    a = a + {i}\n" for i in range(60)) + "    return a\n",
            "e.py": "x = 1\n" * 599,
            "f.py": "class C:\n" + "".join(f"    def m{i}(self):\n        return {i}\n\n" for i in range(30)),
            "g.py": "".join(f"import m{i}\n" for i in range(20)) + "import m1\n",
            "k.py": f"def k(a):\n{_NEST}    return a\n",
            "l.rs": f"fn f(mut a: u32) -> u32 {{\n{_BRACES(9)}    a\n}}\n",
            "j.js": f"function f(a) {{\n{_CASES(9)}  return a;\n}}\n",
        },
    },
    {
        "loud": """
            MAINT001-cyclomatic a.py:1 medium
            MAINT006-too-many-params a.py:25 low
            MAINT005-deep-nesting b.py:1 medium
            MAINT007-return-complexity c.py:1 low
            MAINT003-fn-length d.py:1 low
            MAINT004-file-length e.py:1 low
            MAINT008-large-impl-block f.py:2 low
            CPLX001-fan-out g.py:1 low
            MAINT002-cognitive k.py:1 medium
            MAINT001-cyclomatic l.rs:1 medium
            MAINT006-too-many-params l.rs:14 low
            MAINT001-cyclomatic j.js:1 medium
            MAINT006-too-many-params j.js:14 low
        """,
    },
)

# --- documentation, copies, cycles ------------------------------------------------------------------------------------

_COPY = "one = load()\ntwo = one + 1\nthree = two * 2\nfour = three - 1\nfive = four / 2\nsix = five % 3\n"

FAMILIES["rules_documents"] = Family(
    ["DOC001-public-api-undoc", "DOC002-todo-fixme", "DOC003-empty-doc", "DOC004-stale-doc", "MAINT014-commented-out-code", "CPLX002-cyclic-deps", "CPLX003-duplicate-code"],
    {
        "loud": {
            "a.py": 'def bare(a):\n    return a\n\n\ndef said(a):\n    """said"""\n    return a\n\n\ndef stale(a):\n    """Adds.\n\n    :param gone: what was\n    :param a: what is\n    """\n    return a  # TODO later\n',
            "b.py": "# if a:\n#     return go(b);\n# else:\nx = 1\n",
            "c.rs": "/// Reads.\n///\n/// - `gone` what was\n/// * `a` what is\npub fn read(a: u8) -> u8 { a }\npub fn bare() {}\n// FIXME soon\n",
            "d.js": "/** Reads.\n * @param {string} gone what was\n * @param a what is\n */\nexport function read(a) { return a; }\nexport function bare() {}\n",
        },
        "calm": {
            "a.py": 'def add(a):\n    """Adds one to a number.\n\n    :param a: what is\n    """\n    return a\n\n\ndef _own(a):\n    return a\n',
            "b.py": "# A comment of prose\n# that goes on\n# for three lines\nx = 1\n",
            "c.rs": "/// Reads a byte.\n///\n/// - `a` what is\npub fn read(a: u8) -> u8 { a }\nfn own() {}\n",
            "d.js": "/** Reads a byte.\n * @param a what is\n */\nexport function read(a) { return a; }\nfunction own() {}\n",
        },
        "round": {
            "p/one.py": "import p.two\n",
            "p/two.py": "from p.three import x\n",
            "p/three.py": "import p.one\n",
            "w/a.js": "import { b } from './b.js';\n",
            "w/b.ts": "import { a } from '../w/a';\n",
            "w/c.js": "import { a } from './a.mjs';\n",
        },
        # The same paths as halves of a cycle in two projects, which is none.
        "half": {"pkg/a.py": "import pkg.b\n"},
        "other half": {"pkg/b.py": "import pkg.a\n", "pkg/a.py": "x = 1\n"},
        "copies": {"a.py": _COPY, "b.py": "import os\n" + _COPY, "c.py": _COPY.replace("\n", "\n\n# between\n")},
        "near copies": {"a.py": _COPY, "b.py": _COPY.replace("six", "seven")},
    },
    {
        "loud": """
            DOC001-public-api-undoc a.py:1 medium
            DOC003-empty-doc a.py:5 info
            DOC004-stale-doc a.py:10 low
            DOC002-todo-fixme a.py:16 info
            MAINT014-commented-out-code b.py:1 info
            DOC004-stale-doc c.rs:5 low
            DOC001-public-api-undoc c.rs:6 medium
            DOC002-todo-fixme c.rs:7 info
            DOC004-stale-doc d.js:5 low
            DOC001-public-api-undoc d.js:6 medium
        """,
        "round": """
            CPLX002-cyclic-deps p/one.py:1 high
            CPLX002-cyclic-deps w/a.js:1 high
        """,
        "copies": """
            CPLX003-duplicate-code b.py:2 medium
            CPLX003-duplicate-code c.py:1 medium
        """,
    },
)

# --- security over lines and literals ---------------------------------------------------------------------------------

FAMILIES["rules_security"] = Family(
    ["SEC003-shell-injection", "SEC004-weak-crypto", "SEC005-insecure-deser", "SEC006-sql-injection", "SEC007-path-traversal", "SEC008-csrf-missing", "SEC009-open-redirect", "SEC010-ssrf", "SEC011-cors-permissive", "SEC014-redos-regex", "DEP001-vulnerable-deps"],
    {
        "loud": {
            "a.py": 'import subprocess\nimport pickle\nimport yaml\n\n\ndef f(x):\n    subprocess.run("bash -c ls")\n    y = pickle.loads(x)\n    z = yaml.load(x)\n    q = f"SELECT * FROM t WHERE id = {x}"\n    h = hash_of("md5", x)\n    return open("../" + x)\n',
            "b.py": 'import flask\nimport re\n\n\n@app.post("/pay")\ndef pay(request):\n    requests.get(request.args["u"])\n    urlopen(f"http://{x}")\n    aiohttp.ClientSession(request.json["u"])\n    return redirect(request.args["next"])\n\n\nbad = re.compile("(a+)+b")\n',
            "c.js": "import axios from 'axios';\naxios(req.query.u);\nfetch(`http://${x}`);\nres.redirect(req.query.to);\nres.setHeader('Access-Control-Allow-Origin', '*');\nconst bad = /(a+)+b/;\n",
            "d.rs": 'use std::process::Command;\nfn f(u: &str) {\n    let r = reqwest::Client::new().get(format!("http://{}", u));\n    let h = hyper::Client::new(); let v = format!("{}", u);\n    let s = "sh -c ls";\n    let l = CorsLayer::permissive();\n}\n',
            "requirements.txt": "flask==1.0.2\nrequests==2.3.0\n",
            "Cargo.lock": '[[package]]\nname = "serde_yaml"\nversion = "0.9.1"\n',
            "package-lock.json": '{"packages": {\n  "node_modules/lodash": {"version": "4.17.1"}\n}}\n',
        },
        "calm": {
            "a.py": 'import subprocess\nimport yaml\n\n\ndef f(x):\n    subprocess.run(["ls"])\n    z = yaml.load(\n        x,\n        Loader=yaml.SafeLoader,\n    )\n    q = "SELECT * FROM t WHERE id = ?"\n    h = hash_of("sha256", x)\n    return open("data.txt")\n',
            "b.py": 'import flask\nfrom flask_wtf import csrf\nimport re\n\n\n@app.post("/pay")\ndef pay(request):\n    requests.get("http://example.com")\n    # requests.get(request.args["u"])\n    return redirect("/home")\n\n\ngood = re.compile("(ab)+c")\n',
            "c.js": "import axios from 'axios';\naxios('http://example.com');\nres.redirect('/home');\nres.setHeader('Access-Control-Allow-Origin', 'https://example.com');\nconst good = /ab+c/;\n",
            "d.rs": 'fn f(u: &str) {\n    let r = reqwest::blocking::Client::builder();\n    let s = "sh -c ls";\n}\n',
            "requirements.txt": "flask==2.0\nrequests==3.0.0\nlodash==4.16.0\n",
        },
    },
    {
        "loud": """
            SEC003-shell-injection a.py:7 high
            SEC005-insecure-deser a.py:8 high
            SEC005-insecure-deser a.py:9 high
            SEC006-sql-injection a.py:10 high
            SEC004-weak-crypto a.py:11 medium
            SEC007-path-traversal a.py:12 high
            SEC008-csrf-missing b.py:6 medium
            SEC010-ssrf b.py:7 high
            SEC010-ssrf b.py:8 high
            SEC010-ssrf b.py:9 high
            SEC009-open-redirect b.py:10 medium
            SEC014-redos-regex b.py:13 high
            SEC010-ssrf c.js:2 high
            SEC010-ssrf c.js:3 high
            SEC009-open-redirect c.js:4 medium
            SEC011-cors-permissive c.js:5 medium
            SEC014-redos-regex c.js:6 high
            SEC010-ssrf d.rs:3 high
            SEC010-ssrf d.rs:4 high
            SEC003-shell-injection d.rs:5 high
            SEC011-cors-permissive d.rs:6 medium
            DEP001-vulnerable-deps requirements.txt:1 high
            DEP001-vulnerable-deps requirements.txt:2 high
            DEP001-vulnerable-deps Cargo.lock:2 high
            DEP001-vulnerable-deps package-lock.json:2 high
        """,
    },
)

# --- tests ------------------------------------------------------------------------------------------------------------

FAMILIES["rules_tests"] = Family(
    ["TEST001-test-ratio", "TEST002-no-asserts", "TEST003-skipped", "TEST004-flaky-time", "TEST005-assert-count", "TEST006-shared-mutable-state"],
    {
        "loud": {
            "src/a.py": "x = 1\n",
            "src/b.py": "x = 1\n",
            "src/c.py": "x = 1\n",
            "tests/test_a.py": "import pytest\n\nstore = []\n\n\n@pytest.mark.skip\ndef test_a():\n    store.append(1)\n    time.sleep(1)\n",
            "tests/test_b.py": "def test_b():\n" + "    assert f()\n" * 11,
            "tests/t.rs": "#[test]\nfn slow() { assert!(Instant::now() > x); }\n#[ignore]\nfn other() {}\n",
            "tests/u.test.js": "describe('u', () => { it.skip('x', () => {}); });\nit.skip('y', () => { expect(1); });\nxit('z', () => { setTimeout(go, 1); });\n",
        },
        "calm": {
            "src/a.py": "x = 1\n",
            "src/b.py": "x = 1\n",
            "tests/test_a.py": "import pytest\n\nstore = []\n\n\n@pytest.fixture\ndef fresh():\n    return []\n\n\ndef test_a(fresh):\n    fresh.append(1)\n    assert fresh\n",
            "tests/test_b.py": "def test_b():\n" + "    assert f()\n" * 10,
            "tests/t.rs": "#[test]\nfn quick() { assert!(true); }\n",
        },
    },
    {
        "loud": """
            TEST001-test-ratio src/a.py:1 low
            TEST002-no-asserts tests/test_a.py:1 medium
            TEST003-skipped tests/test_a.py:6 info
            TEST004-flaky-time tests/test_a.py:7 medium
            TEST004-flaky-time tests/test_a.py:7 medium
            TEST006-shared-mutable-state tests/test_a.py:7 medium
            TEST005-assert-count tests/test_b.py:1 low
            TEST004-flaky-time tests/t.rs:2 medium
            TEST003-skipped tests/t.rs:3 info
            TEST003-skipped tests/u.test.js:2 info
            TEST003-skipped tests/u.test.js:3 info
        """,
    },
)

# --- code of each language --------------------------------------------------------------------------------------------

FAMILIES["rules_python"] = Family(
    ["SEC002-eval-sink", "SEC012-hardcoded-security-constant", "SEC013-bind-all-interfaces", "SEC015-log-injection", "SEC016-dangerous-function", "MAINT009-missing-default-case", "MAINT010-infinite-loop-no-exit", "MAINT011-active-debug-code", "MAINT012-dead-store", "MAINT013-empty-block", "MAINT015-deprecated-function", "MAINT016-unreachable-code", "MAINT018-global-var-density", "PERF001-heavy-import", "PERF003-import-side-effect"],
    {
        "loud": {
            "a.py": 'import numpy\nimport warnings\n\napi_token = "abc123"\nprint("loaded")\n\n\ndef f(request, logger):\n    logger.info("got %s", request)\n    while True:\n        pass\n\n\ndef g(x):\n    for y in x:\n        pass\n    breakpoint()\n    return eval(x)\n    x = 2\n\n\ndef h(app):\n    app.run(host="0.0.0.0")\n    unused = 1\n    unused = 2\n    return unused\n',
            "b.py": 'import warnings\n\n\ndef old():\n    warnings.warn("gone", DeprecationWarning)\n\n\ndef m(x):\n    match x:\n        case 1:\n            return 2\n        case 3:\n            return 4\n',
            "c.py": "a = b = c = 1\n\n\ndef f():\n    global a, b\n    a = b = 2\n\n\ndef g():\n    global c\n    c = 3\n",
        },
        "calm": {
            "a.py": 'import json\n\ntoken_count = "12"\n\n\ndef f(logger):\n    logger.info("ready")\n    while True:\n        if done():\n            break\n\n\ndef h(app):\n    app.run(host="127.0.0.1")\n    used = 1\n    return used\n',
            "b.py": "def m(x):\n    match x:\n        case 1:\n            return 2\n        case _:\n            return 4\n\n\ndef n(x):\n    import numpy\n\n    return numpy.sum(x)\n",
            "c.py": "a = b = c = 1\n\n\ndef f():\n    global a, b\n    a = b = 2\n",
        },
    },
    {
        "loud": """
            PERF001-heavy-import a.py:1 medium
            SEC012-hardcoded-security-constant a.py:4 high
            MAINT011-active-debug-code a.py:5 medium
            PERF003-import-side-effect a.py:5 medium
            SEC015-log-injection a.py:9 medium
            MAINT010-infinite-loop-no-exit a.py:10 high
            MAINT013-empty-block a.py:10 low
            MAINT013-empty-block a.py:15 low
            MAINT011-active-debug-code a.py:17 medium
            SEC002-eval-sink a.py:18 high
            SEC016-dangerous-function a.py:18 medium
            MAINT012-dead-store a.py:19 low
            MAINT016-unreachable-code a.py:19 low
            SEC013-bind-all-interfaces a.py:23 medium
            MAINT012-dead-store a.py:24 low
            MAINT015-deprecated-function b.py:4 medium
            MAINT009-missing-default-case b.py:9 medium
            MAINT018-global-var-density c.py:5 low
        """,
    },
)

FAMILIES["rules_rust"] = Family(
    ["SEC012-hardcoded-security-constant", "SEC013-bind-all-interfaces", "SEC015-log-injection", "SEC016-dangerous-function", "SEC101-rust-unsafe", "SOUND001-unsafe-block-missing-safety-comment", "SOUND002-unsafe-in-pub-api-signature", "SOUND003-transmute-usage", "SOUND004-raw-pointer-in-pub-api", "SOUND005-unsafe-and-parsing-combo", "SOUND006-ffi-without-safety-doc", "MAINT009-missing-default-case", "MAINT010-infinite-loop-no-exit", "MAINT011-active-debug-code", "MAINT012-dead-store", "MAINT013-empty-block", "MAINT015-deprecated-function", "MAINT016-unreachable-code", "MAINT018-global-var-density", "MAINT019-unconditional-branch", "PERF002-clone-in-iter-chain", "PERF003-arc-mutex-density", "PERF010-allocation-in-loop", "ECO003-send-sync-violations-on-pub-types"],
    {
        "loud": {
            "a.rs": 'pub unsafe fn raw(p: *const u8) -> u8 { *p }\n#[deprecated]\npub fn old(v: Vec<u8>) -> u8 {\n    let x = unsafe { std::mem::transmute::<u8, u8>(v[0]) };\n    match x { 1 => 2, 2 => 3 }\n}\npub static mut A: u32 = 1;\npub static mut B: u32 = 1;\npub static mut C: u32 = 1;\n',
            "b.rs": 'fn spin(request: &str) {\n    loop { step(); }\n}\nfn each(items: Vec<String>) {\n    for i in 0..3 { let s = format!("{}", i); }\n    let t = items.iter().map(|z| z.clone());\n    dbg!(1);\n    info!("got {}", items);\n    if a {} else { go(); }\n    let password = "hunter2";\n    TcpListener::bind("0.0.0.0:80");\n    strcpy(a, b);\n    return;\n    done();\n}\npub struct P { p: *mut u8 }\nextern "C" { unsafe fn foreign(); }\n',
            "c.rs": 'fn decode(d: &[u8]) -> u8 {\n    // SAFETY: checked\n    let v = unsafe { from_utf8_unchecked(d) };\n    from_slice(d)\n}\nfn log_it(request: &str) { info!("got {}", request); }\n',
            "d.rs": "fn pick(x: u32) -> u32 {\n    match x {\n" + "".join(f"        {i} => {i},\n" for i in range(11)) + "        _ => 0,\n    }\n}\n",
            "e.rs": "struct S {\n" + "".join(f"    f{i}: Arc<Mutex<u8>>,\n" for i in range(6)) + "}\n",
        },
        "calm": {
            "a.rs": 'pub fn raw(p: &u8) -> u8 { *p }\nfn old(v: Vec<u8>) -> u8 {\n    // SAFETY: the length was tested.\n    match v[0] { 1 => 2, _ => 3 }\n}\npub static A: u32 = 1;\npub static B: u32 = 1;\n',
            "b.rs": 'fn spin() {\n    loop { if done() { break; } }\n}\nfn each(items: Vec<String>) {\n    for i in 0..3 { step(i); }\n    info!("ready");\n    if a { stop(); } else { go(); }\n    let password = "";\n    TcpListener::bind("127.0.0.1:80");\n    done();\n}\npub struct P { p: u8 }\n',
            "d.rs": "fn pick(x: u32) -> u32 {\n    match x {\n" + "".join(f"        {i} => {i},\n" for i in range(5)) + "        _ => 0,\n    }\n}\n",
            "e.rs": "struct S {\n" + "".join(f"    f{i}: Arc<Mutex<u8>>,\n" for i in range(5)) + "}\n",
        },
    },
    {
        "loud": """
            SEC101-rust-unsafe a.rs:1 info
            SOUND002-unsafe-in-pub-api-signature a.rs:1 high
            SOUND004-raw-pointer-in-pub-api a.rs:1 high
            MAINT015-deprecated-function a.rs:3 medium
            SEC101-rust-unsafe a.rs:4 info
            SOUND001-unsafe-block-missing-safety-comment a.rs:4 medium
            SOUND003-transmute-usage a.rs:4 high
            MAINT009-missing-default-case a.rs:5 medium
            MAINT018-global-var-density a.rs:7 low
            MAINT010-infinite-loop-no-exit b.rs:2 high
            PERF010-allocation-in-loop b.rs:5 low
            PERF002-clone-in-iter-chain b.rs:6 medium
            MAINT011-active-debug-code b.rs:7 medium
            SEC015-log-injection b.rs:8 medium
            MAINT013-empty-block b.rs:9 low
            SEC012-hardcoded-security-constant b.rs:10 high
            SEC013-bind-all-interfaces b.rs:11 medium
            SEC016-dangerous-function b.rs:12 high
            MAINT016-unreachable-code b.rs:14 low
            ECO003-send-sync-violations-on-pub-types b.rs:16 low
            SEC101-rust-unsafe b.rs:17 info
            SOUND006-ffi-without-safety-doc b.rs:17 medium
            SOUND005-unsafe-and-parsing-combo c.rs:1 high
            SEC101-rust-unsafe c.rs:3 info
            SEC015-log-injection c.rs:6 medium
            MAINT019-unconditional-branch d.rs:2 low
            PERF003-arc-mutex-density e.rs:1 low
        """,
    },
)

FAMILIES["rules_js"] = Family(
    ["SEC002-eval-sink", "SEC012-hardcoded-security-constant", "SEC013-bind-all-interfaces", "SEC015-log-injection", "BUG001-assignment-in-condition", "BUG002-switch-fallthrough", "BUG004-operator-precedence", "STYLE001-block-delimitation", "MAINT009-missing-default-case", "MAINT010-infinite-loop-no-exit", "MAINT011-active-debug-code", "MAINT012-dead-store", "MAINT013-empty-block", "MAINT015-deprecated-function", "MAINT016-unreachable-code", "PERF002-heavy-import", "PERF003-import-side-effect"],
    {
        "loud": {
            "a.js": "import _ from 'lodash';\n/** @deprecated use g */\nexport function f(a, b) {\n  let x = 1;\n  x = 2;\n  if (a = b) { go(); }\n  switch (a) { case 1: go(); case 2: break; }\n  while (true) { go(); }\n}\n",
            "b.js": "export function g(a, req) {\n  if (a & b == 1) { go(); }\n  console.log(a);\n  logger.info(`u ${req}`);\n  el.innerHTML = a;\n  eval(a);\n  if (a) {}\n  return\n  a;\n}\ninit();\n",
            "c.js": "const apiKey = 'abc123';\nfunction h(app) {\n  app.listen(80, '0.0.0.0');\n  debugger;\n  return 1;\n  go();\n}\n",
        },
        "calm": {
            "a.js": "import x from './x';\nexport function f(a, b) {\n  let x = 1;\n  use(x);\n  if (a === b) { go(); }\n  switch (a) { case 1: go(); break; default: break; }\n  while (true) { if (a) { break; } }\n}\n",
            "b.js": "export function g(a) {\n  if ((a & b) === 1) { go(); }\n  logger.info('ready');\n  el.textContent = a;\n  return a;\n}\n",
            "c.js": "const apiKeyName = 'abc123';\nfunction h(app) {\n  app.listen(80, '127.0.0.1');\n}\n",
        },
    },
    {
        "loud": """
            PERF002-heavy-import a.js:1 medium
            MAINT015-deprecated-function a.js:3 medium
            MAINT012-dead-store a.js:4 low
            BUG001-assignment-in-condition a.js:6 medium
            BUG002-switch-fallthrough a.js:7 medium
            MAINT009-missing-default-case a.js:7 medium
            MAINT010-infinite-loop-no-exit a.js:8 high
            BUG004-operator-precedence b.js:2 medium
            MAINT011-active-debug-code b.js:3 low
            SEC015-log-injection b.js:4 medium
            SEC002-eval-sink b.js:5 high
            SEC002-eval-sink b.js:6 high
            MAINT013-empty-block b.js:7 low
            STYLE001-block-delimitation b.js:8 medium
            PERF003-import-side-effect b.js:11 medium
            SEC012-hardcoded-security-constant c.js:1 high
            SEC013-bind-all-interfaces c.js:3 medium
            MAINT011-active-debug-code c.js:4 medium
            MAINT016-unreachable-code c.js:6 low
        """,
    },
)

# --- manifests --------------------------------------------------------------------------------------------------------

_GOOD_CARGO = '[package]\nname = "demo"\nversion = "0.1.0"\nlicense = "MIT"\ndescription = "What it does"\nrepository = "https://example.com/x"\nrust-version = "1.80"\nkeywords = ["a"]\n[lib]\n[features]\nstd = []\n[dependencies]\nserde = "1"\ntokio = { version = "1", default-features = false, features = ["rt"] }\nfutures = "0.3"\npinned_elsewhere = { git = "https://example.com/x", tag = "v1" }\nbeside_this_one = { path = "../x", version = "1" }\n[lints.rust]\nwarnings = "deny"\n'
_GOOD_CI = "jobs:\n  a:\n    runs-on: windows-latest\n    steps:\n      - run: cargo deny check\n      - run: cargo +1.80 test\n"

FAMILIES["rules_cargo"] = Family(
    ["PKG001-invalid-cargo-toml", "PKG002-license-not-declared", "PKG003-description-missing", "PKG004-repository-missing", "PKG005-rust-version-unconstrained", "PKG006-readme-missing", "PKG007-version-mismatch", "PKG008-keywords-categories-missing", "PKG009-default-features-bloat", "PKG010-workspace-inheritance-broken", "CHAIN001-no-lockfile", "CHAIN002-typosquat-suspicion", "CHAIN003-git-dependency-without-rev", "CHAIN004-path-dependency-in-published-crate", "CI001-no-ci-config", "CI002-no-msrv-test-job", "CI003-no-windows-job", "CI004-no-cargo-deny-job", "CI005-no-dependabot", "CI006-warnings-not-denied", "ECO001-no-no-std-feature", "ECO002-async-runtime-coupling", "ECO004-feature-graph-fragmented", "PERF001-heavy-default-features", "HEALTH005-changelog-missing"],
    {
        "bare": {"Cargo.toml": '[package]\nname = "demo"\nversion = "0.1.0"\n[[bin]]\nname = "demo"\n[lib]\n[features]\nslim = ["!full"]\n[dependencies]\nserd = "1"\ntokio = { version = "1", features = ["full"] }\nbeside_this_one = { path = "../x" }\nfloating_elsewhere = { git = "https://example.com/x" }\nof_the_workspace = { workspace = true }\n'},
        "some": {
            "Cargo.toml": _GOOD_CARGO.replace('warnings = "deny"', 'warnings = "warn"').replace('rust-version = "1.80"', 'rust-version = "1.70"'),
            "README.md": "Demo\n", "CHANGELOG.md": "1\n", ".github/workflows/ci.yml": "jobs:\n  a:\n    runs-on: ubuntu-latest\n", ".github/dependabot.yml": "version: 2\n",
        },
        "calm": {"Cargo.toml": _GOOD_CARGO, "README.md": "Demo\n", "CHANGELOG.md": "1\n", ".github/workflows/ci.yml": _GOOD_CI, ".github/dependabot.yml": "version: 2\n"},
        "broken": {"Cargo.toml": "[package\n", "README.md": "Demo\n", "CHANGELOG.md": "1\n", ".github/workflows/ci.yml": _GOOD_CI + "      - env: -D warnings\n", ".github/dependabot.yml": "version: 2\n"},
    },
    {
        "bare": """
            CHAIN001-no-lockfile Cargo.toml:1 medium
            CHAIN002-typosquat-suspicion Cargo.toml:1 high
            CHAIN003-git-dependency-without-rev Cargo.toml:1 medium
            CHAIN004-path-dependency-in-published-crate Cargo.toml:1 medium
            CI001-no-ci-config Cargo.toml:1 medium
            CI005-no-dependabot Cargo.toml:1 low
            ECO001-no-no-std-feature Cargo.toml:1 low
            ECO002-async-runtime-coupling Cargo.toml:1 low
            ECO004-feature-graph-fragmented Cargo.toml:1 low
            HEALTH005-changelog-missing Cargo.toml:1 low
            PERF001-heavy-default-features Cargo.toml:1 medium
            PKG002-license-not-declared Cargo.toml:1 medium
            PKG003-description-missing Cargo.toml:1 low
            PKG004-repository-missing Cargo.toml:1 low
            PKG005-rust-version-unconstrained Cargo.toml:1 low
            PKG006-readme-missing Cargo.toml:1 low
            PKG007-version-mismatch Cargo.toml:1 medium
            PKG008-keywords-categories-missing Cargo.toml:1 low
            PKG009-default-features-bloat Cargo.toml:1 medium
            PKG010-workspace-inheritance-broken Cargo.toml:1 medium
        """,
        "broken": """
            PKG001-invalid-cargo-toml Cargo.toml:1 high
        """,
        "some": """
            CI002-no-msrv-test-job Cargo.toml:1 low
            CI003-no-windows-job Cargo.toml:1 low
            CI004-no-cargo-deny-job Cargo.toml:1 low
            CI006-warnings-not-denied Cargo.toml:1 low
        """,
    },
    tags={"bare": [("v0.2.0", "2024-05-01")], "calm": [("v0.1.0", "2024-05-01")]},
)

_GOOD_PYPROJECT = '[project]\nname = "demo"\nversion = "1.0"\nlicense = "MIT"\nrequires-python = ">=3.10"\nclassifiers = ["Programming Language :: Python :: 3"]\ndependencies = ["requests>=2", "flask==1.0"]\n[project.scripts]\ngo = "demo.cli:main"\n'

FAMILIES["rules_pyproject"] = Family(
    ["PKG001-invalid-pyproject", "PKG002-metadata-incomplete", "PKG003-legacy-build-backend", "PKG004-license-not-declared", "PKG005-python-version-unconstrained", "PKG006-readme-missing", "PKG007-version-mismatch", "PKG008-entry-points-malformed", "PKG009-classifiers-missing", "PKG010-dynamic-version-unstable", "CHAIN001-no-lockfile", "CHAIN002-typosquat-suspicion", "CHAIN003-sigstore-bundle-missing", "CHAIN004-unpinned-runtime-dep", "PERF002-wheel-size", "HEALTH005-changelog-missing"],
    {
        "bare": {"pyproject.toml": '[project]\ndynamic = ["version"]\ndependencies = ["reqeusts", "flask==1.0"]\n[project.scripts]\ngo = "nope"\n', "dist/x-1.0.whl": "PK"},
        "calm": {"pyproject.toml": _GOOD_PYPROJECT, "README.md": "Demo\n", "CHANGELOG.md": "All that was changed, from the first version on to the last one.\n", "uv.lock": "\n", "demo/__init__.py": '__version__ = "1.0"\n', "dist/x-1.0.whl": "PK", "dist/x-1.0.whl.sigstore": "{}"},
        "other": {"pyproject.toml": _GOOD_PYPROJECT, "README.md": "Demo\n", "CHANGELOG.md": "short\n", "uv.lock": "\n", "demo/__init__.py": '__version__ = "1.1"\n', "dist/x-1.0.whl": "PK", "dist/x-1.0.whl.sigstore": "{}"},
        "legacy": {"setup.py": "setup()\n"},
        "broken": {"pyproject.toml": "[project\n", "README.md": "Demo\n", "CHANGELOG.md": "All that was changed, from the first version on to the last one.\n", "uv.lock": "\n"},
    },
    {
        "bare": """
            CHAIN003-sigstore-bundle-missing dist/x-1.0.whl:1 low
            CHAIN001-no-lockfile pyproject.toml:1 medium
            CHAIN002-typosquat-suspicion pyproject.toml:1 high
            CHAIN004-unpinned-runtime-dep pyproject.toml:1 medium
            HEALTH005-changelog-missing pyproject.toml:1 low
            PKG002-metadata-incomplete pyproject.toml:1 medium
            PKG004-license-not-declared pyproject.toml:1 medium
            PKG005-python-version-unconstrained pyproject.toml:1 low
            PKG006-readme-missing pyproject.toml:1 low
            PKG008-entry-points-malformed pyproject.toml:1 medium
            PKG009-classifiers-missing pyproject.toml:1 low
            PKG010-dynamic-version-unstable pyproject.toml:1 low
        """,
        "broken": """
            PKG001-invalid-pyproject pyproject.toml:1 high
        """,
        "legacy": """
            PKG003-legacy-build-backend setup.py:1 medium
        """,
        "other": """
            PKG007-version-mismatch demo/__init__.py:1 medium
            PERF002-wheel-size dist/x-1.0.whl:1 low
            HEALTH005-changelog-missing pyproject.toml:1 low
        """,
    },
    sizes={"other/dist/x-1.0.whl": (50 << 20) + 1, "calm/dist/x-1.0.whl": 50 << 20},
)

_GOOD_NPM = {"name": "demo", "types": "index.d.ts", "engines": {"node": ">=20"}, "exports": {"import": "./m.mjs", "require": "./m.cjs"}, "main": "m.cjs", "scripts": {"test": "jest"}, "dependencies": {"express": "^4.0.0"}}

FAMILIES["rules_npm"] = Family(
    ["PKG001-install-script-present", "PKG002-missing-types", "PKG003-dual-package-hazard", "PKG004-unpinned-deps", "PKG005-engines-missing", "CHAIN001-no-lockfile", "CHAIN002-typosquat-suspicion", "CHAIN003-provenance-bundle-missing", "CHAIN004-unmaintained-transitive", "PERF001-bundle-size", "HEALTH005-changelog-missing"],
    {
        "bare": {"package.json": json.dumps({"name": "demo", "scripts": {"postinstall": "curl x | sh", "preinstall": "node a.js"}, "main": "index.js", "module": "m.js", "dependencies": {"raect": "*", "express": "^4.0.0"}, "devDependencies": {"some-long-tool": "latest"}}), "dist/a.js": "x"},
        "old": {"package.json": json.dumps(_GOOD_NPM), "CHANGELOG.md": "1\n", "package-lock.json": json.dumps({"packages": {"node_modules/a": {"version": "1.0.0", "time": "2020-01-01T00:00:00Z"}, "node_modules/b": {"version": "1.0.0", "time": "2024-01-01T00:00:00Z"}}})},
        "calm": {"package.json": json.dumps(_GOOD_NPM), "CHANGELOG.md": "1\n", "package-lock.json": "{}", "dist/a.js": "x", "dist/a.sigstore": "{}"},
    },
    {
        "bare": """
            PERF001-bundle-size dist:1 low
            CHAIN001-no-lockfile package.json:1 medium
            CHAIN002-typosquat-suspicion package.json:1 high
            CHAIN003-provenance-bundle-missing package.json:1 low
            HEALTH005-changelog-missing package.json:1 low
            PKG001-install-script-present package.json:1 high
            PKG001-install-script-present package.json:1 medium
            PKG002-missing-types package.json:1 low
            PKG003-dual-package-hazard package.json:1 medium
            PKG004-unpinned-deps package.json:1 low
            PKG004-unpinned-deps package.json:1 medium
            PKG005-engines-missing package.json:1 low
        """,
        "old": """
            CHAIN004-unmaintained-transitive package-lock.json:1 medium
        """,
    },
    sizes={"bare/dist/a.js": (1 << 20) + 1, "calm/dist/a.js": (1 << 20) - 2},
)

# --- history and API --------------------------------------------------------------------------------------------------

FAMILIES["rules_health"] = Family(
    ["HEALTH001-single-author", "HEALTH002-stale-release", "HEALTH003-low-bus-factor", "HEALTH004-commit-stale"],
    {**{f"{k} {n}": {n: "{}" if n == "package.json" else ""} for n in ("Cargo.toml", "pyproject.toml", "package.json") for k in ("stale", "calm", "even")}},
    {
        "even Cargo.toml": """
            HEALTH003-low-bus-factor -:1 low
        """,
        "even package.json": """
            HEALTH003-low-bus-factor -:1 low
        """,
        "even pyproject.toml": """
            HEALTH002-stale-release -:1 medium
            HEALTH003-low-bus-factor -:1 medium
        """,
        "stale Cargo.toml": """
            HEALTH001-single-author -:1 low
            HEALTH002-stale-release -:1 medium
            HEALTH003-low-bus-factor -:1 low
            HEALTH004-commit-stale -:1 medium
        """,
        "stale package.json": """
            HEALTH001-single-author -:1 low
            HEALTH002-stale-release -:1 medium
            HEALTH003-low-bus-factor -:1 low
            HEALTH004-commit-stale -:1 medium
        """,
        "stale pyproject.toml": """
            HEALTH001-single-author -:1 medium
            HEALTH002-stale-release -:1 medium
            HEALTH003-low-bus-factor -:1 medium
            HEALTH004-commit-stale -:1 low
        """,
    },
    commits={
        **{f"stale {n}": ["a@x|2023-01-01T00:00:00Z", "a@x|2023-01-02T00:00:00Z", "b@x|2023-01-03T00:00:00Z"] for n in ("Cargo.toml", "pyproject.toml", "package.json")},
        **{f"calm {n}": ["a@x|2024-05-01T00:00:00Z", "b@x|2024-05-02T00:00:00Z", "c@x|2024-05-03T00:00:00Z"] for n in ("Cargo.toml", "pyproject.toml", "package.json")},
        **{f"even {n}": ["a@x|2024-05-01T00:00:00Z", "b@x|2024-05-02T00:00:00Z"] for n in ("Cargo.toml", "pyproject.toml", "package.json")},
    },
    tags={
        **{f"stale {n}": [("v1.0", "2022-01-01")] for n in ("Cargo.toml", "pyproject.toml", "package.json")},
        **{f"calm {n}": [("v1.1", "2024-05-01"), ("v1.0", "2022-01-01")] for n in ("Cargo.toml", "pyproject.toml", "package.json")},
    },
)

_API = 'def f(a):\n    return a\n\n\ndef g():\n    return 1\n\n\nclass C:\n    def m(self):\n        return 1\n\n\ndef _own():\n    return 2\n'

FAMILIES["rules_api"] = Family(
    ["API001-public-symbol-removed", "API002-signature-arity-changed", "API003-semver-alignment"],
    {
        "loud": {"a.py": _API.replace("def f(a)", "def f(a, b)").replace("def g()", "def _g()")},
        "major": {"a.py": _API.replace("def g()", "def _g()")},
        "idle": {"a.py": _API},
        "early": {"a.py": _API.replace("def f(a)", "def f(a, b)")},
        "calm": {"a.py": _API + "\n\ndef new():\n    return 3\n"},
    },
    {
        "early": """
            API002-signature-arity-changed a.py:1 medium
        """,
        "idle": """
            API003-semver-alignment pyproject.toml:1 low
        """,
        "loud": """
            API002-signature-arity-changed a.py:1 medium
            API001-public-symbol-removed a.py:5 high
            API003-semver-alignment pyproject.toml:1 low
        """,
        "major": """
            API001-public-symbol-removed a.py:5 high
        """,
    },
    earlier={
        "loud": ({"a.py": _API}, "1.2.0", "1.3.0"),
        "major": ({"a.py": _API}, "1.2.0", "2.0.0"),
        "idle": ({"a.py": _API}, "1.2.0", "2.0.0"),
        "early": ({"a.py": _API}, "0.2.0", "0.3.0"),
        "calm": ({"a.py": _API}, "1.2.0", "1.3.0"),
    },
)
