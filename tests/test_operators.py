"""Operators and functions against brute force."""

from __future__ import annotations

import random
import re
import time
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintarium.functions import severity
from lintarium.functions.text import glob_regex, lines, osa, position, version
from lintarium.operators import findings, graph, sequences, similarity
from lintarium.plans import analytics, catalog


@pytest.mark.parametrize(("glob", "yes", "no"), [("src/**/*.rs", ["src/a.rs", "src/x/y/a.rs"], ["a.rs", "src/a.py"]), ("*.py", ["a.py"], ["x/a.py"]), ("a/**", ["a/b/c"], ["b/a/c"]), ("{a,b}/?.js", ["a/x.js", "b/y.js"], ["c/x.js", "a/xy.js"]), ("[!a]*", ["b1"], ["a1", "b/c"]), ("a.b", ["a.b"], ["axb"])])
def test_globs(glob, yes, no):
    assert all(re.search(glob_regex(glob), p) for p in yes) and not any(re.search(glob_regex(glob), p) for p in no)


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
@settings(max_examples=150, deadline=None)
def test_osa_is_a_distance_with_swaps(a, b):
    assert osa(a, b) == osa(b, a) and (osa(a, b) == 0) == (a == b) and osa(a, b) <= max(len(a), len(b))
    if len(a) > 1:
        assert osa(a, a[1] + a[0] + a[2:]) <= 1
    assert osa("ca", "abc") == 3


def test_lines_and_positions(spark):
    texts = ["", "a", "é\nb\r\n\nc", "x\n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = defaultdict(list)
    for r in lines(df, "text", "id").orderBy("id", "line_no").collect():
        got[r["id"]].append((r["line_no"], r["text"], r["byte_start"]))
    for i, t in enumerate(texts):
        want, at = [], 0
        for k, row in enumerate(t.split("\n") if t is not None else [], 1):
            want.append((k, row.removesuffix("\r"), at))
            at += len(row.encode()) + 1
        assert got[i] == want
    p = spark.range(1).select(position(F.array(F.lit(0), F.lit(4), F.lit(9)), F.lit(5)).alias("p")).first()["p"]
    assert (p["line"], p["column"]) == (2, 2)


def test_lines_of_a_long_file_take_linear_time(spark):
    rows = [(f"line {i} é" if i % 3 else "") for i in range(150_000)]
    df = spark.createDataFrame([(1, "\n".join(rows)), (2, "yaml.load(\nx)\n" * 3)], "id int, text string")
    start = time.perf_counter()
    got = lines(df, "text", "id", ahead=("YAML.load(", 4)).collect()
    assert time.perf_counter() - start < 30
    one = sorted((r["line_no"], r["text"], r["byte_start"]) for r in got if r["id"] == 1)
    at, want = 0, []
    for i, row in enumerate(rows, 1):
        want.append((i, row, at))
        at += len(row.encode()) + 1
    assert one == want
    assert sorted((r["line_no"], bytes(r["rest"])) for r in got if r["rest"] is not None) == [(1, b"x)\ny"), (3, b"x)\ny"), (5, b"x)\n")]


def test_imports_stay_inside_their_project(spark):
    files = spark.createDataFrame([("p", "w/a.js"), ("p", "w/b.ts"), ("q", "w/b.ts"), ("q", "z/c.py")], "project string, path string")
    imports = spark.createDataFrame([("p", "w/a.js", m) for m in ("./b.js", "../x/b.mjs", "./c", "z.c", "./w/b")] + [("q", "z/c.py", "w.b")], "project string, path string, module string")
    got = {(r["project"], r["module"], r["dst"]) for r in graph.targets_by_suffix(imports, files, "project").collect()}
    assert got == {("p", "./b.js", "w/b.ts"), ("p", "../x/b.mjs", "w/b.ts"), ("p", "./c", None), ("p", "z.c", None), ("p", "./w/b", "w/b.ts"), ("q", "w.b", "w/b.ts")}


def test_severities(spark):
    df = spark.createDataFrame([(s,) for s in (*severity.SEVERITIES, "odd", None)], "s string")
    got = [tuple(r) for r in df.select(severity.rank(F.col("s")), severity.weight(F.col("s")), severity.heat(F.col("s"))).collect()]
    assert got == [(0, 0, 1), (1, 1, 2), (2, 4, 5), (3, 12, 10), (4, 30, 20), (-1, 0, 0), (-1, 0, 0)]


@given(st.lists(st.sampled_from(severity.SEVERITIES), max_size=8), st.floats(0, 50))
@settings(max_examples=8, deadline=None)
def test_scores_are_between_0_and_100(spark, levels, kloc):
    df = spark.createDataFrame([("security", s) for s in levels], "dimension string, severity string")
    rows = analytics.scores(df, severity.weight(F.col("severity")), kloc).collect()
    total = sum(severity.SCORE_WEIGHTS[s] for s in levels)
    assert {r["dimension"]: r["score"] for r in rows}["security"] == pytest.approx(100 - min(100, total / max(kloc, 1)), abs=1e-3)
    assert len(rows) == 5 and all(0 <= r["score"] <= 100 for r in rows)


def test_suppression(spark):
    f = spark.createDataFrame([("a", 5, "R"), ("a", 6, "R"), ("a", 7, "R"), ("a", 5, "S"), ("b", 1, "R"), (None, 1, "R")], "path string, line int, rule_id string")
    c = spark.createDataFrame([("a", 5, "lint: ignore R"), ("b", 90, "lint: ignore-file R, S"), ("a", 1, "a lint: ignore S")], "path string, line int, text string")
    left = {tuple(r) for r in findings.suppress(f, findings.directives(c)).collect()}
    assert left == {("a", 7, "R"), ("a", 5, "S"), (None, 1, "R")}


def test_diff_and_repeats(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,), (3,)], "k int")
    assert {tuple(r) for r in findings.diff(a, b, ["k"]).collect()} == {(1, "resolved"), (2, "persisting"), (3, "new")}


def test_windows_and_runs(spark):
    rng = random.Random(1)
    docs = {d: [rng.choice("abc") for _ in range(20)] for d in range(6)}
    rows = spark.createDataFrame([(d, i + 1, t) for d, ts in docs.items() for i, t in enumerate(ts)], "doc int, line_no int, text string")
    seen, want = {}, set()
    for d in sorted(docs):
        for i in range(18):
            w = tuple(docs[d][i : i + 3])
            if w in seen:
                want.add((d, i + 1, *seen[w]))
            seen.setdefault(w, (d, i + 1))
    got = {tuple(r) for r in sequences.copies_of_first(sequences.line_windows(rows, 3, "doc"), "doc").collect()}
    assert got == want
    only = rows.where("text = 'a'")
    lengths = sorted(len(m[0]) for ts in docs.values() for m in re.finditer("a+", "".join(ts)))
    assert sorted(r["length"] for r in sequences.runs(only, ["doc"], "line_no").collect()) == lengths


def test_strong_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)]
    reach = {(a, b) for a, b in edges}
    for k in range(30):
        for i in range(30):
            for j in range(30):
                if (i, k) in reach and (k, j) in reach:
                    reach.add((i, j))
    want = {(i, min(j for j in range(30) if j == i or ((i, j) in reach and (j, i) in reach))) for i in range(30) if any(i != j and (i, j) in reach and (j, i) in reach for j in range(30))}
    got = {tuple(r) for r in graph.components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == want
    assert graph.components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_canonical_order_has_every_row_at_its_position(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.randrange(20), f"t{i % 3}", f"2024-01-{rng.randrange(1, 9):02}") for i in range(500)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, d string").selectExpr("event_id", "user_id", "event_type", "cast(d as timestamp) as ts")
    events.repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(catalog.QUERIES["canonical_order"](spark, str(tmp_path)).collect(), key=lambda r: r["position"])
    want = sorted(rows, key=lambda r: (r[1], r[3], r[0]))
    assert [r["position"] for r in got] == list(range(500))
    assert [(r["event_type"], r["user_id"], r["at"][:10]) for r in got] == [(t, u, d) for _, u, t, d in want]
    assert findings.with_positions(events.limit(0), "event_id").count() == 0


def test_imports_of_pages_have_targets(spark, tmp_path):
    link = lambda *hs: "".join(f'<a href="{h}">' for h in hs)
    pages = [(0, "http://b/x/one.html", link("/two", "/one", "/none", "", "/two")), (1, "http://b/two", link("/x/one", "/shared")), (2, "http://a/shared", ""), (3, "http://c/shared", link("shared.htm", "/shared"))]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    edges = [("http://b/x/one.html", "http://b/two"), ("http://b/two", "http://b/x/one.html"), ("http://b/two", "http://a/shared"), ("http://c/shared", "http://a/shared")]
    assert sorted(tuple(r) for r in catalog.QUERIES["import_edges_by_suffix"](spark, str(tmp_path)).collect()) == sorted(edges)
    b, two, c = "http://b/x/one.html", "http://b/two", "http://c/shared"
    want = [(b, "/two", two), (b, "/one", b), (b, "/none", None), (two, "/x/one", b), (two, "/shared", "http://a/shared"), (c, "shared.htm", None), (c, "/shared", "http://a/shared")]
    got = [tuple(r) for r in catalog.QUERIES["import_targets"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(con.execute(catalog.ORACLES["import_targets"]).fetchall(), key=str) == sorted(want, key=str)
    assert sorted(con.execute(catalog.ORACLES["import_edges_by_suffix"]).fetchall()) == sorted(edges)


def test_api_diff_by_date_compares_every_name(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, i % 300, rng.choice("OF"), f"{rng.randrange(1996, 2000) if i % 5 else 1996}-06-01") for i in range(1200)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, d string").selectExpr("*", "cast(d as timestamp_ntz) as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    old, new = defaultdict(set), defaultdict(set)
    for _, c, status, d in rows:
        (old if d < catalog.SNAPSHOT else new)[c].add(status)
    want = {(c, "changed" if c in new else "removed") for c in old if c not in new or max(old[c]) != max(new[c])}
    got = [tuple(r) for r in catalog.QUERIES["api_diff_by_date"](spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want) and {"removed", "changed"} == {x for _, x in want} and max(want)[0] > 50


def _records_shuffled(spark, run) -> int:
    """The records that all stages of ``run`` write for other stages."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        empty = sc._jvm.java.util.ArrayList()
        found = sc._jsc.sc().statusStore().stageList(empty, False, False, sc._gateway.new_array(sc._jvm.double, 0), empty)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (found.apply(i) for i in range(found.size()))}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize("name", ["single_author", "stale"])
def test_commits_are_summed_up_before_they_meet_their_projects(spark, tmp_path, name):
    rng = random.Random(5)
    priority = lambda c: rng.choice((None, "1-URGENT", "2-HIGH", "3-MEDIUM")[: 1 + c % 4])
    rows = [(i, c := rng.randrange(60), rng.choice("OF"), f"{1996 + c % 3}-{rng.randrange(1, 13):02}-01", priority(c)) for i in range(20_000)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, d string, o_orderpriority string")
    orders.selectExpr("*", "cast(d as timestamp_ntz) as o_orderdate").drop("d").coalesce(2).write.parquet(f"{tmp_path}/orders.parquet")
    got = []
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for projects that are too many to be sent
    try:
        moved = _records_shuffled(spark, lambda: got.extend(catalog.QUERIES[name](spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = con.execute(catalog.ORACLES[name]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len({r[1] for r in want}) == 2
    assert moved < len(rows) / 4


def test_strong_components_of_all_line_items(spark, tmp_path):
    rng = random.Random(11)
    edges = [(rng.randrange(100), rng.randrange(100)) for _ in range(110)] + [(200, 201), (201, 200), (300, 301), (301, 302), (302, 300)]
    spark.createDataFrame(edges, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = {a: {b for x, b in edges if x == a} for a in range(400)}
    reach = {}
    for a in out:
        seen, todo = set(), [a]
        while todo:
            new = out[todo.pop()] - seen
            seen |= new
            todo += new
        reach[a] = seen
    groups = {a: {a} | {b for b in reach[a] if a in reach[b]} for a in out}
    want = {(a, min(g)) for a, g in groups.items() if len(g) > 1}
    got = [tuple(r) for r in catalog.QUERIES["scc_all"](spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want) and len({c for _, c in want}) >= 3


def test_typosquats_take_the_first_of_the_list(spark):
    names = spark.createDataFrame([("reqeusts",), ("requests",), ("numpi",), ("zzz",), (None,)], "name string")
    got = {tuple(r) for r in similarity.typosquats(names, ["requests", "numpy", "numba"]).collect()}
    assert got == {("reqeusts", "requests", 1), ("numpi", "numpy", 1)}


def test_versions(spark):
    df = spark.createDataFrame([("v1.2.3",), ("2",), ("1.x.4-rc",), ("",)], "v string")
    assert [tuple(r["x"]) for r in df.select(version(F.col("v")).alias("x")).collect()] == [(1, 2, 3), (2, 0, 0), (1, 0, 4), (0, 0, 0)]
