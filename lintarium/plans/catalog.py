"""Named queries over the driver's tables, with the SQL that must give the same rows.

The tables hold no source code, so columns play the parts of facts and findings: an event is a finding with its type as
severity, a line item is a finding of a part (rule) in a supplier (file), documents are sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintarium.functions.severity import grade, lookup
from lintarium.functions.text import lines, plain_lines, query_pairs
from lintarium.operators import findings as ops
from lintarium.operators import graph, sequences, similarity
from lintarium.plans import analytics, cases, rules
from lintarium.sources import history
from lintarium.sources.facts import FACTS, parse
from lintarium.sources.tree import FILES
from lintarium.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Weights of event types, in the part of severities.
WEIGHTS = {"error": 30, "purchase": 12, "signup": 4, "click": 1, "view": 0}
TYPES = ("click", "error", "purchase", "signup", "view")
_W = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " ELSE 0 END"
#: The two days that are compared as scans.
DAY_1, DAY_2 = "2024-01-14", "2024-01-15"
SPACE = r"[^\x20\x09-\x0D]+"
#: The date that parts the orders into two snapshots.
SNAPSHOT = "1998-01-01"


def _weight():
    return lookup(F.col("event_type"), WEIGHTS, 0)


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


# --- analytics ---------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def severity_counts(spark, sf):
    return analytics.counts(table(spark, sf, "events"), "event_type")


@query(
    f"""WITH s AS (SELECT event_type AS dimension, CAST(sum({_W}) AS FLOAT) AS w FROM events GROUP BY 1),
    d AS (SELECT unnest(['click', 'error', 'purchase', 'refund', 'signup', 'view']) AS dimension UNION SELECT dimension FROM s),
    k AS (SELECT CAST(count(*) / 10.0 AS FLOAT) AS kloc FROM events),
    p AS (SELECT d.dimension, CAST(100 AS FLOAT) - least(greatest(CAST(coalesce(w, 0) / greatest(kloc, 1) AS FLOAT), 0), 100) AS s FROM d CROSS JOIN k LEFT JOIN s USING (dimension))
    SELECT dimension, round(CAST(s AS DOUBLE), 3) AS score, CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' ELSE 'F' END AS grade FROM p"""
)
def dimension_scores(spark, sf):
    events = table(spark, sf, "events")
    out = analytics.scores(events, _weight(), events.count() / 10.0, "event_type", (*TYPES, "refund"))
    return out.withColumn("score", F.round(F.col("score").cast("double"), 3))


@query(
    """WITH p AS (SELECT l_partkey, l_returnflag, count(*) AS c FROM lineitem GROUP BY 1, 2),
    b AS (SELECT l_partkey, CAST(sum(c) AS BIGINT) AS n, min_by(l_returnflag, (-c, l_returnflag)) AS l_returnflag FROM p GROUP BY 1)
    SELECT * FROM b ORDER BY n DESC, l_partkey LIMIT 10"""
)
def top_rules_mode(spark, sf):
    return analytics.top_rules(table(spark, sf, "lineitem"), "l_partkey", "l_returnflag")


@query("SELECT l_suppkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS weight FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 10")
def top_files(spark, sf):
    return analytics.top_files(table(spark, sf, "lineitem"), "l_suppkey", F.col("l_linenumber"))


@query("SELECT unnest(string_split(p_type, ' ')) AS tag, count(*) AS n FROM part GROUP BY 1")
def taxonomy_counts(spark, sf):
    return analytics.tag_counts(table(spark, sf, "part").withColumn("tags", F.split("p_type", " ")), "tags")


@query(
    f"""WITH s AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum({_W}) AS w FROM events GROUP BY 1, 2)
    SELECT user_id, CAST(sum(n) AS BIGINT) AS findings, CAST(sum(w) AS BIGINT) AS weight, max(n) AS peak, max(day) AS last_scan
    FROM s GROUP BY 1 ORDER BY weight DESC, user_id LIMIT 25"""
)
def heatmap(spark, sf):
    return analytics.heatmap(_day(table(spark, sf, "events")), "day", "user_id", _weight())


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in TYPES) + ", count(*) AS total FROM events GROUP BY 1")
def trends(spark, sf):
    return analytics.trends(_day(table(spark, sf, "events")), "day", "event_type", TYPES)


@query(
    f"""SELECT event_type, count(*) FILTER (strftime(ts, '%Y-%m-%d') = '{DAY_1}') AS old, count(*) FILTER (strftime(ts, '%Y-%m-%d') = '{DAY_2}') AS new,
    count(*) FILTER (strftime(ts, '%Y-%m-%d') = '{DAY_2}') - count(*) FILTER (strftime(ts, '%Y-%m-%d') = '{DAY_1}') AS delta
    FROM events WHERE strftime(ts, '%Y-%m-%d') IN ('{DAY_1}', '{DAY_2}') GROUP BY 1"""
)
def summary_delta(spark, sf):
    return analytics.delta(table(spark, sf, "events"), F.date_format("ts", "yyyy-MM-dd"), "event_type", DAY_1, DAY_2)


@query("WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n, n - lag(n) OVER (ORDER BY day) AS n_delta FROM d QUALIFY n_delta IS NOT NULL")
def previous_scan(spark, sf):
    days = analytics.counts(_day(table(spark, sf, "events")), "day")
    # The first scan has none before it.
    return sequences.change(days.withColumn("project", F.lit(0)), ["project"], "day", ["n"]).drop("project").where("n_delta is not null")


@query("SELECT l_returnflag, max(l_linenumber) AS worst, count(*) AS n FROM lineitem GROUP BY 1")
def severity_max(spark, sf):
    return analytics.worst(table(spark, sf, "lineitem"), "l_returnflag", F.col("l_linenumber"))


@query("SELECT event_type, count(*) AS tests, count(*) FILTER (value > 50) AS failures, count(*) FILTER (value IS NULL) AS errors FROM events GROUP BY ROLLUP (event_type)")
def junit_rollup(spark, sf):
    return analytics.suites(table(spark, sf, "events"), "event_type", F.col("value") > 50, F.col("value").isNull())


# --- findings ----------------------------------------------------------------------------------------------------


def _two_days(spark, sf):
    events = _day(table(spark, sf, "events"))
    return events.where(F.col("day") == DAY_1), events.where(F.col("day") == DAY_2)


@query(
    f"""WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE strftime(ts, '%Y-%m-%d') = '{DAY_1}'),
    b AS (SELECT DISTINCT user_id, event_type FROM events WHERE strftime(ts, '%Y-%m-%d') = '{DAY_2}')
    SELECT user_id, event_type, 'new' AS status FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL
    SELECT user_id, event_type, 'resolved' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL
    SELECT user_id, event_type, 'persisting' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)"""
)
def scan_diff(spark, sf):
    old, new = _two_days(spark, sf)
    return ops.diff(old, new, ["user_id", "event_type"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def baseline_filter(spark, sf):
    known = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return ops.without(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), known, ["l_orderkey"])


@query(
    """WITH s AS (SELECT o_orderkey AS k, 1 + o_orderkey % 4 AS line, o_orderpriority = '1-URGENT' AS whole FROM orders WHERE o_orderstatus = 'O')
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (
    SELECT 1 FROM s WHERE k = l_orderkey AND (whole OR line = l_linenumber OR line = l_linenumber - 1))"""
)
def suppression(spark, sf):
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), F.lit("R1").alias("rule_id"), "l_partkey")
    marks = table(spark, sf, "orders").where("o_orderstatus = 'O'")
    marks = marks.select(F.col("o_orderkey").alias("path"), (F.col("o_orderkey") % 4 + 1).alias("line"), F.lit("R1").alias("rule_id"), (F.col("o_orderpriority") == "1-URGENT").alias("file_scoped"))
    return ops.suppress(items, marks).select(F.col("path").alias("l_orderkey"), F.col("line").alias("l_linenumber"), "l_partkey")


@query("SELECT p_partkey FROM part WHERE len(list_filter(string_split(upper(p_type), ' '), lambda x: x IN ('ECONOMY', 'SMALL'))) > 0 AND upper(p_brand) IN ('BRAND#11', 'BRAND#12', 'BRAND#13')")
def taxonomy_filter(spark, sf):
    part = table(spark, sf, "part").withColumns({"owasp": F.split("p_type", " "), "cwe": F.array("p_brand")})
    return ops.taxonomy(part, ["economy", "small"], ["Brand#11", "Brand#12", "brand#13"]).select("p_partkey")


@query(
    """SELECT * FROM (SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' AND p_type LIKE '%ARD' THEN 'critical' WHEN p_brand = 'Brand#11' AND p_type LIKE 'PROMO%' THEN 'ignore'
    WHEN p_brand = 'Brand#12' THEN 'low' ELSE 'medium' END AS severity FROM part) WHERE severity <> 'ignore'"""
)
def glob_override(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", F.lit("medium").alias("severity"))
    out = ops.override(part, [("Brand#11", "*ARD", "critical"), ("Brand#11", "PROMO*", "ignore")], {"Brand#12": "low"}, path="p_type", rule="p_brand")
    return out.select("p_partkey", "severity")


@query("SELECT event_type, severity, lv >= 3 AS fails FROM (SELECT event_type, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' ELSE 'low' END AS severity, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 ELSE 1 END AS lv FROM events GROUP BY ALL)")
def fail_on(spark, sf):
    from lintarium.functions.severity import rank

    kinds = table(spark, sf, "events").select("event_type").distinct()
    s = kinds.withColumn("severity", lookup(F.col("event_type"), {"error": "critical", "purchase": "high"}, "low"))
    return s.withColumn("fails", rank(F.col("severity")) >= 3)




@query("SELECT event_type, user_id, CAST(ts AS VARCHAR) AS at, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS position FROM events")
def canonical_order(spark, sf):
    """Every row of the canonical order with its position."""
    events = ops.with_positions(table(spark, sf, "events").select("event_type", "user_id", "ts", "event_id"), "user_id", "ts", "event_id")
    return events.select("event_type", "user_id", F.regexp_replace(F.col("ts").cast("string"), r"(\.\d*?)0+$", "$1").alias("at"), "position")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")
def retention(spark, sf):
    return sequences.newest(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def latest_scan(spark, sf):
    return sequences.newest(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT c_custkey, label FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS label FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def label_join(spark, sf):
    """Customers as scans, orders as their labels, of which the latest counts."""
    scans = table(spark, sf, "customer").select(F.lit("p").alias("project"), F.col("c_custkey").alias("scan_id"))
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    labels = table(spark, sf, "orders").select(F.lit("p").alias("project"), F.col("o_custkey").alias("scan_id"), F.col("o_orderpriority").alias("label"), at.alias("at"))
    return history.labelled(scans, labels).select(F.col("scan_id").alias("c_custkey"), "label")


@query("SELECT event_type FROM events WHERE user_id % 2 = 0 UNION SELECT event_type FROM events WHERE user_id % 2 = 1")
def union_distinct(spark, sf):
    events = table(spark, sf, "events")
    return ops.union([events.where("user_id % 2 = 0").select("event_type"), events.where("user_id % 2 = 1").select("event_type")]).distinct()


# --- rules -------------------------------------------------------------------------------------------------------


def _facts(rows: DataFrame, kind: str, path, name=None, start=None, language: str = "python", project=None, **attrs) -> DataFrame:
    """Facts of one kind from the columns of a table."""
    at = F.lit(0) if start is None else start.cast("int")
    pairs = [x for k, v in attrs.items() for x in (F.lit(k), v.cast("string"))]
    return rows.select(
        (F.lit("p") if project is None else project.cast("string")).alias("project"), path.cast("string").alias("path"), F.lit(language).alias("language"), F.lit(kind).alias("kind"),
        (F.lit(None) if name is None else name).cast("string").alias("name"), at.alias("start"), at.alias("end"), F.lit(1).alias("line"), F.lit(1).alias("end_line"),
        (F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.lit(None)).cast("map<string,string>").alias("attrs"),
    )


def _files(rows: DataFrame, path, content, language: str = "python", project=None) -> DataFrame:
    text = content.cast("string")
    return rows.select((F.lit("p") if project is None else project.cast("string")).alias("project"), path.cast("string").alias("path"), F.lit(language).alias("language"), text.alias("content"), F.octet_length(text).cast("long").alias("n_bytes"))


def _judge(files: DataFrame | None, only: list[str], facts: DataFrame | None = None, **more) -> DataFrame:
    """What the rules themselves find in facts or files that were made from the driver's tables."""
    if facts is None:
        facts = files.sparkSession.createDataFrame([], FACTS)
    if files is None:
        files = facts.sparkSession.createDataFrame([], FILES)
    return rules.analyze(rules.Project(files, given=facts, **more), only)


@query("SELECT CAST(l_orderkey AS VARCHAR) AS path, 'file has ' || count(DISTINCT l_suppkey) || ' distinct imports' AS message FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 4")
def fan_out(spark, sf):
    """Orders as files, suppliers as what they import."""
    imports = _facts(table(spark, sf, "lineitem"), "import", F.col("l_orderkey"), F.col("l_suppkey"))
    return _judge(None, ["CPLX001-fan-out"], imports, thresholds={"CPLX001-fan-out": 4}).select("path", "message")


@query("SELECT CAST(o_custkey AS VARCHAR) AS path, min(o_orderkey) AS start, 'type T has ' || count(*) || ' methods' AS message FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def large_group(spark, sf):
    """Customers as files with one type, orders as its methods."""
    methods = _facts(table(spark, sf, "orders"), "function", F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderkey"), fn_kind=F.lit("Method"), parent=F.lit("T"))
    return _judge(None, ["MAINT008-large-impl-block"], methods, thresholds={"MAINT008-large-impl-block": 12}).select("path", "start", "message")


@query("""WITH f AS (SELECT l_suppkey AS dir, l_returnflag = 'R' AS test, l_suppkey || '/' || CASE l_returnflag WHEN 'R' THEN 'test_' ELSE '' END || l_orderkey || '_' || l_linenumber || '.py' AS path FROM lineitem),
    g AS (SELECT count(*) FILTER (test) AS t, count(*) FILTER (NOT test) AS s, min(path) FILTER (NOT test) AS path FROM f GROUP BY dir)
    SELECT path, 'folder has ' || t || ' test files for ' || s || ' sources' AS message FROM g WHERE s >= 3 AND t * 100 // s < 50""")
def dir_ratio(spark, sf):
    """Suppliers as folders, returned line items as test files."""
    name = F.concat(F.col("l_suppkey").cast("string"), F.lit("/"), F.when(F.col("l_returnflag") == "R", "test_").otherwise(""), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit(".py"))
    files = _files(table(spark, sf, "lineitem"), name, F.lit(""))
    return _judge(files, ["TEST001-test-ratio"], thresholds={"TEST001-test-ratio": 50}).select("path", "message")


def _orders_as_history(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as projects: (manifests, commits by priority, tags of finished orders)."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("project"), F.col("o_orderpriority").alias("author"), F.col("o_orderdate").cast("timestamp").alias("ts"), "o_orderkey", "o_orderstatus")
    files = _files(orders.select("project").distinct(), F.lit("Cargo.toml"), F.lit(""), "rust", F.col("project")).withColumn("language", F.lit(None).cast("string"))
    tags = orders.where("o_orderstatus = 'F'").select("project", F.lit("v1.0").alias("name"), "ts", F.lit(0).alias("ord"))
    return files, orders.select("project", "author", "ts"), tags


@query("""WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT o_custkey, max(n) AS top, sum(n) AS total, count(*) AS authors FROM c GROUP BY 1)
    SELECT CAST(o_custkey AS VARCHAR) AS project, 'HEALTH001-single-author' AS rule_id, 'most commits are by one author' AS message FROM s WHERE top * 100 > total * 50 UNION ALL
    SELECT CAST(o_custkey AS VARCHAR), 'HEALTH003-low-bus-factor', authors || ' authors' FROM s WHERE authors <= 2""")
def single_author(spark, sf):
    files, commits, _ = _orders_as_history(spark, sf)
    return _judge(files, ["HEALTH001-single-author", "HEALTH003-low-bus-factor"], commits=commits).select("project", "rule_id", "message")


@query("""WITH c AS (SELECT o_custkey, max(o_orderdate) AS last, max(o_orderdate) FILTER (o_orderstatus = 'F') AS tag FROM orders GROUP BY 1)
    SELECT CAST(o_custkey AS VARCHAR) AS project, 'HEALTH002-stale-release' AS rule_id FROM c WHERE date_diff('day', CAST(tag AS DATE), DATE '1998-12-01') > 365 UNION ALL
    SELECT CAST(o_custkey AS VARCHAR), 'HEALTH004-commit-stale' FROM c WHERE date_diff('day', CAST(last AS DATE), DATE '1998-12-01') > 180""")
def stale(spark, sf):
    files, commits, tags = _orders_as_history(spark, sf)
    return _judge(files, ["HEALTH002-stale-release", "HEALTH004-commit-stale"], commits=commits, tags=tags, now="1998-12-01").select("project", "rule_id")


_LINES = "SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL"


@query(
    f"""WITH l AS ({_LINES}), w AS (SELECT doc_id, line_no, text || chr(10) || lead(text, 1) OVER o || chr(10) || lead(text, 2) OVER o AS w, lead(text, 2) OVER o AS z FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
    r AS (SELECT doc_id, line_no, first_value(doc_id) OVER g AS first_doc_id, first_value(line_no) OVER g AS first_line_no, row_number() OVER g AS rn FROM w WHERE z IS NOT NULL WINDOW g AS (PARTITION BY w ORDER BY doc_id, line_no))
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, first_doc_id, CAST(first_line_no AS INTEGER) AS first_line_no FROM r WHERE rn > 1"""
)
def dup_windows(spark, sf):
    rows = plain_lines(table(spark, sf, "documents"), "text", "doc_id")
    return sequences.copies_of_first(sequences.line_windows(rows, 3, "doc_id"), "doc_id")


@query(
    f"""WITH l AS ({_LINES}), s AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM l WHERE length(text) < 120)
    SELECT doc_id, CAST(min(line_no) AS INTEGER) AS first, CAST(max(line_no) AS INTEGER) AS last, count(*) AS length FROM s GROUP BY doc_id, g HAVING count(*) >= 3"""
)
def comment_islands(spark, sf):
    rows = plain_lines(table(spark, sf, "documents"), "text", "doc_id").where(F.length("text") < 120)
    return sequences.runs(rows, ["doc_id"], "line_no", 3)


@query(
    f"""WITH l AS ({_LINES}), o AS (SELECT *, CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start FROM l)
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, byte_start FROM o WHERE regexp_matches(text, '(License|@|[0-9]{{4}})')"""
)
def line_rule(spark, sf):
    return lines(table(spark, sf, "documents"), "text", "doc_id").where(F.col("text").rlike("(License|@|[0-9]{4})")).select("doc_id", "line_no", "byte_start")


@query("SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND regexp_matches(text, '[A-Z]{3}')")
def literal_semi_rule(spark, sf):
    """Documents as files that hold a shell command where they have three capitals, and import a shell where they are labelled."""
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("text").rlike("[A-Z]{3}"), F.concat(F.lit("sh -c "), "text")).otherwise(F.col("text")).alias("text"))
    facts = ops.union([_facts(docs, "string", F.col("doc_id"), value=F.col("text")), _facts(table(spark, sf, "labels").where("toxic = 1"), "import", F.col("doc_id"), F.lit("subprocess"))])
    return _judge(None, ["SEC003-shell-injection"], facts).select("path")


@query("SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE n_chars > 4000 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def literal_anti_rule(spark, sf):
    """Documents as files with a handler where they are long, and with a guard where they are labelled."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    facts = ops.union([_facts(docs, "function", F.col("doc_id"), F.lit("f"), region=F.when(F.col("n_chars") > 4000, "app.post(")), _facts(docs, "import", F.col("doc_id"), F.lit("flask"))])
    return _judge(_files(labels, F.col("doc_id"), F.lit("csrf_token")), ["SEC008-csrf-missing"], facts).select("path")


@query("SELECT CAST(d.doc_id AS VARCHAR) AS path, 'public item without documentation: ' || source AS message FROM documents d WHERE n_chars > 1000 AND source IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def doc_join_rule(spark, sf):
    """Documents as items that are public where they are long and documented where a label says so."""
    said = table(spark, sf, "labels").where("quality = 1").select("doc_id", F.lit("Says so.").alias("doc")).distinct()
    items = table(spark, sf, "documents").join(said, "doc_id", "left")
    facts = _facts(items, "function", F.col("doc_id"), F.col("source"), visibility=F.when(F.col("n_chars") > 1000, "Public").otherwise("Private"), doc=F.col("doc"))
    return _judge(None, ["DOC001-public-api-undoc"], facts).select("path", "message")




@query("""WITH b AS (SELECT conv_id || '/' || turn AS path, replace(replace(text, 'the', 'Math.random'), 'que', 'setTimeout') AS body FROM conversations)
    SELECT path, 'test depends on time or chance: ' || t AS message FROM b, (SELECT unnest(['Math.random', 'setTimeout', 'sleep']) AS t) WHERE contains(body, t)""")
def token_bodies(spark, sf):
    """Turns as tests, with two of their syllables as the tokens that are looked for."""
    path = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    body = F.replace(F.replace(F.col("text"), F.lit("the"), F.lit("Math.random")), F.lit("que"), F.lit("setTimeout"))
    return _judge(None, ["TEST004-flaky-time"], _facts(table(spark, sf, "conversations"), "function", path, F.lit("t"), is_test=F.lit("True"), body=body)).select("path", "message")


@query(f"""SELECT CAST(page_id AS VARCHAR) AS path, 'test has ' || len(regexp_extract_all(replace(html, '<', ' panic!'), '{rules.ASSERTS}')) || ' assertions' AS message
    FROM pages WHERE len(regexp_extract_all(replace(html, '<', ' panic!'), '{rules.ASSERTS}')) > 40""")
def regex_count_rule(spark, sf):
    """Pages as tests, their tags as assertions."""
    facts = _facts(table(spark, sf, "pages"), "function", F.col("page_id"), F.lit("t"), is_test=F.lit("True"), body=F.replace(F.col("html"), F.lit("<"), F.lit(" panic!")))
    return _judge(None, ["TEST005-assert-count"], facts, thresholds={"TEST005-assert-count": 40}).select("path", "message")


@query("SELECT CAST(conv_id AS VARCHAR) AS project FROM conversations GROUP BY conv_id HAVING bool_or(role = 'user') AND NOT bool_or(length(text) > 400)")
def any_all_rule(spark, sf):
    """Conversations as projects, turns as dependencies: users are bound to a runtime, long turns to none."""
    turns = table(spark, sf, "conversations")
    name = lambda role, long: F.when(long, "futures").when(role == "user", "tokio").otherwise("serde")
    both = F.array(name(F.col("role"), F.lit(False)), name(F.lit(""), F.length("text") > 400))
    deps = turns.select(F.col("conv_id").cast("string").alias("project"), F.lit("Cargo.toml").alias("path"), F.lit("cargo").alias("kind"), F.lit("dependencies").alias("section"), F.explode(both).alias("name"), F.lit("1").alias("spec"), F.lit(None).cast("map<string,string>").alias("attrs"))
    project = rules.Project(spark.createDataFrame([], FILES), given=spark.createDataFrame([], FACTS))
    project.dependencies = deps
    return rules.analyze(project, ["ECO002-async-runtime-coupling"]).select("project")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nxt FROM conversations) WHERE role = 'user' AND nxt IS DISTINCT FROM 'assistant'")
def dead_store_next(spark, sf):
    c = table(spark, sf, "conversations").withColumn("_at", F.struct("turn", "role", "text"))
    return sequences.not_followed_by(c, ["conv_id"], "_at", F.col("role") == "user", F.col("role") == "assistant").select("conv_id", "turn")


@query(
    """WITH a(package, prefix, advisory) AS (VALUES ('BRAND#11', 'ECONOMY', 'A-1'), ('brand#11', 'ECONOMY ANODIZED', 'A-2'), ('Brand#22', 'PROMO', 'A-3'))
    SELECT p_partkey, advisory FROM part JOIN a ON lower(p_brand) = lower(package) AND starts_with(p_type, prefix)"""
)
def advisory_theta(spark, sf):
    known = spark.createDataFrame([("BRAND#11", "ECONOMY", "A-1"), ("brand#11", "ECONOMY ANODIZED", "A-2"), ("Brand#22", "PROMO", "A-3")], "package string, prefix string, advisory string")
    return similarity.advised(table(spark, sf, "part"), known, "p_brand", "p_type").select("p_partkey", "advisory")




@query(
    f"""WITH h AS (SELECT o_custkey AS name, max(o_orderstatus) AS kind FROM orders WHERE o_orderdate < TIMESTAMP '{SNAPSHOT}' GROUP BY 1),
    n AS (SELECT o_custkey AS name, max(o_orderstatus) AS kind FROM orders WHERE o_orderdate >= TIMESTAMP '{SNAPSHOT}' GROUP BY 1)
    SELECT h.name, CASE WHEN n.name IS NULL THEN 'removed' ELSE 'changed' END AS status FROM h LEFT JOIN n USING (name) WHERE n.name IS NULL OR h.kind <> n.kind"""
)
def api_diff_by_date(spark, sf):
    """Customers as public functions, orders before and from a date as the two versions, and the status as the arity."""
    o = table(spark, sf, "orders").groupBy("o_custkey", (F.col("o_orderdate") < F.lit(SNAPSHOT).cast("timestamp_ntz")).alias("old")).agg(F.max("o_orderstatus").alias("status"))
    facts = lambda rows: _facts(rows, "function", F.col("o_custkey"), F.col("o_custkey"), visibility=F.lit("Public"), top=F.lit("True"), params=F.ascii("status"))
    found = _judge(None, ["API001-public-symbol-removed", "API002-signature-arity-changed"], facts(o.where("not old")), baseline=facts(o.where("old")))
    return found.select(F.col("path").cast("long").alias("name"), lookup(F.col("rule_id"), {"API001-public-symbol-removed": "removed"}, "changed").alias("status"))


@query("SELECT CAST(d.doc_id AS VARCHAR) AS path, c.h IS NOT NULL AS hit FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(text, '') END) AS h FROM documents WHERE doc_id % 5 <> 0) c ON d.doc_id = c.doc_id AND d.h = c.h")
def cache_hits(spark, sf):
    """Documents as files; the cache lacks some of them and knows older contents of others."""
    docs = table(spark, sf, "documents")
    known = _files(docs.where("doc_id % 5 <> 0"), F.col("doc_id"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text")))
    missing, held = history.split_by_cache(_files(docs, F.col("doc_id"), F.col("text")), history.hashes(known).withColumn("config_hash", F.lit("c")), "c")
    return missing.select("path", F.lit(False).alias("hit")).unionByName(held.select("path", F.lit(True).alias("hit")).distinct())




_IMPORTS = r"""i AS (SELECT DISTINCT url AS src, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS module FROM pages),
    p AS (SELECT url, list_filter(string_split(regexp_replace(regexp_replace(url, '\.[^./]+$', ''), '/(__init__|index|mod)$', ''), '/'), lambda x: x <> '') AS p FROM pages),
    k AS (SELECT url, array_to_string(list_slice(p, n, len(p)), '/') AS k FROM (SELECT url, p, unnest(range(1, len(p) + 1)) AS n FROM p)),
    o AS (SELECT k, min(url) AS dst FROM k GROUP BY 1),
    m AS (SELECT src, module, CASE WHEN regexp_matches(module, '^\.\.?/') THEN regexp_replace(regexp_extract(module, '[^/]*$'), '\.(ts|tsx|js|mjs)$', '')
        ELSE regexp_replace(regexp_replace(module, '^(crate::|[./]+)', ''), '::|\.', '/', 'g') END AS key FROM i),
    t AS (SELECT src, module, dst FROM m LEFT JOIN o ON k = key)"""


def _imports(spark, sf):
    pages = table(spark, sf, "pages")
    hrefs = pages.select(F.col("url").alias("path"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("module"))
    return hrefs, pages.select(F.col("url").alias("path"))


@query(
    """WITH f AS (SELECT s_nationkey AS project, s_suppkey, 's/' || s_suppkey || '.py' AS path FROM supplier)
    SELECT DISTINCT CAST(a.project AS VARCHAR) AS project, a.path AS src, b.path AS dst FROM lineitem JOIN f a ON l_suppkey = a.s_suppkey JOIN f b ON l_partkey = b.s_suppkey AND a.project = b.project WHERE l_suppkey <> l_partkey"""
)
def import_edges(spark, sf):
    """Nations as projects, suppliers as files, and line items as imports that name a file by the number of their part."""
    files = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("project"), "s_suppkey", F.concat(F.lit("s/"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("path"))
    imports = table(spark, sf, "lineitem").join(files, F.col("l_suppkey") == F.col("s_suppkey")).select("project", "path", F.col("l_partkey").cast("string").alias("module"))
    return graph.edges_by_suffix(imports, files.select("project", "path"), "project")


@query(f"WITH {_IMPORTS} SELECT DISTINCT src, dst FROM t WHERE src <> dst")
def import_edges_by_suffix(spark, sf):
    return graph.edges_by_suffix(*_imports(spark, sf))


@query(f"WITH {_IMPORTS} SELECT * FROM t")
def import_targets(spark, sf):
    """Every distinct import with the page that owns its key, unresolved ones included."""
    return graph.targets_by_suffix(*_imports(spark, sf))




@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS u, l_partkey AS v FROM lineitem WHERE l_suppkey <> l_partkey AND l_partkey IN (SELECT l_suppkey FROM lineitem)),
    r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
    m AS (SELECT a.u AS node, least(a.u, min(a.v)) AS component FROM r a JOIN r b ON a.u = b.v AND a.v = b.u WHERE a.u <> a.v GROUP BY a.u)
    SELECT node, component FROM m"""
)
def scc_all(spark, sf):
    """Components over all edges from supplier to part. The SQL's closure leaves out nodes without an edge out: they are on no cycle."""
    return graph.components(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


@query("SELECT p_partkey, near_name, distance FROM (SELECT p_partkey, s AS near_name, CAST(levenshtein(p_brand, s) AS INTEGER) AS distance, row_number() OVER (PARTITION BY p_partkey ORDER BY o) AS rn FROM part, (VALUES (1, 'Brand#9'), (2, 'Brand#1'), (3, 'Brind#55')) t(o, s) WHERE levenshtein(p_brand, s) BETWEEN 1 AND 2) WHERE rn = 1")
def typosquat(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("name"))
    return part.join(similarity.typosquats(part, ["Brand#9", "Brand#1", "Brind#55"]), "name").select("p_partkey", F.col("similar").alias("near_name"), "distance")


@query("SELECT p_partkey, p_size > 30 AS over, CASE WHEN p_size >= 45 THEN 'A' WHEN p_size >= 40 THEN 'B' WHEN p_size >= 35 THEN 'C' WHEN p_size >= 30 THEN 'D' ELSE 'F' END AS grade FROM part WHERE p_size > 10")
def threshold_rule(spark, sf):
    part = table(spark, sf, "part").where("p_size > 10")
    return part.select("p_partkey", (F.col("p_size") > 30).alias("over"), grade(F.col("p_size") * 2).alias("grade"))


@query("""WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || '?id=' || page_id || '&q=a%20b+' || page_id % 7 || '&flag#top' AS u FROM pages)
    SELECT page_id, unnest(['id', 'q', 'flag']) AS name, unnest([CAST(page_id AS VARCHAR), 'a b ' || page_id % 7, '']) AS value FROM u""")
def query_string(spark, sf):
    page = F.col("page_id").cast("string")
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("?id="), page, F.lit("&q=a%20b+"), (F.col("page_id") % 7).cast("string"), F.lit("&flag#top"))
    return table(spark, sf, "pages").select("page_id", F.inline(query_pairs(url)))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') IS NOT NULL AS there FROM events")
def json_pointer(spark, sf):
    docs = table(spark, sf, "events").withColumn("doc", F.col("props"))
    return docs.select("event_id", rules.get("$.k").cast("int").alias("k"), rules.has("$.missing").alias("there"))


@query("""WITH f AS (SELECT source, CAST(doc_id AS VARCHAR) AS path, len(regexp_extract_all(coalesce(text, ''), 'on')) AS n FROM documents)
    SELECT source AS project, min_by(path, (-n, path)) AS path, max(n) || ' uses of Arc<Mutex>' AS message FROM f GROUP BY 1 HAVING max(n) > 5""")
def arg_max_file(spark, sf):
    """Sources as projects, documents as files, and a syllable as what is counted."""
    files = _files(table(spark, sf, "documents"), F.col("doc_id"), F.replace(F.col("text"), F.lit("on"), F.lit(" Arc<Mutex ")), "rust", F.col("source"))
    return _judge(files, ["PERF003-arc-mutex-density"]).select("project", "path", "message")


@query("SELECT event_type, user_id, min(ts) AS started, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY event_type, user_id, g")
def debounce(spark, sf):
    bursts = watch.bursts(table(spark, sf, "events"), "ts", "1 hour", keys=["event_type", "user_id"])
    return bursts.select("event_type", "user_id", F.col("start").alias("started"), "n")


# --- rules over small projects -----------------------------------------------------------------------------------------


def _family(name: str, family: cases.Family) -> None:
    def run(spark, sf):
        return cases.found(spark, family)

    run.__name__ = name
    query(cases.sql(family))(run)


for _name, _one in cases.FAMILIES.items():
    _family(_name, _one)

_PARSED = {"a.py": 'import os\nfrom a.b import c\n\n\nclass T:\n    def m(self, x):\n        return "s"  # note\n\n\ndef f(a, b=1):\n    return os\n', "b.py": "def (:\n", "c.rs": "use std::fs;\npub fn g(a: u8) {}\npub struct S { a: u8 }\n", "d.js": "import x from './x';\nexport function h(a) {}\n", "e.txt": "def f(): pass\n"}


@query(
    """SELECT * FROM (VALUES ('a.py', 'import', 'os', 1), ('a.py', 'import', 'a.b', 2), ('a.py', 'type', 'T', 5), ('a.py', 'function', 'm', 6), ('a.py', 'function', 'f', 10), ('b.py', 'parse_error', 'SyntaxError', 1),
    ('c.rs', 'import', 'std::fs', 1), ('c.rs', 'function', 'g', 2), ('c.rs', 'type', 'S', 3), ('d.js', 'import', './x', 1), ('d.js', 'function', 'h', 2)) AS t(path, kind, name, line)"""
)
def parse_python(spark, sf):
    """Imports, types, functions and errors of small files of each language."""
    facts = parse(cases.files(spark, {"p": _PARSED}))
    return facts.where(F.col("kind").isin("import", "type", "function", "parse_error")).select("path", "kind", "name", "line")
