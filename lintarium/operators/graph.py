"""Import edges by suffix keys, and strongly connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintarium.sources.tables import forget, written


def targets_by_suffix(imports: DataFrame, files: DataFrame, *scope: str) -> DataFrame:
    """(scope, src, module, dst) of each distinct import (scope, path, module) over files (scope, path).

    A module names the file whose path ends with it. A file offers a key for each ending of its path without extension;
    of files that offer the same key the first path owns it. A module that begins with ./ or ../ stands for its last
    part without .ts, .tsx, .js or .mjs. Keys are looked up inside the ``scope`` columns, such as the project, only. One
    equi join; dst is null where no file has the key.
    """
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace("path", r"\.[^./]+$", ""), r"/(__init__|index|mod)$", ""), "/"), lambda p: p != "")
    keys = files.select(*scope, "path", parts.alias("_p")).select(*scope, "path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_p"), F.lit(1))), lambda i: F.array_join(F.slice("_p", i, F.size("_p")), "/"))).alias("_key"))
    owners = keys.where("_key <> ''").groupBy(*scope, "_key").agg(F.min("path").alias("dst"))
    beside = F.regexp_replace(F.regexp_extract("module", r"([^/]*)$", 1), r"\.(ts|tsx|js|mjs)$", "")
    named = F.regexp_replace(F.regexp_replace("module", r"^(crate::|[./]+)", ""), r"::|\.", "/")
    key = F.when(F.col("module").rlike(r"^\.\.?/"), beside).otherwise(named)
    wanted = imports.select(*scope, F.col("path").alias("src"), "module", key.alias("_key")).distinct()
    return wanted.join(owners, [*scope, "_key"], "left").select(*scope, "src", "module", "dst")


def edges_by_suffix(imports: DataFrame, files: DataFrame, *scope: str) -> DataFrame:
    """(scope, src, dst) from imports and files, by ``targets_by_suffix``; a file doesn't import itself."""
    return targets_by_suffix(imports, files, *scope).where("src <> dst").select(*scope, "src", "dst").distinct()


def _spread(values: DataFrame, edges: DataFrame) -> DataFrame:
    """The least value that reaches each node along edges (u, v), in rounds until nothing changes. values: (node, value)."""
    while True:
        sent = edges.join(values, F.col("u") == F.col("node")).select(F.col("v").alias("node"), "value")
        new = written(values.unionByName(sent).groupBy("node").agg(F.min("value").alias("value")), "spread")
        changed = not new.join(values.withColumnRenamed("value", "old"), "node").where("value <> old").limit(1).isEmpty()
        forget(values)
        values = new
        if not changed:
            return values


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on a cycle: strongly connected components of more than one node.

    Takes edges (src, dst). Nodes without an edge in or out are cut off; then colours spread forward (the least node
    that reaches a node) and a mark spreads backward from each colour's node inside the colour. What is marked is a
    component and leaves; the rest goes on. The component's name is its least node. Every round is written.
    """
    left = written(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u <> v").distinct(), "scc")
    found: DataFrame | None = None
    while True:
        while True:
            cut = left.join(left.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(left.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v")
            cut = written(cut, "scc")
            before, after = left.count(), cut.count()
            forget(left)
            left = cut
            if before == after:
                break
        if left.isEmpty():
            break
        nodes = left.select(F.col("u").alias("node")).union(left.select("v")).distinct()
        colour_table = _spread(nodes.withColumn("value", F.col("node")), left)
        colour = colour_table.withColumnRenamed("value", "colour")
        cu, cv = colour.toDF("u", "cu"), colour.toDF("v", "cv")
        inside = written(left.join(cu, "u").join(cv, "v").where("cu = cv").select(F.col("v").alias("u"), F.col("u").alias("v")), "scc-inside")
        marks = colour.select("node", F.when(F.col("node") == F.col("colour"), 0).otherwise(1).alias("value"))
        back_table = _spread(marks, inside)
        back = back_table.where("value = 0").select("node")
        group = written(colour.join(back, "node", "left_semi").select("node", F.col("colour").alias("component")), "scc-found")
        found = group if found is None else found.unionByName(group)
        gone, whole = group.select(F.col("node").alias("g")), left
        left = written(left.join(gone, F.col("u") == F.col("g"), "left_anti").join(gone, F.col("v") == F.col("g"), "left_anti"), "scc")
        forget(whole, inside, colour_table, back_table)
    if found is None:
        kind = edges.schema["src"].dataType
        return edges.sparkSession.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")
    size = found.groupBy("component").count().where("count > 1").select("component")
    return found.join(size, "component", "left_semi").select("node", "component")
