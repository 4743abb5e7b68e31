"""Connected components of an edge table by alternating stars, all on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintarium.llm.common import forget, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v): u's neighbours are hung on the least of them and u.

    The minimum is a partial aggregate. It is written out, so that both sides of the join back are dealt anew and
    a node with very many neighbours can be split at run time.
    """
    both = edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a <> b")
    if large:
        both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("m")), "star")
    joined = both.join(least, F.col("a") == F.col("x"))
    if large:
        out = joined.where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("b").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
    stars = written(out.where("u <> v").distinct(), "edges")
    forget(least)
    return stars


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the least node of its component.

    Takes (u, v) of any order, with repeats and loops. Large and small stars take turns until every node hangs on
    one root that hangs on nothing, which takes about the logarithm of the longest path. Rounds are written to the
    shared folder. A table without edges gives an empty result.
    """
    now = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    while True:
        wide = _star(now, True)
        narrow = _star(wide, False)
        forget(now, wide)
        now = narrow
        loose = now.join(now.select(F.col("u").alias("w")).distinct(), F.col("v") == F.col("w"), "left_semi").limit(1).count()
        if not loose and not now.groupBy("u").count().where("count > 1").limit(1).count():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
