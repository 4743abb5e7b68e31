"""Names close to popular names, and versions that advisories name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintarium.functions.text import osa_distance
from lintarium.sources.tables import ship


def typosquats(names: DataFrame, popular: list[str], column: str = "name", most: int = 2) -> DataFrame:
    """(column, similar, distance): of the popular names within 1 to ``most`` edits the first in the list's order.

    Case is ignored, and hyphens are underscores. The list is part of the configuration and goes along as an array;
    lengths and the built-in distance, which is at most twice the alignment distance, thin out the pairs before Python
    sees them. A popular name may itself be near to another.
    """
    ship(names.sparkSession)
    plain = F.regexp_replace(F.lower(column), "-", "_")
    n = names.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_plain", plain)
    listed = F.array(*[F.struct(F.lit(p).alias("similar"), F.lit(p.lower().replace("-", "_")).alias("p")) for p in popular])
    pairs = n.select(column, "_plain", F.posexplode(listed).alias("_ord", "_top")).select(column, "_plain", "_ord", "_top.similar", "_top.p")
    pairs = pairs.where((F.abs(F.length("_plain") - F.length("p")) <= most) & (F.levenshtein(F.col("_plain"), F.col("p")) <= 2 * most))
    near = pairs.withColumn("distance", osa_distance("_plain", "p")).where(F.col("distance").between(1, most))
    return near.groupBy(column).agg(F.min(F.struct("_ord", "similar", "distance")).alias("m")).select(column, "m.similar", "m.distance")


def advised(deps: DataFrame, advisories: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """Dependencies joined with every advisory on their name, whatever its case, whose version prefix theirs begins with."""
    a = advisories.select(F.lower("package").alias("_name"), F.col("prefix").alias("_prefix"), "advisory")
    return deps.join(a, (F.lower(deps[name]) == a["_name"]) & F.startswith(deps[version], a["_prefix"])).drop("_name", "_prefix")
