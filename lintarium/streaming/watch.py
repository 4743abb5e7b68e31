"""Watching sources with Structured Streaming: a batch of changed files is analysed, what is unchanged is not parsed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lintarium.functions.severity import lookup
from lintarium.sources import history
from lintarium.sources.facts import FACTS, parse
from lintarium.sources.tables import delete, exists, rename, written
from lintarium.sources.tree import LANGUAGES

CACHE = f"{FACTS}, content_hash string, config_hash string"


def changes(spark: SparkSession, root: str, project: str = "project") -> DataFrame:
    """A stream of files under a folder as they come, in the columns of a scan."""
    raw = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(root)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    language = lookup(F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)), LANGUAGES)
    return raw.select(F.lit(project).alias("project"), "path", language.alias("language"), text.alias("content"), F.col("length").alias("n_bytes"))


def cached_facts(files: DataFrame, cache: str, config: str) -> tuple[DataFrame, int]:
    """Facts of the files, and how many files the cache knew; files that it lacks are parsed and added to it.

    Entries hold for a content and a configuration. When most of the cache is of contents that are gone it is written
    anew without them.
    """
    spark, files = files.sparkSession, files.where(F.col("language").isNotNull())
    known = spark.read.schema(CACHE).parquet(cache) if exists(spark, cache) else spark.createDataFrame([], CACHE)
    missing, held = history.split_by_cache(files, known, config)
    hits = held.select("project", "path").distinct().count()
    hashes = history.hashes(missing)
    keyed = parse(missing).join(hashes, ["project", "path"]).withColumn("config_hash", F.lit(config))
    # A file without facts still leaves a row, so that it is known next time.
    bare = hashes.where(F.col("path").isNotNull()).select("project", "path", F.lit(None).cast("string").alias("language"), F.lit("file").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(1).alias("line"), F.lit(1).alias("end_line"), F.lit(None).cast("map<string,string>").alias("attrs"), "content_hash", F.lit(config).alias("config_hash"))
    names = [c.split()[0] for c in CACHE.split(", ")]
    keyed.select(*names).unionByName(bare.select(*names)).sortWithinPartitions("kind").write.mode("append").parquet(cache)
    now = spark.read.schema(CACHE).parquet(cache).where(F.col("config_hash") == config)
    # Two runs that overlapped may both have added a file; a file's own facts may repeat each other and stay.
    single = now.where("kind = 'file'").groupBy("project", "path", "content_hash").count().where("count > 1").limit(1).isEmpty()
    held = now.join(history.hashes(files), ["project", "path", "content_hash"], "left_semi")
    if not single:
        held = held.dropDuplicates(["project", "path", "kind", "name", "start", "end", "content_hash"])
    held = written(held, "facts")
    if spark.read.schema(CACHE).parquet(cache).where("kind = 'file'").count() > 2 * held.where("kind = 'file'").count() + 16:
        _replace(spark, held.select(*names), cache)
    return held.where("kind <> 'file'").drop("content_hash", "config_hash"), hits


def incremental(files: DataFrame, cache: str, config: str) -> DataFrame:
    """Facts of the files; only what the cache lacks is parsed, and is added to it."""
    return cached_facts(files, cache, config)[0]


def _replace(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Puts rows in place of a folder; a run that fails between the two moves leaves the new folder beside it."""
    rows.write.mode("overwrite").parquet(f"{path}.new")
    delete(spark, path)
    rename(spark, f"{path}.new", path)


def watch(spark: SparkSession, root: str, checkpoint: str, handle: Callable[[DataFrame, int], None], project: str = "project", once: bool = False) -> StreamingQuery:
    """Calls ``handle`` with the files of each burst. ``once`` takes what is there and ends; else a batch starts every 250 ms."""
    writer = changes(spark, root, project).writeStream.foreachBatch(lambda df, n: handle(df, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="250 milliseconds")).start()


def bursts(events: DataFrame, ts: str = "ts", gap: str = "250 milliseconds", late: str = "10 seconds", keys: list[str] = ()) -> DataFrame:
    """(keys, start, end, n) of bursts of events that a gap parts; events later than ``late`` behind the newest are left out, as is usual for streams."""
    w = events.withWatermark(ts, late) if events.isStreaming else events
    return w.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, "w.start", "w.end", "n")
