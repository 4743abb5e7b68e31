"""What the corpus operators share: the shared folder, written intermediate tables and word splitting."""

from __future__ import annotations

import gc
import io
import os
import re
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintarium.sources.tables import shared_root

#: The white space of all contracts, for Java's and Python's regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Lower-cases A-Z only.
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
LOWER_FROM, LOWER_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; nothing is there yet."""
    return f"{shared_root(spark)}/lintarium/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing of it."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lintarium_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for t in tables:
        path = t._lintarium_path
        spark = t.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, which it does when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows and bytes of a batch that goes to a Python worker: a few thousand texts are held as objects at once, not more.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once a session, so that Python workers can import it wherever they run.

    Batches of the session are made small enough for long texts, unless they are smaller already.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_lintarium_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(d, n)
                    z.write(p, os.path.relpath(p, os.path.dirname(top)))
    path = f"{scratch(spark, 'package')}.zip"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(path)
    sc._lintarium_shipped = True


def text_of(df: DataFrame, text: str = "text") -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def held_out(id_col: Column, folds: int) -> Column:
    """Rows whose crc32 of the id as text leaves 1 when divided by ``folds``; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % folds == 1


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of words, on the JVM."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
