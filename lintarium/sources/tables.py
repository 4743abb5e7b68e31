"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as in a local session, the session's own or a new folder of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not kept.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lintarium-"))
            kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = kept.get()
    return root.rstrip("/")


def local_scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared folder as a path of this machine, for tools that know no other; the shared folder must be mounted."""
    root = shared_root(spark)
    if "://" in root and not root.startswith("file://"):
        raise RuntimeError("this needs a shared folder that is mounted as a path")
    at = f"{root.removeprefix('file://').removeprefix('file:')}/{label}-{uuid.uuid4().hex}"
    os.makedirs(at)
    return at


def written(df: DataFrame, label: str) -> DataFrame:
    """The table after it was written and read again; its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lintarium_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more; other tables are left alone."""
    for t in tables:
        if path := getattr(t, "_lintarium_path", None):
            delete(t.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(old)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(at, spark._jvm.org.apache.hadoop.fs.Path(new))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once a session, as a zip in the shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_lintarium_core", False):
        return
    top, data = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for d, _, names in os.walk(top):
            for n in (n for n in names if n.endswith(".py")):
                z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), os.path.dirname(top)))
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/tables/package-{uuid.uuid4().hex}.zip")
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(at.toString())
    sc._lintarium_core = True
