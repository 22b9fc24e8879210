"""Session settings the engine relies on, and intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PATHS: dict[int, str] = {}


def session(app: str = "millrace", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; a cluster's own settings win over the builder's."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a fresh local one only on a single machine without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def _deleted(spark: SparkSession, path: str, now: bool) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(at, True) if now else system.deleteOnExit(at)


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: what reads it doesn't compute them again, nor do lost executors.

    The table goes when the JVM ends, or with dropped().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _deleted(spark, path, now=False)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(table)] = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete written tables after their last reader."""
    for table in tables:
        if path := _PATHS.pop(id(table), None):
            _deleted(table.sparkSession, path, now=True)
