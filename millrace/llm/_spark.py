"""Small helpers shared by the operators: intermediate tables in the shared folder, and joins with short lists."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1 << 18  #: a list of at most so many narrow rows may be sent to every executor
BATCH_BYTES = 4 << 20  #: bytes of an Arrow batch, about
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at about BATCH_BYTES, unless it has a bound of its own; so neither side holds a whole task's texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a fresh local one only on a single machine without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(named)
    return named


class Shelf:
    """The intermediate tables of one call, written as Parquet into the shared folder.

    put() cuts the lineage: later steps read the table, and the shuffle files behind it go as soon as it is written.
    drop() deletes tables after their last reader; what the result still reads goes when the JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def _path(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/t-{uuid.uuid4().hex}"
        before = self.spark.conf.get(_CLEAN)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, before)
        system, at = self._path(path)
        system.deleteOnExit(at)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            system, at = self._path(self.paths.pop(id(table)))
            system.delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """Write as Parquet into the shared folder and read again."""
    return Shelf(df.sparkSession).put(df)


def among(df: DataFrame, listed: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join with a list of rows without long columns: broadcast if it is counted short enough, else shuffled."""
    short = listed.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(listed) if short else listed, on, how)
