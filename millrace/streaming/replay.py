"""Operation logs as streams: each operation counts once, for ever, whatever order or how often files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import ledger as L


def read_ops(spark: SparkSession, folder: str, schema: str, files: int = 1000) -> DataFrame:
    """A file-source stream of JSON operations."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def apply_once(applied: str, sink):
    """A foreachBatch function: operations not in the folder ``applied`` go to ``sink``, then their ids are written there.

    The ids of a batch are written with its number as a partition, so a batch that is run again overwrites itself.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(applied)
        have = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        fresh = batch.dropDuplicates(["op_id"])
        if have:
            old = spark.read.parquet(applied).where(F.col("batch") != number)
            fresh = L.new_ops(fresh, old)
        sink(fresh, number)
        fresh.select("op_id").write.mode("overwrite").parquet(f"{applied}/batch={number}")

    return run


def replay(ops: DataFrame, applied: str, sink, checkpoint: str):
    """Run what is there and stop."""
    return ops.writeStream.foreachBatch(apply_once(applied, sink)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, at: str, who: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(who, window, n): sessions with bounded state; similar to the batch pace, whose gaps credit the later operation."""
    return events.withWatermark(at, late).groupBy(who, F.session_window(at, gap).alias("window")).agg(F.count("*").alias("n"))
