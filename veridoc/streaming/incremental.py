"""Structured Streaming forms of resume, skip-existing and running scores; windowed event counts as an extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def new_files(spark: SparkSession, path: str, schema: str, kind: str = "json", per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def once_per_id(stream: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, key: str, checkpoint: str) -> StreamingQuery:
    """Processes each id once: a batch leaves out ids that out already holds, and appends its results under its number, so a
    repeated batch replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(out)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            done = spark.read.parquet(out).where(F.col("batch") != number)
            fresh = fresh.join(done.select(key), key, "left_anti")
        process(fresh).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events per tumbling window and type; later events than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")
