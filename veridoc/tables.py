"""Intermediate tables in the shared folder: later stages read them again, so lost executors cost no earlier work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir; a temporary folder only where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and (got := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        named = got.get()
    if not named:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="veridoc-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/veridoc-tables"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
