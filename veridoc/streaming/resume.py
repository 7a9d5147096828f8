"""Scores of a long evaluation that can stop and go on: a stateful stream holds what is done and the sums so far.

Results arrive as files of rows (sample_id, truth, predicted, iou, f1); a sample counts once, however often its row arrives.
Samples are spread over buckets by the hash of their id, so neither ids nor sums are one key's state.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

RESULT = "sample_id string, truth boolean, predicted boolean, iou double, f1 double"
COUNTS = ("n", "n_without_truth", "n_true", "n_predicted", "tp", "fp", "fn", "n_grounded")
SUMS = ("iou", "f1")
STATE = ", ".join([f"{c} bigint" for c in COUNTS] + [f"{c} double" for c in SUMS])
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Running(StatefulProcessor):
    """State of a bucket: a map of the ids that are done, and one row of sums."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getMapState("done", "sample_id string", "seen boolean")
        self.sums = handle.getValueState("sums", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        so_far = dict(zip(COUNTS + SUMS, self.sums.get(), strict=True)) if self.sums.exists() else dict.fromkeys(COUNTS, 0) | dict.fromkeys(SUMS, 0.0)
        for r in rows:
            if self.done.containsKey((r.sample_id,)):
                continue
            self.done.updateValue((r.sample_id,), (True,))
            so_far["n"] += 1
            so_far["n_predicted"] += bool(r.predicted)
            if r.truth is None:
                so_far["n_without_truth"] += 1
            else:
                so_far["n_true"] += r.truth
                so_far["tp"] += r.truth and bool(r.predicted)
                so_far["fp"] += not r.truth and bool(r.predicted)
                so_far["fn"] += r.truth and not r.predicted
            if r.iou is not None and r.f1 is not None:
                so_far["n_grounded"] += 1
                so_far["iou"] += r.iou
                so_far["f1"] += r.f1
        values = tuple(int(so_far[c]) for c in COUNTS) + tuple(float(so_far[c]) for c in SUMS)
        self.sums.update(values)
        yield Row(bucket=key[0], **dict(zip(COUNTS + SUMS, values, strict=True)))

    def close(self) -> None:
        pass


def running_scores(results: DataFrame, out: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Starts the stream over what has arrived.  Started again with the same checkpoint it goes on where it stopped.

    results: a stream of RESULT columns; rows without a sample_id are left out.  out: a table of each bucket's sums after each
    batch; a batch that is run again replaces its own part.  The number of buckets belongs to the checkpoint.
    """
    spark = results.sparkSession
    keyed = results.where("sample_id IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64("sample_id"), F.lit(buckets)).cast("int"))
    sums = keyed.groupBy("bucket").transformWithState(Running(), f"bucket int, {STATE}", "Update", "None")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return sums.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)


def totals(spark: SparkSession, out: str) -> DataFrame:
    """One row: counts, precision, recall and F1 of detection, means of the grounding scores (null without any)."""
    latest = spark.read.schema(f"bucket int, {STATE}, batch int").parquet(out).groupBy("bucket").agg(F.max_by(F.struct(*COUNTS, *SUMS), "batch").alias("s")).select("s.*")
    t = latest.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS + SUMS])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return t.select(*COUNTS, ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("detection_f1"), *[F.try_divide(F.col(c), F.col("n_grounded")).alias(f"mean_{c}") for c in SUMS])


def finished(spark: SparkSession, checkpoint: str) -> None:
    """Deletes the state of an evaluation that ended well."""
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
