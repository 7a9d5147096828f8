"""An evaluation that stops and goes on gives what one run gives."""

import os

import pytest
from pyspark.sql import functions as F

from veridoc.streaming import incremental, resume


def results(spark, low, high):
    n = F.col("id")
    return spark.range(low, high).select(n.cast("string").alias("sample_id"), F.when(n % 11 != 0, n % 3 == 0).alias("truth"), (n % 4 == 0).alias("predicted"), F.when(n % 5 != 0, (n % 10) / 10).alias("iou"), F.when(n % 5 != 0, (n % 7) / 7).alias("f1"))


def test_stopped_and_restarted(spark, tmp_path):
    got = []
    for name, batches in (("one", [[(0, 300)]]), ("two", [[(0, 120), (60, 130)], [(100, 300), (0, 10)], []])):
        src, out, check = (str(tmp_path / name / k) for k in ("src", "out", "check"))
        for parts in batches:
            for low, high in parts:
                results(spark, low, high).coalesce(1).write.mode("append").json(src)
            q = resume.running_scores(incremental.new_files(spark, src, resume.RESULT), out, check, buckets=5)
            q.awaitTermination()
        got.append(resume.totals(spark, out).first().asDict())
        resume.finished(spark, check)
        assert not os.path.exists(check)
    assert {k: pytest.approx(v) for k, v in got[0].items()} == got[1]
    ids = range(300)
    truth = {i: i % 3 == 0 for i in ids if i % 11}
    assert got[0]["n"] == 300 and got[0]["n_without_truth"] == 300 - len(truth) and got[0]["n_true"] == sum(truth.values())
    assert got[0]["tp"] == sum(t and i % 4 == 0 for i, t in truth.items()) and got[0]["fn"] == sum(t and i % 4 != 0 for i, t in truth.items())
    assert got[0]["mean_iou"] == pytest.approx(sum((i % 10) / 10 for i in ids if i % 5) / 240) and got[0]["n_grounded"] == 240


def test_rows_without_ids_and_repeated_ids(spark, tmp_path):
    src, out, check = (str(tmp_path / k) for k in ("src", "out", "check"))
    rows = [(None, True, True, 1.0, 1.0), ("a", None, None, None, None), ("b", True, None, 0.5, 1.0), ("a", True, True, 1.0, 1.0)]
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, resume.RESULT).coalesce(1).write.mode("append").json(src)
        resume.running_scores(incremental.new_files(spark, src, resume.RESULT), out, check).awaitTermination()
    t = resume.totals(spark, out).first()
    assert (t.n, t.n_without_truth, t.n_true, t.fn, t.tp, t.n_grounded, t.mean_iou, t.precision) == (2, 1, 1, 1, 0, 1, 0.5, 0)
    spark.createDataFrame([], f"bucket int, {resume.STATE}, batch int").write.partitionBy("batch").parquet(str(tmp_path / "none"))
    none = resume.totals(spark, str(tmp_path / "none")).first()
    assert none.n == 0 and none.mean_iou is None and none.precision == 0
