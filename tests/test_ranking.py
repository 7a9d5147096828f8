"""Exact ranks over sampled ranges: results and the share of a task."""

import random

import pytest
from pyspark.sql import functions as F

from veridoc.operators import metrics, ranking, relational
from veridoc.tables import stored


def test_rank_against_sorting(spark):
    rng = random.Random(3)
    rows = [(i, "en" if rng.random() < 0.95 else rng.choice(["de", None, "fr"]), 10**12 if i == 7 else rng.randint(0, 300)) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, lang string, v long")
    got = ranking.exact_rank(df, ["v", "id"], ["lang"]).collect()
    want = {}
    for lang in {r[1] for r in rows}:
        own = sorted((v, i) for i, g, v in rows if g == lang)
        want |= {i: (k, len(own)) for k, (_, i) in enumerate(own)}
    assert {r.id: (r["rank"], r["size"]) for r in got} == want and len(got) == len(rows)
    assert ranking.exact_rank(df.limit(0), ["v"], ["lang"]).count() == 0


def test_ranges_are_even(spark):
    """One language with 95 % of the rows and one far outlier: no task has more than its share."""
    df = spark.range(20_000).select("id", F.when(F.col("id") % 20 == 0, "de").otherwise("en").alias("lang"), F.when(F.col("id") == 5, 10**15).otherwise(F.col("id") % 100).alias("v"))
    rows = stored(df, "test").withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(8, "lang", "v", "_tie")
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
    got = ranking.shards(df, 7, ["lang"], "v", "id").groupBy("lang", "shard").count().collect()
    assert {r["count"] for r in got if r.lang == "en"} <= {2714, 2715} and len(got) == 14


def test_weighted_rank_and_percentiles(spark):
    values = [1] * 5000 + [2] * 10 + [10**9] + list(range(3, 500))
    df = spark.createDataFrame([(v,) for v in values], "v long")
    order = sorted(values)
    want = {p: order[len(order) - 1 if p >= 100 else round(p / 100 * (len(order) - 1))] for p in (0.0, 50.0, 90.0, 90.5, 99.0, 100.0)}
    assert {r.percent: r.value for r in metrics.nearest_ranks(df, "v", list(want)).collect()} == want
    assert [r.value for r in metrics.nearest_ranks(df.limit(0), "v", [50.0]).collect()] == [0]


def test_random_split_sizes(spark):
    df = spark.range(1001).withColumnRenamed("id", "key")
    got = relational.random_split(df, "key", 0.02)
    assert got.where("split = 'eval'").count() == 20
    first = sorted(df.select(relational.hash_order("key", 42)[0].alias("h"), "key").collect())[:20]
    assert {r.key for r in got.where("split = 'eval'").collect()} == {r.key for r in first}
    assert relational.random_split(df.limit(3), "key").where("split = 'eval'").count() == 1


def test_items_are_what_a_list_gives(spark):
    values = [f"v{i}" for i in range(23)]
    df = spark.createDataFrame([(i, f"s{i}", v) for i, v in enumerate(values)], "i int, sample_id string, v string").repartition(3)
    get = lambda key: [r.v for r in ranking.items(df, ["i"], key).orderBy("place").collect()]
    for key in (slice(None), slice(5, -3, 7), slice(None, None, -4), slice(30, 2, -5), slice(-100, 100), slice(9, 3), slice(-4, None)):
        assert get(key) == values[key]
    assert get(0) == values[:1] and get(-1) == values[-1:] and get([3, -2, 3]) == [values[3], values[-2], values[3]] and get([]) == []
    assert get("s7") == ["v7"]
    for key in (23, -24, [0, 99], "s99"):
        with pytest.raises(Exception, match="no row"):
            get(key)
    with pytest.raises(ValueError):
        ranking.items(df, ["i"], slice(0, 5, 0))
