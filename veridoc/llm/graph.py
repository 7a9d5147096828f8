"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import dropped, written


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def connected_components(links: DataFrame, most_rounds: int = 200) -> DataFrame:
    """node, component (its smallest node) for every node of links (a, b: bigint).

    Each round is two aggregations and joins on a node; minima are summed before the shuffle, and a hub's join is one
    that adaptive execution splits.  Rounds end up as written tables, so a lost executor costs one round's work.  Rounds grow
    with the logarithm of the longest path; if `most_rounds` didn't do, that is an error and not a result.
    """
    edges = written(links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(edges)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = written(small.where("u != v").distinct(), "edges")
        now = _mark(new)
        dropped(large)
        dropped(edges)
        edges, done, mark = new, now == mark, now
        if done:
            break
    else:
        raise RuntimeError(f"components haven't settled in {most_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
