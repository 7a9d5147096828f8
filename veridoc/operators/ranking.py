"""Numbering, top-k, shards, runs and gaps, written as windows inside a document."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..tables import stored


def exact_rank(df: DataFrame, order: list[str], by: list[str] | tuple[str, ...] = (), *, rank: str = "rank", size: str = "size", weight: str | None = None, partitions: int | None = None) -> DataFrame:
    """df with each row's place (from 0) among its group's rows in `order`, and how many those are.

    With `weight` (whole numbers), places and sizes count weights: a row's place is the weight before it.

    Sampled splitters cut (group, order) into ranges of about equal numbers of rows, each range is sorted for itself, and
    a range's places begin at the sum of the ranges before it in its group.  So a group with nearly all rows and a
    value far from the others spread over as many tasks as any.  Equal rows are told apart by where they were read, their places
    being arbitrary among themselves.  Nulls come first.  The plan of df runs twice (once for the sample).
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*by, *order, "_tie"]
    rows = stored(tied.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()), "ranked").drop("_tie")
    part = F.shiftright("_id", 33)
    rows = rows.withColumn("_part", part)
    if weight is None:
        rows, each = rows.withColumn("_before", F.col("_id")), F.count(F.lit(1))
    else:
        w = Window.partitionBy("_part", *by).orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows, each = rows.withColumn("_before", F.sum(weight).over(w) - F.col(weight)), F.sum(weight)
    # A row for each range, and one more for each group that ends inside of it.
    names = {b: f"_g{i}" for i, b in enumerate(by)}
    ranges = rows.groupBy("_part", *by).agg(F.min("_before").alias("_from"), each.alias("_n")).withColumnsRenamed(names | {"_part": "_p"})
    w = Window.partitionBy(*names.values())
    ahead = F.coalesce(F.sum("_n").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("_p", "_from", *names.values(), ahead.alias("_ahead"), F.sum("_n").over(w).alias(size))
    same = reduce(and_, [F.col(b).eqNullSafe(F.col(g)) for b, g in names.items()], F.col("_part") == F.col("_p"))
    return rows.join(ranges, same).select(*df.columns, (F.col("_before") - F.col("_from") + F.col("_ahead")).cast("bigint").alias(rank), F.col(size).cast("bigint").alias(size))


def numbered(df: DataFrame, by: list[str], *order: str, name: str = "number") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def items(df: DataFrame, order: list[str], key: int | str | slice | list[int], name: str = "sample_id") -> DataFrame:
    """The rows that key asks for, with `place` (their order in the answer): an id, a position, a slice or a list of positions.

    Positions count rows in `order`; negative ones count from the end, and a list may repeat them.  An id or a position that isn't
    there is an error when the rows are computed; a slice takes what there is, as Python's slices do.
    """
    spark = df.sparkSession
    if isinstance(key, slice):
        ranked = exact_rank(df, order, rank="_rank", size="_size")
        step, n = 1 if key.step is None else key.step, F.col("_size")
        if not step:
            raise ValueError("slice step cannot be zero")
        low, high = (F.lit(0), n) if step > 0 else (F.lit(-1), n - 1)
        bound = lambda v, default: default if v is None else F.greatest(n + v, low) if v < 0 else F.least(F.lit(v), high)
        start, stop = (bound(key.start, low), bound(key.stop, high)) if step > 0 else (bound(key.start, high), bound(key.stop, low))
        ahead = (F.col("_rank") - start) * (1 if step > 0 else -1)
        inside = (ahead >= 0) & (F.col("_rank") < stop if step > 0 else F.col("_rank") > stop) & (ahead % abs(step) == 0)
        return ranked.where(inside).select(*df.columns, F.floor(ahead / abs(step)).cast("bigint").alias("place"))
    if isinstance(key, str):
        asked, rows = spark.createDataFrame([(0, key)], "place bigint, _asked string"), df.groupBy(F.col(name).alias("_asked")).agg(F.min(F.struct(*order, *[c for c in df.columns if c not in order])).alias("_row"))
    else:
        wanted = list(key) if not isinstance(key, int) else [key]
        asked = spark.createDataFrame([(i, int(k)) for i, k in enumerate(wanted)], "place bigint, _asked bigint")
        ranked = exact_rank(df, order, rank="_rank", size="_size")
        places = F.array("_rank", F.col("_rank") - F.col("_size")) if any(k < 0 for k in wanted) else F.array("_rank")
        rows = ranked.select(F.explode(places).alias("_asked"), F.struct(*df.columns).alias("_row"))
    row = F.coalesce("_row", F.raise_error(F.concat(F.lit("no row "), F.col("_asked").cast("string"))).cast(dict(rows.dtypes)["_row"]))
    return asked.join(rows, "_asked", "left").select("place", row.alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in df.columns], "place")


def shards(df: DataFrame, n: int, by: list[str], *order: str) -> DataFrame:
    """Contiguous shards 0..n-1 whose sizes differ by one at most, the first ones larger; a group may hold all rows."""
    ranked = exact_rank(df, list(order), by, rank="_rank", size="_size")
    low, more = F.floor(F.col("_size") / n), F.col("_size") % n
    head = more * (low + 1)
    shard = F.when(F.col("_rank") < head, F.floor(F.col("_rank") / (low + 1))).otherwise(more + F.floor((F.col("_rank") - head) / F.greatest(low, F.lit(1))))
    return ranked.select(*df.columns, shard.cast("int").alias("shard"))


def runs(df: DataFrame, by: list[str], position: str, present: Column) -> DataFrame:
    """Maximal runs of consecutive positions where present holds: begin, end (exclusive), length."""
    w = Window.partitionBy(*by).orderBy(position)
    marked = df.where(present).withColumn("_island", F.col(position) - F.row_number().over(w))
    return marked.groupBy(*by, "_island").agg(F.min(position).alias("begin"), (F.max(position) + 1).alias("end"), F.count(F.lit(1)).alias("length")).drop("_island")


def widest_gap(df: DataFrame, by: list[str], position: str) -> DataFrame:
    """The longest stretch between present positions, the earliest of equals: gap length and the place to split."""
    w = Window.partitionBy(*by).orderBy(position)
    gaps = df.withColumn("before", F.lag(position).over(w)).where(F.col(position) - F.col("before") > 1)
    one = gaps.groupBy(*by).agg(F.max_by(F.struct("before", F.col(position).alias("after")), F.struct(F.col(position) - F.col("before"), -F.col(position))).alias("g"))
    return one.select(*by, (F.col("g.after") - F.col("g.before") - 1).alias("gap"), F.floor((F.col("g.before") + 1 + F.col("g.after")) / 2).cast("bigint").alias("split"))


def separator_gaps(df: DataFrame, by: list[str], begin: str, end: str, wanted: int) -> DataFrame:
    """Which gaps separate words: those wider than the middle of the largest jump in width if they are `wanted` many,
    else the `wanted` widest (the earlier of equals)."""
    width = F.col(end) - F.col(begin)
    sized = df.withColumn("_w", width)
    steps = sized.withColumn("_next", F.lead("_w").over(Window.partitionBy(*by).orderBy("_w", begin))).withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("_w", begin)))
    jump = steps.where(F.col("_next") > F.col("_w")).groupBy(*by).agg(F.max_by(F.struct("_w", "_next"), F.struct(F.col("_next") - F.col("_w"), -F.col("_i"))).alias("j")).select(*by, ((F.col("j._w") + F.col("j._next")) / 2).alias("_cut"))
    both = sized.join(jump, by, "left").withColumn("_n", F.count_if(F.col("_w") > F.col("_cut")).over(Window.partitionBy(*by)))
    ranked = both.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_w"), begin)))
    return ranked.where(F.when(F.col("_n") == wanted, F.col("_w") > F.col("_cut")).otherwise(F.col("_r") <= wanted)).select(*df.columns)


def latest_checkpoint(paths: DataFrame, path: str = "path") -> DataFrame:
    number = F.regexp_extract(path, r"checkpoint-(\d+)/?$", 1)
    return paths.where(number != "").agg(F.max_by(path, number.cast("bigint")).alias("path"))


def running_mean(df: DataFrame, value: str, every: int, *order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The mean so far at each `every`-th row."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumns({"position": F.row_number().over(w), "mean_so_far": F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return out.where(F.col("position") % every == 0)
