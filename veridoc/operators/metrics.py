"""Detection, grounding, rubric and final scores; text statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .ranking import exact_rank


def is_forged(verdict: Column) -> Column:
    return F.coalesce(F.upper(verdict).startswith("FORG"), F.lit(False))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def detection_scores(df: DataFrame, truth: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """precision, recall, f1 (0 where undefined), accuracy and n of forged verdicts, in one pass."""
    t, p = is_forged(F.col(truth)), is_forged(F.col(predicted))
    counted = df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t == p).alias("same"), F.count(F.lit(1)).alias("n"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.select(*by, _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(F.col("same"), F.col("n")).alias("accuracy"), "n")


def grounding_scores(df: DataFrame, forged: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Means of iou and f1 over all rows and over forged ones; 0 without rows."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return df.groupBy(*by).agg(mean("iou").alias("miou"), mean("f1").alias("mf1"), mean(F.when(forged, F.col("iou"))).alias("miou_forged"), mean(F.when(forged, F.col("f1"))).alias("mf1_forged"), F.count(F.lit(1)).alias("n"), F.count_if(forged).alias("n_forged"))


def rubric_scores(df: DataFrame) -> DataFrame:
    """Means of three axes of 0 to 100, as shares of one, and of the rows' averages."""
    axes = ("factuality", "reasoning", "completeness")
    each = sum((F.col(a) for a in axes), F.lit(0.0)) / 3
    return df.agg(*[F.coalesce(F.avg(a) / 100, F.lit(0.0)).alias(a) for a in axes], F.coalesce(F.avg(each) / 100, F.lit(0.0)).alias("average_norm"))


#: Weights of the parts: alike in the library, otherwise at the command line.
EVEN = {"detection": 0.25, "grounding": 0.25, "explanation": 0.25, "rubric": 0.25}
COMMAND_LINE = {"detection": 0.30, "grounding": 0.40, "explanation": 0.15, "rubric": 0.15}


def final_score(parts: dict[str, Column], weights: dict[str, float] = EVEN) -> Column:
    """Weighted mean of the parts that aren't null; 0 if their weights add to nothing."""
    total = sum((F.when(c.isNotNull(), weights[k]).otherwise(0.0) for k, c in parts.items()), F.lit(0.0))
    value = sum((F.coalesce(c * weights[k], F.lit(0.0)) for k, c in parts.items()), F.lit(0.0))
    return F.when(total > 0, value / total).otherwise(0.0)


def grounding_part(miou: Column, mf1: Column) -> Column:
    return 0.5 * miou + 0.5 * mf1


def pixel_metrics(tp: Column, fp: Column, fn: Column, empty_f1: float = 1.0) -> dict[str, Column]:
    """Of pixel counts; two empty masks have IoU 1 and F1 empty_f1 (a variant).  no_fp: as if all predicted were right."""
    union = tp + fp + fn
    none = (tp == 0) & (fn == 0)
    return {
        "iou": F.when(union == 0, 1.0).otherwise(_ratio(tp, union)),
        "f1": F.when(union == 0, empty_f1).otherwise(_ratio(2 * tp, 2 * tp + fp + fn)),
        "iou_no_fp": F.when(none, 1.0).otherwise(_ratio(tp, tp + fn)),
        "f1_no_fp": F.when(none, 1.0).otherwise(_ratio(2 * tp, 2 * tp + fn)),
    }


def counts(df: DataFrame, by: str, name: str = "n") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias(name))


def crosstab(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts of rows by columns, 0 where none; null keys are left out."""
    return df.where(F.col(rows).isNotNull() & F.col(columns).isNotNull()).groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1))).na.fill(0)


def text_stats(df: DataFrame, size: Column, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(size).alias("total"), F.avg(size).alias("mean"), F.median(size).alias("median"), F.min(size).alias("least"), F.max(size).alias("most"))


def nearest_ranks(df: DataFrame, value: str, percents: list[float]) -> DataFrame:
    """percent, value: the value at index round(p / 100 * (n - 1)), half to even; percents of 100 and more give the last.

    Distinct values are counted first, then ranked by their counts over sampled ranges: neither a value that most rows
    share nor one far from all others fills a task.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("m"))
    ranked = exact_rank(counted, ["value"], rank="before", size="n", weight="m")
    p = F.col("percent")
    at = F.when(p >= 100, F.col("n") - 1).otherwise(F.greatest(F.lit(0), F.least(F.col("n") - 1, F.rint(p / 100 * (F.col("n") - 1)).cast("bigint"))))
    wanted = df.sparkSession.createDataFrame([(float(p),) for p in percents], "percent double")
    hit = ranked.join(F.broadcast(wanted), (F.col("before") <= at) & (at < F.col("before") + F.col("m"))).select("percent", "value")
    return wanted.join(hit, "percent", "left").select("percent", F.coalesce("value", F.lit(0)).alias("value"))


def histogram(df: DataFrame, value: str, bins: int = 12, width: int = 50) -> DataFrame:
    """bin, low, high, n, bar of equal whole-numbered bins; the last takes what is over."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    both = df.select(value).join(F.broadcast(ends))
    step = F.greatest(F.lit(1), F.floor((F.col("hi") - F.col("lo") + bins - 1) / bins))
    filled = both.groupBy(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / step)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(ends)).join(filled, "bin", "left")
    most = F.max(F.coalesce("n", F.lit(0))).over(Window.partitionBy())
    n = F.coalesce("n", F.lit(0))
    low = (F.col("lo") + F.col("bin") * step).cast("bigint")
    return every.select("bin", low.alias("low"), (low + step - 1).cast("bigint").alias("high"), n.alias("n"), F.floor(n * width / F.greatest(most, F.lit(1))).cast("int").alias("bar"))


def over_cutoff(df: DataFrame, value: str, cutoff: int, n: int, key: str) -> DataFrame:
    """The n largest above a cutoff, with the share of all rows that are above it."""
    share = df.agg((F.count_if(F.col(value) > cutoff) * 100.0 / F.count(F.lit(1))).alias("share"))
    return df.where(F.col(value) > cutoff).orderBy(F.desc(value), key).limit(n).join(F.broadcast(share))


def _numbers(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors by dimension; vectors that are null or have null elements are left out."""
    flat = vectors.combine_chunks()
    size = pc.fill_null(pc.list_value_length(flat), 0).to_numpy(zero_copy_only=False)
    whole = np.ones(len(flat), bool)
    whole[pc.list_parent_indices(flat).to_numpy()[pc.list_flatten(flat).is_null().to_numpy(zero_copy_only=False)]] = False
    whole &= flat.is_valid().to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(size[whole]):
        at = np.flatnonzero(whole & (size == n))
        v = pc.list_flatten(flat.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(float).reshape(len(at), n)
        norm = np.sqrt((v * v).sum(1))[:, None]
        out[int(n)] = at, np.divide(v, norm, out=np.zeros_like(v), where=norm != 0)
    return out


def best_cosines(left: pa.ChunkedArray, right: pa.ChunkedArray, tile: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's best cosine on the other side, by tiles of one matrix product; pairs without a cosine have 0."""
    a, b = _numbers(left), _numbers(right)
    of_a, of_b = np.full(len(left), -np.inf), np.full(len(right), -np.inf)
    met_a, met_b = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    for n in a.keys() & b.keys():
        (i, x), (j, y) = a[n], b[n]
        met_a[i], met_b[j] = len(j), len(i)
        for k in range(0, len(i), tile):
            for m in range(0, len(j), tile):
                c = x[k : k + tile] @ y[m : m + tile].T
                of_a[i[k : k + tile]] = np.maximum(of_a[i[k : k + tile]], c.max(1))
                of_b[j[m : m + tile]] = np.maximum(of_b[j[m : m + tile]], c.max(0))
    return np.where(met_a < len(right), np.maximum(of_a, 0), of_a), np.where(met_b < len(left), np.maximum(of_b, 0), of_b)


def greedy_similarity(pairs: DataFrame, by: list[str], left: str, right: str, per_block: int = 2_000_000) -> DataFrame:
    """Precision, recall and F of two groups of vectors by each vector's best cosine on the other side.

    pairs: by, side ("left" or "right"), id, vector.  Vectors meet inside their group only: each side is cut into blocks of about
    `per_block` numbers, and a task multiplies two blocks, so memory is bounded and a large group spreads over tasks.
    """
    rows = pairs.where(F.col("side").isin(left, right)).select(*by, (F.col("side") == left).alias("_left"), "id", "vector").na.drop(subset=by)
    blocks = lambda own: F.ceil(F.sum(F.when(own, F.greatest(F.size("vector"), F.lit(1)))) / per_block).cast("int")
    n = rows.groupBy(*by).agg(blocks(F.col("_left")).alias("_na"), blocks(~F.col("_left")).alias("_nb"))
    placed = rows.join(n, by).where("_na > 0 AND _nb > 0")
    own = lambda c: F.pmod(F.xxhash64("id", "vector"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = placed.where("_left").select(*by, own("_na").alias("_a"), every("_nb").alias("_b"), "id", "vector")
    b = placed.where("NOT _left").select(*by, every("_na").alias("_a"), own("_nb").alias("_b"), "id", "vector")
    b = b.toDF(*b.columns)  # columns of its own: both sides come from one table
    key = [*by, "_a", "_b"]

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:  # a block that hashing left empty
            return nothing
        of_x, of_y = best_cosines(x["vector"], y["vector"])
        made = [t.select([*by, "id"]).append_column("_left", pa.array(np.full(len(c), one))).append_column("c", pa.array(c)) for t, c, one in ((x, of_x, True), (y, of_y, False))]
        return pa.concat_tables(made).select([*by, "_left", "id", "c"])

    out = b.select(*by, F.lit(True).alias("_left"), "id", F.lit(0.0).alias("c")).schema
    nothing = to_arrow_schema(out).empty_table()
    best = a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(meet, out).groupBy(*by, "_left", "id").agg(F.max("c").alias("c"))
    both = best.groupBy(*by).agg(F.avg(F.when(~F.col("_left"), F.col("c"))).alias("precision"), F.avg(F.when(F.col("_left"), F.col("c"))).alias("recall"))
    return both.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
