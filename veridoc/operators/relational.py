"""Filters, samples, limits, lookups and set operations on document tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranking import exact_rank


def filter_equal(df: DataFrame, **conditions) -> DataFrame:
    """Rows that meet all conditions: equality, or membership for lists.  Unknown columns are an error."""
    for name, wanted in conditions.items():
        if name not in df.columns:
            raise KeyError(name)
        c = F.col(name)
        df = df.where(c.isin(*wanted) if isinstance(wanted, (list, tuple, set)) else c.isNull() if wanted is None else c == wanted)
    return df


def hash_order(key: str, seed: int) -> list[Column]:
    """A repeatable random order, the same on every engine: MD5 of key and seed, then the key."""
    return [F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), F.col(key)]


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n random rows without replacement (all, if there are fewer); a top-n, never a full sort."""
    return df.orderBy(*hash_order(key, seed)).limit(n)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def restrict(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ids; ids may call it original_sample_id."""
    name = "original_sample_id" if "original_sample_id" in ids.columns else key
    return df.join(ids.select(F.col(name).alias(key)), key, "left_semi")


def exclude(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key), key, "left_anti")


def pending(df: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """What isn't done, and only then the first `limit`."""
    out = exclude(df, done, key)
    return out if limit is None else out.orderBy(key).limit(limit)


def balanced(df: DataFrame, limit: int, positive: Column, key: str, seed: int = 42) -> DataFrame:
    """limit // 2 positive rows and the rest others, each as far as there are any."""
    yes = sample(df.where(positive), limit // 2, key, seed)
    return yes.unionByName(sample(df.where(~F.coalesce(positive, F.lit(False))), limit - limit // 2, key, seed))


def random_split(df: DataFrame, key: str, fraction: float = 0.02, seed: int = 42) -> DataFrame:
    """df with `split`: the first max(1, n * fraction) rows in hash order are "eval".  Ranks are exact and spread over tasks."""
    names = ["_hash", key] if key in df.columns else ["_hash"]
    ranked = exact_rank(df.withColumn("_hash", hash_order(key, seed)[0]), names, rank="_rank", size="_size")
    return ranked.select(*df.columns, F.when(F.col("_rank") < F.greatest(F.lit(1), F.floor(F.col("_size") * fraction)), "eval").otherwise("train").alias("split"))


def stratified_split(df: DataFrame, key: str, strata: Sequence[str], *, fraction: float = 0.1, least: int = 2, seed: int = 42) -> DataFrame:
    """df with `split`.  Strata of fewer than max(2, 2 * least) rows stay in train; the others give val rows by largest
    remainder of the overall ceil(n * fraction), in hash order within the stratum.

    Ranks are counted from a two-level histogram (hash prefix, then the rank inside a prefix), so a stratum with a
    third of all rows is not sorted in one task.
    """
    order = hash_order(key, seed)
    joint = F.concat_ws("|", *[F.coalesce(F.col(s).cast("string"), F.lit("None")) for s in strata])
    rows = df.withColumns({"_joint": joint, "_hash": order[0]}).withColumn("_bin", F.substring("_hash", 1, 3))
    sizes = rows.groupBy("_joint").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, 2 * least))
    total = sizes.agg(F.ceil(F.sum("n") * fraction).alias("t"), F.sum("n").alias("n")).first()
    want = total["t"] or 0
    share = F.col("n") * F.lit(float(want)) / F.lit(float(total["n"] or 1))
    floors = sizes.select("_joint", F.floor(share).alias("low"), (share - F.floor(share)).alias("rest"))
    left = want - (floors.agg(F.sum("low")).first()[0] or 0)
    quota = floors.withColumn("r", F.row_number().over(Window.orderBy(F.desc("rest"), "_joint"))).select("_joint", (F.col("low") + (F.col("r") <= left).cast("int")).alias("quota"))
    bins = rows.groupBy("_joint", "_bin").agg(F.count(F.lit(1)).alias("m"))
    before = bins.withColumn("before", F.sum("m").over(Window.partitionBy("_joint").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))).select("_joint", "_bin", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_joint", "_bin").orderBy("_hash", key))).join(before, ["_joint", "_bin"]).join(quota, "_joint", "left")
    return ranked.select(*df.columns, F.when(F.col("_rank") + F.col("before") <= F.col("quota"), "val").otherwise("train").alias("split"))


def first_hit(df: DataFrame, files: DataFrame, key: str, patterns: Sequence[Column], out: str = "path") -> DataFrame:
    """Left join to the file of the first pattern that exists.  patterns: file-name expressions over df, best first;
    files: name, path (of equal names the greatest path counts)."""
    index = files.groupBy("name").agg(F.max("path").alias("_path"))
    wanted = df.select(key, F.posexplode(F.array(*patterns)).alias("_rank", "name"))
    hits = wanted.join(index, "name").groupBy(key).agg(F.min_by("_path", "_rank").alias(out))
    return df.join(hits, key, "left")


def asof_headers(text_id: str, marks: DataFrame, headers: DataFrame, reach: int = 2000) -> DataFrame:
    """For each mark (text_id, at) the index of the last header (text_id, at, index) in the `reach` characters before it.

    One window over both kinds, sorted by offset inside a document; no join of marks with headers.
    """
    both = marks.select(text_id, "at", F.lit(None).cast("string").alias("index"), F.lit(True).alias("is_mark")).unionByName(headers.select(text_id, "at", F.col("index").cast("string").alias("index"), F.lit(False).alias("is_mark")))
    w = Window.partitionBy(text_id).orderBy("at").rangeBetween(-reach, -1)
    return both.withColumn("index", F.when(F.col("is_mark"), F.last("index", ignorenulls=True).over(w))).where("is_mark").select(text_id, "at", "index")


def updated_records(records: DataFrame, additions: DataFrame, key: str, field: str) -> DataFrame:
    """records with `field` taken from additions (key, field) where it was null; what is present stays, and so do records without one."""
    new = additions.select(key, F.col(field).alias(f"{field}__new"))
    return records.join(new, key, "left").withColumn(field, F.coalesce(field, f"{field}__new")).drop(f"{field}__new")


def reject_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The first rule that fails; null if none does."""
    out = None
    for name, failing in rules:
        out = F.when(failing, name) if out is None else out.when(failing, name)
    return out.otherwise(F.lit(None).cast("string"))
