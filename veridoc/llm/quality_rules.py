"""Quality rules: base rules, then robust multivariate outliers per language and source.

Every document becomes a vector of transformed statistics in fixed point (thousandths).  Each (lang, source) group gets
an estimate by concentration steps towards the minimum covariance determinant: from medians and median deviations the half
nearest to the centre is taken, then `steps` steps recompute mean and covariance of the `share` of rows that are nearest by
Mahalanobis distance (one start; each step lowers the determinant, but no other start is compared).  A document beyond the
cutoff `cut` of the final squared distance (rescaled by its median) is rejected.

Everything is DataFrame expressions.  A step is one aggregation of integer sums (exact, so any partitioning and any
retry gives the same estimate), one small table of groups and one of distance bins: the nearest share is found from a
histogram of distances per group, never by collecting or sorting a group.  A hot source is summed before the shuffle; the
groups' table joins back by (lang, source), which adaptive execution broadcasts while small and splits when skewed.
The documents' texts are read once; the vectors are a written table of a few dozen bytes a row.

Defined cases: null text has no words (base_failed); null lang or source form groups of their own; groups of fewer than
`min_rows` fitting rows share one pooled estimate, and if the pool is that small too, the method keeps its rows; ties share
a distance; repeated rows each return a row; statistics without spread have a floor on their deviation; an empty table
returns no rows; texts of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANKS, pair_hashes, text_of, written

#: The chi-square median of six degrees of freedom, and the cutoff of the squared distance.  Real statistics have heavier
#: tails than the normal law (its 1 - 10^-6 quantile is 38), and clean documents must stay.
CHI2_MEDIAN, CHI2_CUT = 5.3481, 200.0
VECTOR = ("v_words", "v_length", "v_symbols", "v_repeats", "v_upper", "v_points")
#: Deviations are at least this many thousandths.
FLOOR = 150.0


def statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_points of column text."""
    t = text_of()
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.select(*keep, F.array_remove(F.split(t, BLANKS, -1), "").alias("words"), lines.alias("lines"), F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"), F.regexp_count(t, F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"), F.regexp_count(t, F.lit(r"[!-/:-@\[-`{-~]")).cast("bigint").alias("n_points"))
    kept = (*keep, "n_symbols", "n_upper", "n_points")
    two = one.select(*kept, F.size("words").cast("bigint").alias("n_words"), F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("h1"))
    kept = (*kept, "n_words", "word_chars", "n_dup_lines")
    n = F.size("h1")
    three = two.select(*kept, pair_hashes("h1", 1, n - 1).alias("h2"))
    four = three.select(*kept, pair_hashes("h2", 2, F.size("h2") - 2).alias("h4"))
    five = four.select(*kept, pair_hashes("h4", 4, F.size("h4") - 4).alias("h8"))
    # Only texts that have a repeated window are sorted.
    repeats = F.size(F.array_distinct("h8")) < F.size("h8")
    six = five.select(*kept, F.when(repeats, F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    twice = F.filter("s", lambda x, i: (F.get("s", i + 1)["h"] == x["h"]) | (F.get("s", F.when(i > 0, i - 1).otherwise(F.size("s")))["h"] == x["h"]))
    seven = six.select(*kept, F.array_sort(F.transform(twice, lambda x: x["i"])).alias("at"))
    covered = F.aggregate(F.zip_with("at", F.slice("at", F.lit(2), F.greatest(F.size("at"), F.lit(1))), lambda a, b: F.least(F.lit(8), F.coalesce(b - a, F.lit(8)))), F.lit(0), lambda s, x: s + x)
    return seven.select(*kept, F.coalesce(F.when(F.size("at") > 0, covered), F.lit(0)).cast("bigint").alias("n_repeat_words"))


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    share = lambda x, of: F.log(1 + 20 * F.col(x) / of)
    values = (F.log(words), 3 * F.log(chars / words), share("n_symbols", words), F.log(1 + 5 * F.col("n_repeat_words") / words), share("n_upper", chars), share("n_points", words))
    return [F.round(1000 * v).cast("bigint").alias(n) for n, v in zip(VECTOR, values, strict=True)]


def _spread(columns: tuple[str, ...]) -> list[Column]:
    """Count, sums and sums of products: integers, so exact in any order."""
    out = [F.count(F.lit(1)).alias("m"), *[F.sum(c).alias(f"s_{c}") for c in columns]]
    return out + [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(columns) for b in columns[: i + 1]]


def _factor(groups: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Means and the lower Cholesky factor l_i_j of the covariance, with the floor on its diagonal."""
    m = F.col("m").cast("double")
    # Centred in integers first: m * p - s * s fits decimals, so nothing cancels.
    big = lambda c: F.col(c).cast("decimal(38,0)")
    cov = {(i, j): ((F.col("m").cast("decimal(18,0)") * F.col(f"p_{a}_{columns[j]}").cast("decimal(19,0)") - F.col(f"s_{a}").cast("decimal(18,0)") * F.col(f"s_{columns[j]}").cast("decimal(19,0)")).cast("double") / (m * m) + (FLOOR * FLOOR if i == j else 0.0)) for i, a in enumerate(columns) for j in range(i + 1)}
    out = groups.select("g_lang", "g_source", *[(F.col(f"s_{c}") / m).alias(f"c_{c}") for c in columns], *[v.alias(f"k_{i}_{j}") for (i, j), v in cov.items()])
    for i in range(len(columns)):
        for j in range(i + 1):
            rest = F.col(f"k_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return out.select("g_lang", "g_source", *[f"c_{c}" for c in columns], *[f"l_{i}_{j}" for i in range(len(columns)) for j in range(i + 1)])


def _distance(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """d2 from the factor's forward substitution."""
    for i, c in enumerate(columns):
        rest = F.col(c) - F.col(f"c_{c}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        rows = rows.withColumn(f"z_{i}", rest / F.col(f"l_{i}_{i}"))
    total = F.lit(0.0)
    for i in range(len(columns)):
        total = total + F.col(f"z_{i}") * F.col(f"z_{i}")
    return rows.withColumn("d2", total)


def _bin(d2: Column) -> Column:
    return F.floor(32 * F.log(1 + d2)).cast("int")


def _nearest(rows: DataFrame, share: float) -> DataFrame:
    """g_lang, g_source, edge: the bin up to which the nearest share of a group's rows reaches."""
    counts = rows.groupBy("g_lang", "g_source", "bin").agg(F.count(F.lit(1)).alias("n"))
    each = counts.groupBy("g_lang", "g_source").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("of"))  # a few hundred bins at most
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("int").alias("edge"))
    edge = F.aggregate("bins", start, lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.coalesce(a["edge"], F.when(a["n"] + x["n"] >= F.ceil(F.col("of") * share), x["bin"])).alias("edge")), lambda a: a["edge"])
    return each.select("g_lang", "g_source", edge.alias("edge"))


def mcd_outliers(rows: DataFrame, columns: tuple[str, ...] = VECTOR, *, share: float = 0.75, steps: int = 3, min_rows: int = 60, cut: float = CHI2_CUT, fits: str = "fits") -> DataFrame:
    """rows with `distance2` (null where nothing could be estimated) and `outlier`.

    rows: lang, source, the integer columns, and `fits` (whether a row may take part in the estimate).
    """
    names = [c for c in rows.columns if c not in ("distance2", "outlier")]
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    sizes = rows.where(fits).groupBy(key("lang").alias("g_lang"), key("source").alias("g_source")).agg(F.count(F.lit(1)).alias("of_group")).where(F.col("of_group") >= min_rows)
    tagged = rows.withColumns({"k_lang": key("lang"), "k_source": key("source")})
    tagged = tagged.join(sizes, (F.col("k_lang") == F.col("g_lang")) & (F.col("k_source") == F.col("g_source")), "left")
    tagged = tagged.withColumns({"g_lang": F.coalesce("g_lang", F.lit("*")), "g_source": F.coalesce("g_source", F.lit("*"))}).select(*names, "g_lang", "g_source")
    tagged = written(tagged, "vectors")
    base = tagged.where(fits)
    by = ["g_lang", "g_source"]
    # Values are whole thousandths of logarithms: exact medians need few distinct values each.
    mid = base.groupBy(*by).agg(*[F.expr(f"percentile({c}, 0.5)").alias(f"m_{c}") for c in columns])
    off = base.join(mid, by).groupBy(*by).agg(*[F.expr(f"percentile(abs({c} - m_{c}), 0.5)").alias(f"a_{c}") for c in columns])
    near = base.join(mid.join(off, by), by)
    d2 = F.lit(0.0)
    for c in columns:
        z = (F.col(c) - F.col(f"m_{c}")) / F.greatest(1.4826 * F.col(f"a_{c}"), F.lit(FLOOR))
        d2 = d2 + z * z
    near = near.withColumn("bin", _bin(d2))
    part = 0.5
    for step in range(steps + 1):
        chosen = near.join(_nearest(near, part), by).where(F.col("bin") <= F.col("edge"))
        factors = written(_factor(chosen.groupBy(*by).agg(*_spread(columns)).where(F.col("m") >= min_rows // 2), columns), "factors")
        near = _distance(base.join(factors, by), columns).withColumn("bin", _bin(F.col("d2")))
        part = share
    middle = _nearest(near, 0.5).select(*by, F.greatest((F.exp((F.col("edge") + 1) / 32) - 1) / CHI2_MEDIAN, F.lit(1e-6)).alias("scale"))
    judged = _distance(tagged.join(factors.join(middle, by), by, "left"), columns)
    return judged.select(*names, (F.col("d2") / F.col("scale")).alias("distance2"), F.coalesce(F.col("d2") / F.col("scale") > cut, F.lit(False)).alias("outlier"))


def judge_quality(docs: DataFrame, *, doc_id: str = "doc_id", **more) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance2, outlier, kept for each row of docs (doc_id, text, lang, source)."""
    named = docs.select(F.col(doc_id).alias("doc_id"), "lang", "source", "text")
    stats = statistics(named, ("doc_id", "lang", "source"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = stats.select("*", failed.alias("base_failed"), (~failed).alias("fits"), *_vector())
    out = mcd_outliers(written(rows, "statistics"), **more)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", (~F.col("base_failed") & ~F.col("outlier")).alias("kept"))
