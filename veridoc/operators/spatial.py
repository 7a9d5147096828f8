"""Spatial joins of boxes inside documents, best matches, and exact pixel counts by coordinate compression.

Boxes meet on their document and on the cells of a grid that they touch, so each join is a hash join whose keys stay small
even in a document with very many boxes; a pair that shares several cells is kept in one of them only.  Nothing is compared
across documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import Box, intersection_over_min, iou, overlap_fraction, union_box

DOC = "doc"
#: Edge of the grid's cells in pixels.  A box takes (width / CELL + 2) * (height / CELL + 2) cells at most.
CELL = 256


def renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(DOC, *[F.col(c).alias(prefix + c) for c in df.columns if c != DOC])


def _cells(df: DataFrame, prefix: str, cell: int) -> DataFrame:
    at = lambda c: F.floor(F.col(prefix + c) / cell)
    area = df.where((F.col(f"{prefix}x2") > F.col(f"{prefix}x1")) & (F.col(f"{prefix}y2") > F.col(f"{prefix}y1")))
    return area.withColumn("cell_x", F.explode(F.sequence(at("x1"), at("x2")))).withColumn("cell_y", F.explode(F.sequence(at("y1"), at("y2"))))


def overlapping(a: DataFrame, b: DataFrame, left: str, right: str, cell: int = CELL) -> DataFrame:
    """The pairs of boxes of a document that share an area, each once, with the columns of both under their prefixes.

    Candidates are the pairs that share a cell; the one that holds the upper left corner of the shared area keeps the pair.
    Boxes without area, and with nulls, meet nothing.
    """
    met = _cells(renamed(a, left), left, cell).join(_cells(renamed(b, right), right, cell), [DOC, "cell_x", "cell_y"])
    for axis in "xy":
        begin, l2, r2 = F.greatest(f"{left}{axis}1", f"{right}{axis}1"), F.col(f"{left}{axis}2"), F.col(f"{right}{axis}2")
        met = met.where((begin < l2) & (begin < r2) & (F.col(f"cell_{axis}") == F.floor(begin / cell)))
    return met.drop("cell_x", "cell_y")


def region_words(regions: DataFrame, words: DataFrame, least: float = 0.4, k: int | None = None) -> DataFrame:
    """doc, region, words: for each region the words whose own area it covers to `least`, the best covered first.

    regions: doc, region, box; words: doc, id, text, box.  Regions without words keep an empty list.
    """
    fraction = overlap_fraction(Box.of("r_"), Box.of("w_"))
    hits = overlapping(regions, words, "r_", "w_").withColumn("fraction", fraction).where(F.col("fraction") >= least)
    entry = F.struct((-F.col("fraction")).alias("minus"), F.col("w_id").alias("id"), F.col("w_text").alias("text"), F.col("fraction").alias("overlap_frac"))
    lists = hits.groupBy(DOC, F.col("r_region").alias("region")).agg(F.array_sort(F.collect_list(entry)).alias("words"))
    best = F.slice("words", 1, k) if k else F.col("words")
    lists = lists.select(DOC, "region", F.transform(best, lambda e: F.struct(e["id"].alias("id"), e["text"].alias("text"), e["overlap_frac"].alias("overlap_frac"))).alias("words"))
    kind = dict(lists.dtypes)["words"]
    return regions.join(lists, [DOC, "region"], "left").withColumn("words", F.coalesce("words", F.array().cast(kind)))


def touching(masks: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """doc, mask, hits: ordered keys of the boxes that overlap each mask region; empty lists are kept."""
    hits = overlapping(masks, others, "m_", "o_").where(iou(Box.of("m_"), Box.of("o_")) > 0)
    lists = hits.groupBy(DOC, F.col("m_mask").alias("mask")).agg(F.array_sort(F.collect_list(F.col(f"o_{key}"))).alias("hits"))
    return masks.select(DOC, "mask").join(lists, [DOC, "mask"], "left").withColumn("hits", F.coalesce("hits", F.array().cast(dict(lists.dtypes)["hits"])))


def true_positives(regions: DataFrame, masks: DataFrame, least: float = 0.05) -> DataFrame:
    """regions with tp: whether any mask box shares `least` of the smaller area."""
    hit = overlapping(regions, masks, "r_", "m_").where(intersection_over_min(Box.of("r_"), Box.of("m_")) >= least).select(DOC, F.col("r_region").alias("region")).distinct().withColumn("tp", F.lit(True))
    return regions.join(hit, [DOC, "region"], "left").withColumn("tp", F.coalesce("tp", F.lit(False)))


def best_match(items: DataFrame, candidates: DataFrame, score: Callable[[Box, Box], Column], least: float, strict: bool = False) -> DataFrame:
    """doc, item, best (candidate, box), score: each item's highest-scoring candidate, the first of equals.

    One aggregation (max_by), so no item's candidates are sorted.  items: doc, item, box; candidates: doc, candidate, box.
    Boxes that share no area never match, whatever `least` is.
    """
    met = overlapping(items, candidates, "i_", "c_").withColumn("score", score(Box.of("i_"), Box.of("c_")))
    met = met.where(F.col("score") > least if strict else F.col("score") >= least)
    best = F.max_by(F.struct(F.col("c_candidate").alias("candidate"), *Box.of("c_").named()), F.struct("score", -F.col("c_candidate")))
    return met.groupBy(DOC, F.col("i_item").alias("item")).agg(best.alias("best"), F.max("score").alias("score"))


def refine(items: DataFrame, masks: DataFrame, least: float = 0.10) -> DataFrame:
    """items with `new` (the mask box of largest shared area, if enough) and `moved`."""
    best = best_match(items, masks, intersection_over_min, least)
    out = items.join(best, [DOC, "item"], "left")
    own = F.struct(*Box.of().named())
    return out.select(*items.columns, F.coalesce(F.when(F.col("best").isNotNull(), F.struct(*[F.col(f"best.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])), own).alias("new"), F.col("best").isNotNull().alias("moved"))


def best_single_or_pair(items: DataFrame, candidates: DataFrame, least: float) -> DataFrame:
    """doc, item, box, score, parts: the best candidate by IoU (over `least`), or the union of two such if strictly better.

    Pairs are formed among an item's own candidates only.  Of equals a single comes first, then the lower places.
    """
    met = overlapping(items, candidates, "i_", "c_").withColumn("score", iou(Box.of("i_"), Box.of("c_"))).where(F.col("score") > least)
    met = met.select(DOC, F.col("i_item").alias("item"), *Box.of("i_").named("i_"), F.col("c_candidate").alias("candidate"), *Box.of("c_").named(), "score")
    single = met.select(DOC, "item", F.struct(*Box.of().named()).alias("box"), "score", F.array("candidate").alias("parts"))
    a = met.select(DOC, "item", *[F.col(f"i_{c}") for c in ("x1", "y1", "x2", "y2")], F.col("candidate").alias("ca"), *Box.of().named("a_"))
    b = met.select(DOC, "item", F.col("candidate").alias("cb"), *Box.of().named("b_"))
    joined = a.join(b, [DOC, "item"]).where("ca < cb")
    union = union_box(Box.of("a_"), Box.of("b_"))
    pair = joined.select(DOC, "item", F.struct(*union.named()).alias("box"), iou(Box.of("i_"), union).alias("score"), F.array("ca", "cb").alias("parts"))
    order = F.struct("score", -F.size("parts"), F.transform("parts", lambda p: -p))
    return single.unionByName(pair).groupBy(DOC, "item").agg(F.max_by(F.struct("box", "score", "parts"), order).alias("b")).select(DOC, "item", "b.box", "b.score", "b.parts")


def _covered(spans: Column) -> Column:
    """The length that intervals (y1, y2) cover: sorted by their begin, each adds what lies beyond the furthest end so far."""
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-(1 << 31)).cast("bigint").alias("to"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("bigint"), s["y2"] - F.greatest(a["to"], s["y1"]))).alias("n"), F.greatest(a["to"], s["y2"]).alias("to"))
    return F.aggregate(F.array_sort(spans), none, step, lambda a: a["n"])


def pixel_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc, tp, fp, fn: pixels in both, only in b and only in a, for two families of integer boxes.

    A document's left and right edges cut the plane into strips; in each strip a box is an interval, and the lengths that
    the families cover alone and together are found by merging intervals.  Exact, and neither raster nor cells are made.
    """
    both = a.select(DOC, "x1", "y1", "x2", "y2", F.lit(1).alias("side")).unionByName(b.select(DOC, "x1", "y1", "x2", "y2", F.lit(2).alias("side"))).where("x2 > x1 AND y2 > y1")
    xs = both.select(DOC, F.explode(F.array("x1", "x2")).alias("x")).distinct()
    strips = xs.withColumn("xe", F.lead("x").over(Window.partitionBy(DOC).orderBy("x"))).where("xe IS NOT NULL")
    span = F.struct(F.col("y1").cast("bigint").alias("y1"), F.col("y2").cast("bigint").alias("y2"))
    in_strip = both.join(strips, DOC).where("x1 <= x AND x2 >= xe")
    lists = in_strip.groupBy(DOC, "x", "xe").agg(F.collect_set(F.when(F.col("side") == 1, span)).alias("of_a"), F.collect_set(F.when(F.col("side") == 2, span)).alias("of_b"))
    sized = lists.select(DOC, (F.col("xe") - F.col("x")).cast("bigint").alias("width"), _covered(F.col("of_a")).alias("in_a"), _covered(F.col("of_b")).alias("in_b"), _covered(F.array_union("of_a", "of_b")).alias("in_any"))
    total = lambda c: F.sum(F.col("width") * c)
    return sized.groupBy(DOC).agg(total(F.col("in_a") + F.col("in_b") - F.col("in_any")).alias("tp"), total(F.col("in_any") - F.col("in_a")).alias("fp"), total(F.col("in_any") - F.col("in_b")).alias("fn"))
