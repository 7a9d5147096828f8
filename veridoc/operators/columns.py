"""Words of a line image by its column profile: ink runs, the gaps between them, and boxes, as windows over columns.

A column's energy is the sum over its rows of the difference between its neighbours on either side (at a border, itself).  A
map becomes one row a column, never one a pixel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranking import separator_gaps


def energies(h: Column, w: Column, data: Column) -> Column:
    """The energy of each column of a map (rows one after the other)."""

    def of(x: Column) -> Column:
        right, left = F.least(x + 1, w - 1), F.greatest(x - 1, F.lit(0))
        return F.aggregate(F.sequence(F.lit(0), h - 1), F.lit(0.0), lambda s, y: s + F.abs(F.get(data, y * w + right).cast("double") - F.get(data, y * w + left)))

    return F.transform(F.sequence(F.lit(0), w - 1), of)


def word_columns(maps: DataFrame, words: DataFrame, n_words: int, share: float = 0.15) -> DataFrame:
    """doc, word (from 1), x1, x2, split: columns of each of n_words words.

    maps: doc, h, w, data (h and w over 0).  words: doc, word, length (of its text).  Columns over `share` of the map's highest energy
    are ink.  Between the first and the last, gaps separate words: all of them if there are n_words - 1, of more those that
    separator_gaps names, and where there are fewer (split is false) words share the inked stretch (or, without ink,
    the line) in proportion to their lengths, at least 1 each.
    """
    columns = maps.select("doc", "w", F.posexplode(energies(F.col("h"), F.col("w"), F.col("data"))).alias("x", "energy"))
    top = F.max("energy").over(Window.partitionBy("doc"))
    ink = columns.withColumn("top", top).where((F.col("energy") > share * F.col("top")) & (F.col("top") > 0))
    ends = maps.select("doc", "w").join(ink.groupBy("doc").agg(F.min("x").alias("a"), (F.max("x") + 1).alias("b")), "doc", "left").select("doc", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", "w").alias("b"))
    before = F.lag("x").over(Window.partitionBy("doc").orderBy("x"))
    gaps = ink.select("doc", (before + 1).alias("begin"), F.col("x").alias("end")).where("end > begin")
    enough = gaps.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n_words - 1).select("doc")
    cuts = separator_gaps(gaps.join(enough, "doc", "left_semi"), ["doc"], "begin", "end", n_words - 1)
    # A word reaches from the end of one gap to the beginning of the next.
    begins = cuts.select("doc", F.col("end").alias("x1")).unionByName(ends.join(enough, "doc", "left_semi").select("doc", F.col("a").alias("x1")))
    stops = cuts.select("doc", F.col("begin").alias("x2")).unionByName(ends.join(enough, "doc", "left_semi").select("doc", F.col("b").alias("x2")))
    numbered = lambda df, c: df.withColumn("word", F.row_number().over(Window.partitionBy("doc").orderBy(c)))
    split = numbered(begins, "x1").join(numbered(stops, "x2"), ["doc", "word"]).select("doc", "word", "x1", "x2", F.lit(True).alias("split"))
    sized = words.where(F.col("word").between(1, n_words)).select("doc", "word", F.greatest(F.lit(1), "length").alias("l")).join(ends, "doc").join(enough, "doc", "left_anti")
    w = Window.partitionBy("doc")
    upto, total = F.sum("l").over(w.orderBy("word")), F.sum("l").over(w)
    place = lambda c: F.floor(F.col("a") + (F.col("b") - F.col("a")) * c / total).cast("int")
    shared = sized.select("doc", "word", place(upto - F.col("l")).alias("x1"), place(upto).alias("x2"), F.lit(False).alias("split"))
    return split.unionByName(shared)
