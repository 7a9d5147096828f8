"""Benchmark decontamination: a prefix-filtered set join of item-sized windows with whole documents.

Each item gives its windows: `window` consecutive words, or all words of a shorter item.  Containment must be whole, so
the necessary prefix of a window under an order of its words by rarity is its one rarest word.  Words are counted
over all documents (only words that some item has, summed before the shuffle).  Documents' words then join the rarest
words; the rarest word's place in its window fixes where the window would have to start (positional bound), and it must
end inside the document (length bound).  What is left is verified word by word against the document's own words, in
the same stage.  Only true occurrences leave it, so a hot document, item or word never sends candidate pairs through a
shuffle.

Broadcast: the windows (`window` words each), up to `broadcast_windows` of them (counted first); beyond that the places of
words are shuffled to them on the rare word, without the texts (an adaptive, splittable join), and the places that fit get
their text by document.

Defined cases: null texts have no words; texts of any length are taken whole; of equally rare words the first in the
alphabet counts; repeated document rows each return a row with the same figures; items without
words have no windows; equal items are all named; an empty benchmark or document table gives no hits or no rows; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import UPPER, dropped, text_of, written

#: Characters between words: ASCII but for digits and letters.  Capitals are word characters before lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def bench_words(text: Column) -> Column:
    """Words in their own case; lower-casing A-Z doesn't move their borders."""
    return F.array_remove(F.split(text, BETWEEN, -1), "")


def low(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def item_windows(items: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """words, item_ids: each distinct window once, with all items that have it."""
    words = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item_id"), bench_words(low(text_of(text))).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    one = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("window"))
    return one.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def contained_windows(docs: DataFrame, items: DataFrame, *, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_windows: int = 200_000) -> DataFrame:
    """doc_id, copy (hash of the text), start (from 0), size, item_ids: every occurrence of a window in a document."""
    windows = written(item_windows(items, window, item_id, item_text), "windows")
    few = windows.count() <= broadcast_windows
    small = F.broadcast if few else (lambda x: x)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    own = windows.select(F.explode("window").alias("word")).select(F.lower("word").alias("key")).distinct()
    seen = rows.select(F.explode(bench_words(F.col("text"))).alias("word")).select(F.lower("word").alias("key"))
    counted = seen.join(small(own), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    numbered = windows.select("window", "item_ids", F.posexplode("window").alias("place", "word")).withColumn("key", F.lower("word"))
    rarity = numbered.join(counted, "key").groupBy("window").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("n", "key", "place")).alias("rare"), F.first("item_ids").alias("item_ids"))
    # A window that has a word no document has occurs nowhere.
    needed = written(rarity.where(F.col("found") == F.size("window")).select("window", F.size("window").alias("size"), "item_ids", F.col("rare.key").alias("key"), F.col("rare.place").alias("place")), "rarest")
    dropped(windows)
    of = rows.select("doc_id", F.xxhash64("text").alias("copy"), bench_words(F.col("text")).alias("words"))
    at = lambda *more: of.select("doc_id", "copy", *more, F.posexplode("words").alias("at", "word")).withColumn("key", F.lower("word"))
    start = F.col("at") - F.col("place")
    if few:
        met = at("words").join(F.broadcast(needed), "key")
    else:
        # Places meet the rare words without their texts; the few that do get their text again by document.
        spots = at(F.size("words").alias("n_words")).select("doc_id", "copy", "at", "key", "n_words").join(needed, "key").where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
        met = spots.drop("n_words").join(of.dropDuplicates(["doc_id", "copy"]), ["doc_id", "copy"])
    bounded = met.where((start >= 0) & (start + F.col("size") <= F.size("words")))
    same = F.slice("words", start + 1, F.col("size"))
    return bounded.where(low(F.array_join(same, " ")) == F.array_join("window", " ")).select("doc_id", "copy", start.alias("start"), "size", "item_ids")


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """doc_id, n_words, spans (array of [start, end) word ranges), n_hit, item_ids (sorted strings), contaminated; a row for each row of docs."""
    hits = contained_windows(docs, items, window=window, doc_id=doc_id, text=text, **more)
    ranges = hits.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("found"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
    # Ranges sorted by start: each adds the words beyond the furthest end so far.
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    covered = F.aggregate("found", begin, lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(a["to"], x["start"]), F.lit(0))).alias("n"), F.greatest(a["to"], x["end"]).alias("to")), lambda a: a["n"])
    hit = ranges.select("doc_id", "copy", "found", "item_ids", covered.cast("bigint").alias("n_hit"))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("copy"), F.size(bench_words(text_of(text))).cast("bigint").alias("n_words"))
    both = base.join(hit.withColumnRenamed("doc_id", "hit_id").withColumnRenamed("copy", "hit_copy"), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("copy") == F.col("hit_copy")), "left")
    none = F.array().cast("array<string>")
    return both.select("doc_id", "n_words", F.col("found").alias("spans"), F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
