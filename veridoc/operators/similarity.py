"""Similarity of texts by their words' best matches: precision, recall and F per pair, averaged over aligned chunks.

In place of a model's vectors a word is its set of letter trigrams (with its borders), and two words' similarity is the Dice
coefficient of these sets, 0 below `least`.  A candidate's precision is the mean over its words of the best similarity to a reference
word of the same chunk; recall is the same from the reference; repeated words count as often as they stand there.

A pair of texts stands in one row, so nothing is shuffled: Spark cuts the words, a helper matches them chunk by chunk in Arrow batches.
No word meets all others: equal words match at once, the rest through an index of trigrams.  Of a word only as many of its
first trigrams (in order) are indexed as it could lack and still reach `least`; only words that share one of those are compared.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import budget

WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


@lru_cache(100_000)
def trigrams(word: str) -> frozenset[str]:
    """Distinct trigrams of a word between marks."""
    marked = f"^{word}$"
    return frozenset(marked[i : i + 3] for i in range(len(word)))


@lru_cache(100_000)
def leading(word: str, least: float) -> tuple[str, ...]:
    """Trigrams of which words that reach `least` share one: it takes so many shared ones at least, whatever the other word's size."""
    grams = sorted(trigrams(word))
    shared = max(1, math.ceil(least / (2 - least) * len(grams) - 1e-9))
    return tuple(grams[: len(grams) - shared + 1])


def _matched(words: Iterable[str], others: Iterable[str], least: float) -> dict[str, float]:
    """The best similarity of each word to any other one; 1 for equal words."""
    index = defaultdict(list)
    for o in others:
        for g in leading(o, least):
            index[g].append(o)
    out = {}
    for w in words:
        mine = trigrams(w)
        near = {w} if w in others else {o for g in leading(w, least) for o in index.get(g, ())}
        alike = max((2.0 * len(mine & trigrams(o)) / (len(mine) + len(trigrams(o))) for o in near), default=0.0)
        out[w] = alike if alike >= least - 1e-9 else 0.0
    return out


def _scored(reference: str, candidate: str, least: float) -> tuple[float, float, float]:
    """Precision, recall and F of two chunks, given as words between blanks."""
    r, c = Counter(reference.split()), Counter(candidate.split())
    if not r or not c:
        return 0.0, 0.0, 0.0
    mean = lambda n, best: sum(k * best[w] for w, k in n.items()) / n.total()
    precision, recall = mean(c, _matched(c, r, least)), mean(r, _matched(r, c, least))
    return precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def chunk_similarity(pairs: DataFrame, by: list[str], reference: str, candidate: str, least: float = 0.5) -> DataFrame:
    """by, n_chunks, precision, recall, f1 of arrays of chunks, aligned by position; the shorter side is padded with empty chunks,
    which match nothing.  by: columns that tell the pairs apart.  Nulls count as no chunks."""

    @F.pandas_udf("struct<precision:double,recall:double,f1:double>")
    def score(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(left, right, strict=True):
            each = [_scored(x, y, least) for x, y in zip(a, b)]  # noqa: B905
            rows.append([sum(s) / max(len(a), len(b)) for s in zip(*each, strict=True)] if each else [0.0] * 3)
        return pd.DataFrame(rows, columns=["precision", "recall", "f1"])

    cut = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.array_join(words(t), " "))
    sides = pairs.select(*by, cut(F.col(reference)).alias("_ref"), cut(F.col(candidate)).alias("_cand"))
    return sides.select(*by, F.greatest(F.size("_ref"), F.size("_cand")).alias("n_chunks"), score("_ref", "_cand").alias("_s")).select(*by, "n_chunks", "_s.*")


def text_similarity(pairs: DataFrame, by: list[str], reference: str, candidate: str, *, most: int = 1000, least: float = 0.5) -> DataFrame:
    """by, n_chunks, precision, recall, f1 of two texts, cut into chunks of at most `most` characters."""
    cut = budget.chunked(budget.chunked(pairs.select(*by, F.col(reference).alias("_a"), F.col(candidate).alias("_b")), "_a", most).withColumnRenamed("chunks", "_ca"), "_b", most)
    return chunk_similarity(cut.select(*by, "_ca", F.col("chunks").alias("_cb")), by, "_ca", "_cb", least)
