"""Order-dependent text folds: chunking, alignment and length fitting."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


#: Where a section begins, and what ends a sentence.
SECTION, SENTENCE_END = r"\n(?=#{1,3} )", r"(?<=[.!?])\s+"


def _packed(sentences: list[str], most: int) -> Iterator[str]:
    """Runs of sentences, each as long as fits; the furthest sentence of a run is found in the running lengths."""
    upto = [0, *accumulate(len(s) + 1 for s in sentences)]
    i = 0
    while i < len(sentences):
        j = bisect_right(upto, upto[i] + most + 1) - 1
        if j > i:
            yield " ".join(sentences[i:j])
        else:
            j = i + 1
            yield from (sentences[i][k : k + most] for k in range(0, len(sentences[i]), most))
        i = j


def chunks(text: str, most: int = 1000) -> list[str]:
    """Pieces of at most `most` characters: whole sections where they fit, else runs of sentences, else plain cuts."""
    text = text.strip()
    if len(text) <= most:
        return [text]
    borders = [0, *(m.start() for m in re.finditer(SECTION, text)), len(text)]
    out: list[str] = []
    for a, b in pairwise(borders):
        section = text[a:b]
        if len(section) <= most:
            out += [section] if section.strip() else []
        else:
            out += _packed(re.split(SENTENCE_END, section.strip()), most)
    return out


def chunked(df: DataFrame, text: str, most: int = 1000) -> DataFrame:
    """df with `chunks`."""

    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda t: chunks(t, most))

    return df.withColumn("chunks", split(text))


def aligned(left: Column, right: Column) -> Column:
    """Pairs of chunks; the shorter side is padded with empty text."""
    return F.zip_with(left, right, lambda a, b: F.struct(F.coalesce(a, F.lit("")).alias("a"), F.coalesce(b, F.lit("")).alias("b")))


#: Fixed values of the fitting rule: characters a token takes at least, the surplus of a cut as factor and constant.
LEAST_PER_TOKEN, SURPLUS, EXTRA = 2.0, 1.10, 32
STATUS = {(False, False): "none", (True, False): "prompt_truncated", (False, True): "target_truncated", (True, True): "both_truncated"}


def _shrunk(text: str, least: int, rounds: int, over: Callable[[str], int], tokens: Callable[[str], int], cut: Callable[[str, int], str]) -> tuple[str, bool]:
    """text cut until nothing is over, its floor is reached or the rounds are used up; whether it was cut."""
    left, length = rounds, None
    while left and length != least and (excess := over(text)) > 0:
        per_token = max(LEAST_PER_TOKEN, len(text) / max(1, tokens(text)))
        length = max(least, len(text) - EXTRA - math.ceil(SURPLUS * excess * per_token))
        text, left = cut(text, length), left - 1
    return text, left < rounds


def fit_pair(prompt: str, target: str, count: Callable[[str], int], longest: int, *, fixed: int = 0, least_prompt: int = 64, least_target: int = 64, rounds: int = 6) -> tuple[str, str, str] | None:
    """Prompt, target and status within `longest` tokens: the prompt loses its end, then the target its beginning; None if
    both floors don't suffice."""
    total = lambda p, t: fixed + count(p) + count(t)
    p, cut_p = _shrunk(prompt, least_prompt, rounds, lambda p: total(p, target) - longest, lambda p: fixed + count(p), lambda p, n: p[:n].rstrip())
    t, cut_t = _shrunk(target, least_target, rounds, lambda t: total(p, t) - longest, count, lambda t, n: t[-n:].lstrip())
    return None if total(p, t) > longest else (p, t, STATUS[cut_p, cut_t])


def fitted_pairs(df: DataFrame, prompt: str, target: str, longest: int, count: Callable[[str], int] = lambda t: len(t.split()), **more) -> DataFrame:
    """df with `fitted` struct(prompt, target, status); null where nothing fits."""

    @F.pandas_udf("struct<prompt:string,target:string,status:string>")
    def run(p: pd.Series, t: pd.Series) -> pd.DataFrame:
        rows = [fit_pair(a or "", b or "", count, longest, **more) or (None, None, "too_long") for a, b in zip(p, t, strict=True)]
        return pd.DataFrame(rows, columns=["prompt", "target", "status"])

    return df.withColumn("fitted", run(prompt, target))
