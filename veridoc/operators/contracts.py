"""Contracts for outside models: functions over batches, loaded once in each Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

_LOADED: dict[str, object] = {}


def once(name: str, load: Callable[[], object]) -> object:
    """A model of this worker."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def mock_judge(prompt: str) -> str:
    return '{"factuality": 75, "reasoning": 70, "completeness": 65}'


def judge(prompt: Column, ask: Callable[[str], str] = mock_judge) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(ask, na_action="ignore")

    return run(prompt)


def token_count(text: Column, count: Callable[[str], int] = lambda t: len(t.split())) -> Column:
    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return s.fillna("").map(count)

    return run(text)


def generate(df: DataFrame, prompt: str, load: Callable[[], Callable[[list[str]], list[str]]], name: str, batch: int = 16) -> DataFrame:
    """df with `output` and `error`: batches of prompts, and one by one where a batch fails."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", output string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = once(name, load)
        for f in frames:
            out, errors = [], []
            for i in range(0, len(f), batch):
                prompts = f[prompt].iloc[i : i + batch].tolist()
                try:
                    got = model(prompts)
                    bad = [None] * len(got)
                except Exception:
                    got, bad = [], []
                    for p in prompts:
                        try:
                            got.append(model([p])[0])
                            bad.append(None)
                        except Exception as e:
                            got.append(None)
                            bad.append(str(e))
                out += got
                errors += bad
            yield f.assign(output=out, error=errors)

    return df.mapInPandas(run, schema)


def detect(images: DataFrame, load: Callable[[], Callable], name: str = "detector") -> DataFrame:
    """stem, h, w, data: probability maps of images (stem, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = once(name, load)
        for f in frames:
            maps = [model(c) for c in f["content"]]
            yield pd.DataFrame({"stem": f["stem"], "h": [m.shape[0] for m in maps], "w": [m.shape[1] for m in maps], "data": [m.ravel().tolist() for m in maps]})

    return images.select("stem", "content").mapInPandas(run, "stem string, h int, w int, data array<float>")


def read_words(images: DataFrame, load: Callable[[], Callable], languages: tuple[str, ...], enough: float = 0.90, name: str = "ocr") -> DataFrame:
    """stem, lang, score, items: the first language whose score suffices ends the search, else the best one counts."""
    items = "array<struct<id:int,text:string,x1:int,y1:int,x2:int,y2:int,confidence:double>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = once(name, load)
        for f in frames:
            out = []
            for stem, content in zip(f["stem"], f["content"], strict=True):
                best: tuple = (-1.0, -1, None, [])
                for lang in languages:
                    words = model(content, lang)
                    weights = [max(1, len(w["text"])) for w in words]
                    score = sum(w["confidence"] * k for w, k in zip(words, weights, strict=True)) / max(1, sum(weights))
                    if (score, len(words)) > best[:2]:
                        best = (score, len(words), lang, words)
                    if score >= enough:
                        break
                out.append((stem, best[2], best[0], best[3]))
            yield pd.DataFrame(out, columns=["stem", "lang", "score", "items"])

    return images.select("stem", "content").mapInPandas(run, f"stem string, lang string, score double, items {items}")
