"""Quality by co-training: a classifier of text contents and one of page metadata teach each other.

Fit, on a bounded sample of labelled rows (`labelled` of each label, by hash order) and a bounded pool of unlabelled ones
(`pool`): in each round both views score the pool, and each passes its most confident pseudo-labels (in the proportion of the
labels, only where it is surer than the other view) to the other view's training rows.  Afterwards each view is calibrated
on labelled rows that took no part in its training, and a last small model combines the two calibrated log-odds.

Text view: hashed words and word shapes (log counts), of unit length, so no sizes.  Metadata view: language and source
(hashed), sizes of the text and of its lines; nothing of what is written in them.

Score: every row of the table, whole texts, in Arrow batches; no shuffle.  The model is a few hundred kilobytes.

Defined cases: null text counts as empty; null language and source are values of their own; empty texts get a score from
metadata; very long texts are read whole; ties of a sample's hash go by doc_id; without labelled rows of both kinds every score is the share of good rows (1 if none); repeated rows each
return a row; an empty table returns no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .fitting import fit_logistic, fit_sparse_logistic, sigmoid

DIMS = 1 << 15
_WORD = re.compile(r"\S+")


class Hasher:
    """Columns of words, remembered up to a bound."""

    def __init__(self, bound: int = 300_000):
        self.bound, self.known = bound, {}

    def __call__(self, word: str) -> int:
        known = self.known
        if word not in known:
            if len(known) > self.bound:
                known.clear()
            known[word] = zlib.crc32(word.encode()) % DIMS
        return known[word]


def text_view(text: str, column: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values, of unit length: words with their log counts, and which share of the words repeats the last one."""
    words = _WORD.findall(text)
    counts: Counter = Counter()
    for w, n in Counter(words).items():
        counts[column(w.lower())] += n
        counts[column("shape " + ("A" if w.isupper() else "a") + ("" if w[-1:].isalnum() else w[-1:]))] += n
    same = sum(map(str.__eq__, words, words[1:]))
    counts[column("repeat " + str(round(10 * same / max(len(words), 1))))] += 1
    at = np.fromiter(counts.keys(), np.int64, len(counts))
    v = np.log1p(np.fromiter(counts.values(), float, len(counts)))
    return at, v / max(np.linalg.norm(v), 1e-9)


def metadata_view(text: str, lang: str | None, source: str | None) -> np.ndarray:
    """Language and source, one of 8 and of 32 hashed places, and sizes: of the text, of its lines, how many; no characters of words."""
    sizes = [len(line) for line in text.split("\n")]
    one_hot = np.zeros(40)
    one_hot[zlib.crc32(f"lang {lang}".encode()) % 8] = 1
    one_hot[8 + zlib.crc32(f"source {source}".encode()) % 32] = 1
    shape = np.log1p([len(text), len(sizes), max(sizes), min(sizes), sum(sizes) / len(sizes)])
    return np.r_[shape, shape**2 / 10, one_hot]


class CoTrained:
    def __init__(self):
        self.text = self.meta = self.shift = self.scale = self.joint = np.zeros(0)
        self.text_cal = self.meta_cal = np.zeros(0)
        self.share = 1.0

    def _odds(self, texts: list, metas: np.ndarray) -> np.ndarray:
        t = np.array([v @ self.text[at] + self.text[-1] for at, v in texts])
        m = np.c_[(metas - self.shift) / self.scale, np.ones(len(metas))] @ self.meta
        return np.c_[np.clip(t, -12, 12), np.clip(m, -12, 12)]

    def _train(self, texts: list, metas: np.ndarray, y: np.ndarray, sure_t: dict[int, float], sure_m: dict[int, float], own: np.ndarray) -> None:
        rows = np.r_[own, np.array(sorted(sure_t), int)]
        self.text = fit_sparse_logistic([texts[i] for i in rows], np.r_[y[own], [sure_t[i] for i in sorted(sure_t)]], DIMS)
        rows = np.r_[own, np.array(sorted(sure_m), int)]
        x = metas[rows]
        self.shift, self.scale = x.mean(0), np.maximum(x.std(0), 1e-2)
        self.meta = fit_logistic((x - self.shift) / self.scale, np.r_[y[own], [sure_m[i] for i in sorted(sure_m)]], l2=3.0)

    def fit(self, labelled: list[tuple], pool: list[tuple], share: float, rounds: int = 3, per_round: float = 0.1) -> CoTrained:
        """labelled: (text, lang, source, label); pool: (text, lang, source, anything)."""
        self.share = share
        y = np.array([r[3] for r in labelled], float)
        if len(set(y)) < 2 or min((y == 0).sum(), (y == 1).sum()) < 6:
            return self
        column = Hasher()
        every = [*labelled, *pool]
        texts = [text_view(r[0] or "", column) for r in every]
        metas = np.array([metadata_view(r[0] or "", r[1], r[2]) for r in every])
        held = np.arange(len(y)) % 3 == 0
        own, free = np.flatnonzero(~held), np.arange(len(y), len(every))
        sure_t: dict[int, float] = {}
        sure_m: dict[int, float] = {}
        self._train(texts, metas, y, sure_t, sure_m, own)
        for _ in range(rounds if len(free) else 0):
            odds = self._odds([texts[i] for i in free], metas[free])
            n = max(1, int(per_round * len(free)))
            for giver, takers in ((0, sure_m), (1, sure_t)):
                for label, part in ((1.0, share), (0.0, 1 - share)):
                    strength = odds[:, giver] if label else -odds[:, giver]
                    other = odds[:, 1 - giver] if label else -odds[:, 1 - giver]
                    sure = np.flatnonzero((strength > 2) & (strength > other))
                    for k in sure[np.argsort(-strength[sure], kind="stable")][: max(1, int(n * part))]:
                        takers.setdefault(int(free[k]), label)
            self._train(texts, metas, y, sure_t, sure_m, own)
        odds = self._odds([texts[i] for i in np.flatnonzero(held)], metas[: len(y)][held])
        # Labels were sampled evenly; the weights bring back their shares.
        weights = np.where(y[held] == 1, share / y[held].mean(), (1 - share) / (1 - y[held].mean()))
        self.text_cal = fit_logistic(odds[:, :1], y[held], weights=weights)
        self.meta_cal = fit_logistic(odds[:, 1:], y[held], weights=weights)
        self.joint = fit_logistic(self._calibrated(odds), y[held], weights=weights)
        return self

    def _calibrated(self, odds: np.ndarray) -> np.ndarray:
        return np.c_[odds[:, 0] * self.text_cal[0] + self.text_cal[1], odds[:, 1] * self.meta_cal[0] + self.meta_cal[1]]

    def scores(self, rows: list[tuple], column: Hasher) -> np.ndarray:
        """Per row: text view, metadata view, both."""
        if not len(self.joint):
            return np.full((len(rows), 3), self.share)
        odds = self._odds([text_view(r[0] or "", column) for r in rows], np.array([metadata_view(r[0] or "", r[1], r[2]) for r in rows]))
        z = self._calibrated(odds)
        return sigmoid(np.c_[z, np.c_[z, np.ones(len(z))] @ self.joint])


def fitted(docs: DataFrame, labels: DataFrame, *, label: str = "quality", labelled: int = 1200, pool: int = 3000) -> CoTrained:
    """A model from bounded samples in hash order: `labelled` rows of each label, `pool` rows without one."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled) for y in (0, 1)]
    # The pool: least hashes first, of documents outside the labels.
    candidates = docs.select("doc_id").where(F.col("doc_id").isNotNull()).join(labels.select("doc_id"), "doc_id", "left_anti").distinct()
    free = candidates.orderBy(F.xxhash64("doc_id"), "doc_id").limit(pool).withColumn("y", F.lit(None).cast(dict(known.dtypes)["y"]))
    wanted = chosen[0].unionByName(chosen[1]).unionByName(free)
    rows = docs.select("doc_id", "text", "lang", "source").join(F.broadcast(wanted), "doc_id")
    got = sorted(rows.groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang", "source")).alias("r")).select("doc_id", "y", "r.*").collect(), key=lambda r: r["doc_id"])
    total = sum(counts.values())
    return CoTrained().fit([(r["text"], r["lang"], r["source"], r["y"]) for r in got if r["y"] is not None], [(r["text"], r["lang"], r["source"], None) for r in got if r["y"] is None], counts.get(1, 0) / total if total else 1.0)


def score_documents(docs: DataFrame, model: CoTrained, portion: int = 1_000_000) -> DataFrame:
    """doc_id, text_score, metadata_score, score (good likelier the higher) and predicted for each row of docs; portion: characters scored at once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = Hasher()
        for batch in batches:
            made, held, size = [np.zeros((0, 3))], [], 0
            for r in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                held.append(tuple(v.as_py() for v in r))
                size += len(held[-1][0] or "")
                if size > portion:
                    made.append(shared.value.scores(held, column))
                    held, size = [], 0
            if held:
                made.append(shared.value.scores(held, column))
            s = np.concatenate(made)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s[:, i]) for i in range(3)), pa.array((s[:, 2] >= 0.5).astype(np.int32))], names=["doc_id", "text_score", "metadata_score", "score", "predicted"])

    rows = docs.select("doc_id", "text", "lang", "source")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text_score double, metadata_score double, score double, predicted int")
