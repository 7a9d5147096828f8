"""Toxicity by compression distance: two zstandard dictionaries, trained on toxic and on ordinary text.

Fit, on a bounded sample of labelled rows (`sample` of each label, by hash order), in halves.  The first half trains three
dictionaries with zstandard's own trainer: a base on ordinary text, which both sides share (what all text has then costs
both the same, and only what the kinds of text differ in is left); one on windows of toxic text; one on as many windows of
ordinary text.  Toxic rows are mostly ordinary text, so the toxic windows are those whose middle word begins as words do
in far more toxic than ordinary texts (a text counts for a word in a context that no earlier one had, so copies count
once); without any such word all windows are taken.  The second half gives the calibration: a logistic model over the
document's window distances.

Score: the whole text is cut into windows of a few words; each is compressed with the base and either dictionary, and the
distance is the difference of the two lengths.  Windows are so short that a compressor would store them plainly, so a
fixed primer that both sides know comes first.  A document's features are how many and which share of its windows
reach each distance (thresholds 1 to `DEPTH`), calibrated to a probability.

Scale: dictionaries and model are some tens of kilobytes, and scoring is one pass in Arrow batches without a shuffle; memory
is a window's.  The labelled sample is found by a top-n of hashes (never a sort of all rows).

Defined cases: null and empty texts have no windows and get the score of no evidence; very long texts are scored whole,
and very long words count as words and are compressed whole; without labelled rows of both kinds every score is the share
of toxic rows (0 if none); ties of a sample's hash go by doc_id; repeated rows each return a row; an empty table returns no
rows; extra columns, whatever their names, are ignored (accepted() returns them).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import lean
from .fitting import fit_logistic, sigmoid

#: Distances from 1 to DEPTH are told apart; windows have WINDOW words.
DEPTH, WINDOW = 12, 3
#: Bytes of the shared base and of either kind's dictionary.
BASE, SIZE = 32768, 4096
#: Bytes that text doesn't have, known to both sides.
PRIMER = bytes((i * 73 + 200) % 256 for i in range(48))
_WORD = re.compile(rb"\S+")
_WINDOW = re.compile(rb"(?:\S+\s*){1,%d}" % WINDOW)


def _contexts(texts: list[str]) -> dict[tuple[bytes, bytes, bytes], int]:
    """Different words with their neighbours, each with the first text that has it; in order of a hash."""
    out: dict[tuple[bytes, bytes, bytes], int] = {}
    for i, t in enumerate(texts):
        words = _WORD.findall(t.encode().lower())
        for c in zip([b"", *words[:-1]], words, [*words[1:], b""], strict=True):
            out.setdefault(c, i)
    return dict(sorted(out.items(), key=lambda c: (xxhash.xxh3_64_intdigest(b"\n".join(c[0])), c[0])))


def _beginnings(contexts: dict[tuple, int], least: int, most: int) -> Counter:
    """In how many texts a beginning of a word (with its space) stands in a context that no earlier text had."""
    own: dict[int, set[bytes]] = {}
    for (_, word, _), i in contexts.items():
        word = b" " + word[:most]
        own.setdefault(i, set()).update(word[:j] for j in range(least, len(word) + 1))
    return Counter(p for found in own.values() for p in found)


def marked(own: dict[tuple, int], other: dict[tuple, int], *, times: float = 6, deviations: float = 6, occurrences: int = 6, least: int = 5, most: int = 24) -> list[tuple]:
    """The contexts of own whose word begins as words do in far more texts of own than of other."""
    a, b = _beginnings(own, least, most), _beginnings(other, least, most)
    scale = len(set(own.values())) / max(len(set(other.values())), 1)

    def marks(p: bytes) -> bool:
        expected = (b[p] + 0.5) * scale
        return a[p] >= occurrences and a[p] > times * expected and a[p] - expected > deviations * math.sqrt(expected + 1)

    found = set(filter(marks, a))
    return [c for c in own if any((b" " + c[1])[:i] in found for i in range(least, min(len(c[1]) + 1, most) + 1))]


def trained(contexts: list[tuple], size: int, segment: int) -> bytes:
    """A dictionary that zstandard trains on windows; of too few windows, the windows themselves."""
    windows = [b" " + b" ".join(c) + b" " for c in contexts]
    try:
        return zstandard.train_dictionary(size, windows, k=segment, d=6 if segment < 32 else 8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(windows)[:size]


class Distances:
    """Window distances of texts between the two dictionaries, both behind the base."""

    def __init__(self, base: bytes, toxic: bytes, ordinary: bytes):
        size = max(len(toxic), len(ordinary))  # equal lengths, so the base is equally far away
        self.both = [self._compressor(base + d.rjust(size, b"\0") + PRIMER) for d in (ordinary, toxic)]

    @staticmethod
    def _compressor(content: bytes):
        how = zstandard.ZstdCompressionParameters(window_log=18, hash_log=15, chain_log=16, search_log=4, min_match=6, target_length=32, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)

    def histogram(self, text: str) -> np.ndarray:
        """Windows by distance 0 (or less) to DEPTH (or more)."""
        plain, toxic = self.both[0].compress, self.both[1].compress
        out = [0] * (DEPTH + 1)
        for w in _WINDOW.findall(b" " + text.encode().lower()):
            w = PRIMER + w
            d = len(plain(w)) - len(toxic(w))
            out[0 if d < 0 else DEPTH if d > DEPTH else d] += 1
        return np.array(out, float)


def features(histograms: np.ndarray) -> np.ndarray:
    reach = histograms[:, ::-1].cumsum(1)[:, ::-1]
    n = np.maximum(reach[:, :1], 1)
    return np.c_[np.log1p(reach[:, 1:]), np.log1p(100 * reach[:, 1:] / n), np.log1p(n)]


class Model:
    def __init__(self, base: bytes, toxic: bytes, ordinary: bytes, weights: np.ndarray, shift: np.ndarray, scale: np.ndarray, prior: float):
        self.base, self.toxic, self.ordinary, self.weights, self.shift, self.scale, self.prior = base, toxic, ordinary, weights, shift, scale, prior
        self.distances: Distances | None = None

    def __getstate__(self):
        return {**self.__dict__, "distances": None}

    def scores(self, texts: list[str]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.prior)
        self.distances = self.distances or Distances(self.base, self.toxic, self.ordinary)
        x = features(np.array([self.distances.histogram(t) for t in texts]).reshape(len(texts), DEPTH + 1))
        return sigmoid(np.c_[(x - self.shift) / self.scale, np.ones(len(x))] @ self.weights)


def fit(toxic: list[str], ordinary: list[str], share: float) -> Model:
    """share: of toxic rows among labelled ones, for the calibration."""
    none = np.zeros(0)
    if len(toxic) < 4 or len(ordinary) < 4:
        return Model(b"", b"", b"", none, none, none, share)
    own, other = _contexts(toxic[::2]), _contexts(ordinary[::2])
    windows = marked(own, other) or list(own)
    dictionaries = trained(list(other), BASE, 32), trained(windows, SIZE, 16), trained(list(other)[: len(windows)], SIZE, 16)
    model = Distances(*dictionaries)
    y = np.r_[np.ones(len(toxic[1::2])), np.zeros(len(ordinary[1::2]))]
    x = features(np.array([model.histogram(t) for t in [*toxic[1::2], *ordinary[1::2]]]))
    shift, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    weights = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(*dictionaries, fit_logistic((x - shift) / scale, y, weights=weights), shift, scale, share)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> tuple[list[str], list[str], float]:
    """Whole texts of up to `sample` distinct rows of label 1 and of label 0, by hash order, and the share of label 1."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y in (1, 0):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())
    got = sorted(rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect(), key=lambda r: (r["doc_id"],))
    total = sum(counts.values())
    return [r["text"] for r in got if r["y"] == 1], [r["text"] for r in got if r["y"] == 0], counts.get(1, 0) / total if total else 0.0


def score_documents(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep columns, score (0 to 1), predicted (score >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            s = np.concatenate([np.zeros(0), *(model.scores([v.as_py() or ""]) for v in batch.column(batch.num_columns - 1))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("_text"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(lean(run), ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *keep)) + ", score double, predicted int")


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text isn't predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.concatenate([np.zeros(0), *(shared.value.scores([v.as_py() or ""]) for v in batch.column(at))])
            yield batch.filter(pa.array(s < 0.5, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def fitted(docs: DataFrame, labels: DataFrame, *, sample: int = 1500) -> Model:
    """A model from rows that aren't held out.  sample: the bound on labelled rows of each label."""
    return fit(*labelled_sample(docs, labels.where(~held_out()), "toxic", sample))
