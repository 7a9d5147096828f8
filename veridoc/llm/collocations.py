"""Phrase collocations: frequent phrases of two to five words, scored by their weakest cut.

Texts are lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` into pieces and those at blanks and tabs into words.  Per language, n counts
all words and f(phrase) all its occurrences within pieces, overlapping ones included.  Candidates are phrases of 2 to `longest`
words with a = f >= least.  A cut after k words gives l = f(first part), r = f(rest) and floor(1000 a n / (l r)); the lowest
counts, of equal ones the earliest.  A candidate goes if a longer one with f * 100 >= absorbed * a contains it.

1. Words are counted (partial counts in tasks, then one aggregation); those that reach `least` get numbers, and texts
   become sequences of numbers, any other word being a break.
2. Length by length, a window is a pair of neighbouring frequent phrases, one word shorter, that overlap (Apriori): one 64-bit
   key.  Mappers count hashed keys in an array of saturating cells, as many as grow with the words; keys whose summed cell stays
   under `least` can't be frequent.  The distinct keys left are the candidates; tasks send them as sorted arrays, which are united as a tree.
3. Candidates are dealt to shards by hash, and each shard becomes a minimal perfect hash with its keys stored by slot, so that a
   key that isn't a candidate is recognised.  Mappers look windows up (numpy), count slots by bincount, and the
   arrays of a shard are summed as a tree: by groups of tasks, then altogether.
4. Frequent slots get numbers, and sequences are rewritten to them for the next length.
5. Each phrase takes the counts of its beginnings and ends from its two shorter phrases' slots, so a cut's l and r are read from
   these arrays; the rest is DataFrame expressions.  Products are decimals of 38 digits.

Scale: windows never leave their task, only counts and distinct candidates do.  There are up to 2**26 cells; of more than
2**30 words a larger share of the distinct windows are candidates (results stay exact).  Tables reach mappers in portions of at most
`portion` keys (some 30 bytes each), each portion being a pass over the sequences; the words' dictionary is broadcast up to
`most_words` words, and beyond that each text is joined with its own words' numbers.  Frequent phrases of one length must
be fewer than 2**31 (else an error: raise `least`).  Steps are written tables.

Defined cases: null texts count as empty and have no words; a null language is `und` (together with texts that say so); very long
texts are taken whole; repeated rows count each; ties are broken as said, at last by the phrase in byte order, so
ranks are unique; an empty table returns no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from veridoc.operators.ranking import exact_rank

from .common import arrow_batches, dropped, lean, written

_U = np.uint64
#: Characters that end a piece.
BREAKS = b".,;:!?\n\x0b\x0c\r"
_ENDS = bytes.maketrans(BREAKS, b"." * len(BREAKS))


def tokens(text: str) -> list[bytes]:
    """Words, and `.` (which is no word) where a piece ends."""
    return text.encode().lower().translate(_ENDS).replace(b".", b" . ").split()


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(_U) ^ _U((seed * 0x9E3779B97F4A7C15 + 0x165667B19E3779F9) & (1 << 64) - 1)
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys by slot, and levels of cells that hold a slot or -1: whoever is alone in a cell of twice as many cells as keys keeps
    it, the others go on to the next level.  Slots count from 0 without gaps."""
    left, levels, order = np.unique(keys), [], []
    first = 0
    while len(left):
        cell = (_mixed(left, len(levels)) % _U(2 * len(left))).astype(np.int64)
        alone = np.bincount(cell, minlength=2 * len(left))[cell] == 1
        level = np.full(2 * len(left), -1, np.int32)
        level[cell[alone]] = np.arange(first, first + alone.sum())
        first += int(alone.sum())
        order.append(left[alone])
        levels.append(level)
        left = left[~alone]
    return np.concatenate(order) if order else keys[:0], levels


class Slots:
    """Perfect hashes of several shards of `of` in all, looked up together; slots count through the shards given."""

    def __init__(self, shards: list[tuple], of: int):
        """shards: (shard, keys, cells, sizes of the levels, values) as bytes; values by slot, or None."""
        self.of = of
        depth = max((len(s[3]) for s in shards), default=0)
        self.base, self.size = np.zeros((depth, of), np.int64), np.ones((depth, of), np.int64)
        keys, cells, values = [], [], []
        slot = at = 0
        self.starts = {}
        for shard, k, c, sizes, v in shards:
            k, c = np.frombuffer(k, np.int64), np.frombuffer(c, np.int32)
            for d, n in enumerate(sizes):
                self.base[d, shard], self.size[d, shard] = at, n
                at += n
            self.starts[shard] = (slot, len(k))
            cells.append(np.where(c >= 0, c + slot, -1))
            keys.append(k)
            if v is not None:
                values.append(np.frombuffer(v, np.int32))
            slot += len(k)
        # A last cell without a slot, for levels that a shard doesn't have.
        self.cells = np.concatenate([*cells, np.full(1, -1, np.int64)]).astype(np.int32)
        for d in range(depth):
            for shard, _, _, sizes, _ in shards:
                if d >= len(sizes):
                    self.base[d, shard] = at
        absent = np.ones(of, bool)
        absent[[s[0] for s in shards]] = False
        self.base[:, absent] = at
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.values = np.concatenate(values) if values else None
        self.n = slot

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Slot (or value) of each key, -1 for those that aren't stored."""
        out = np.full(len(keys), -1, np.int32)
        if not self.n or not len(keys):
            return out
        shard = shard_of(keys, self.of)
        open_ = np.arange(len(keys))
        for d in range(len(self.base)):
            own = shard[open_]
            slot = self.cells[self.base[d, own] + (_mixed(keys[open_], d) % self.size[d, own].astype(_U)).astype(np.int64)]
            hit = slot >= 0
            out[open_[hit]] = slot[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        out[(out >= 0) & (self.keys[np.maximum(out, 0)] != keys)] = -1
        return out if self.values is None else np.where(out >= 0, self.values[np.maximum(out, 0)], -1).astype(np.int32)


def shard_of(keys: np.ndarray, of: int) -> np.ndarray:
    return (_mixed(keys, 101) % _U(of)).astype(np.int64)


_LOADED: dict[str, object] = {}


def _loaded(key: str, make):
    """One copy for each worker, the latest only."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = make()
    return _LOADED[key]


def _ints(values) -> pa.Array:
    return pa.array([np.ascontiguousarray(v).tobytes() for v in values], pa.binary())


def count_words(docs: DataFrame, flush: int = 300_000) -> DataFrame:
    """lang, word, n of rows (lang, text): partial counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def made() -> pa.RecordBatch:
            rows = [(g, w.decode(), k) for g, c in counts.items() for w, k in c.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if words := tokens(text.as_py() or ""):
                    counts.setdefault(lang, Counter()).update(words)
            for c in counts.values():
                c.pop(b".", None)
            if sum(map(len, counts.values())) > flush:
                yield made()
        if any(counts.values()):
            yield made()

    return docs.mapInArrow(lean(run), "lang string, word string, n bigint")


def _packed(ids: list[int] | np.ndarray) -> np.ndarray:
    """Numbers with runs of breaks (-1) as one."""
    x = np.asarray(ids, np.int32)
    return x[(x >= 0) | np.r_[True, x[:-1] >= 0]] if len(x) else x


class _Numbers(dict):
    def __missing__(self, word):
        return -1


def sequences(docs: DataFrame, words: DataFrame, most_words: int, row: int = 65_536) -> DataFrame:
    """seq: binary arrays of 32-bit numbers of frequent words, -1 for breaks, from rows (lang, text)."""
    spark = docs.sparkSession
    few = words.limit(most_words + 1).count() <= most_words
    if few:
        known: dict[str, dict] = {}
        for lang, word, no in words.select("lang", "word", "id").collect():  # most_words at most
            known.setdefault(lang, {})[word.encode()] = no
        shared, name = spark.sparkContext.broadcast(known), uuid.uuid4().hex
    else:
        docs = _with_numbers(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _loaded(name, lambda: {g: _Numbers(w) for g, w in shared.value.items()}) if few else {}
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for i, (lang, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                own = numbers.get(lang) if few else _Numbers((k.encode(), v) for k, v in batch.column(2)[i].as_py() or ())
                if not own or not text.is_valid:
                    continue
                ids = _packed([*map(own.__getitem__, tokens(text.as_py())), -1])
                held.append(ids)
                n += len(ids)
                if n >= row:
                    yield pa.RecordBatch.from_arrays([_ints([np.concatenate(held)])], names=["seq"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([_ints([np.concatenate(held)])], names=["seq"])

    return docs.mapInArrow(lean(run), "seq binary")


def _with_numbers(docs: DataFrame, words: DataFrame) -> DataFrame:
    """docs (lang, text) with the numbers of each text's own frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                own = sorted(w.decode() for w in set(tokens(text.as_py() or "")) - {b"."})
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array([key] * len(own), pa.string()), pa.array(own, pa.string())], names=["lang", "key", "word"])

    keyed = docs.withColumn("key", F.md5("text"))
    used = keyed.dropDuplicates(["lang", "key"]).mapInArrow(lean(run), "lang string, key string, word string")
    maps = used.join(words, ["lang", "word"]).groupBy("lang", "key").agg(F.map_from_entries(F.collect_list(F.struct("word", F.col("id").cast("int")))).alias("numbers"))
    return keyed.join(maps, ["lang", "key"]).select("lang", "text", "numbers")


def _keys(seq: bytes) -> np.ndarray:
    """The windows' keys: two neighbouring numbers, or -1 where one is missing."""
    s = np.frombuffer(seq, np.int32).astype(np.int64)
    return np.where((s[:-1] >= 0) & (s[1:] >= 0), (s[:-1] << 32) | s[1:], -1) if len(s) > 1 else np.zeros(0, np.int64)


def _summed(parts: DataFrame, kind: type, most: int | None, salts: int = 16) -> DataFrame:
    """part, cells: arrays of equal length summed for each part, up to `most`; first by groups of tasks."""

    def add(arrays: list[bytes]) -> bytes:
        total = np.frombuffer(arrays[0], kind).astype(np.int64)
        for a in arrays[1:]:
            total += np.frombuffer(a, kind)
        return (np.minimum(total, most) if most else total).astype(kind).tobytes()

    def grouped(by: list[str]):
        def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for b in batches:
                for x in b.column("cells").to_pylist():
                    held = add([held, x]) if held is not None else x
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int64()) for k in key] + [pa.array([held], pa.binary())], names=[*by, "cells"])

        return run

    salted = parts.selectExpr("part", f"task % {salts} AS task", "cells")
    once = salted.groupBy("part", "task").applyInArrow(grouped(["part", "task"]), "part bigint, task bigint, cells binary")
    return once.select("part", "cells").groupBy("part").applyInArrow(grouped(["part"]), "part bigint, cells binary")


def possible_buckets(seqs: DataFrame, least: int, buckets: int, chunk: int = 1 << 16, most: int = 2_000_000) -> np.ndarray:
    """For each bucket of hashed keys whether its windows reach `least` together; `buckets` bits come to the driver."""
    kind = np.uint8 if least < 256 else np.uint32
    wide = 1 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(buckets, kind)

        def add(held: list[np.ndarray]) -> None:
            """Cells saturate at `least`, a stretch of them at a time."""
            hashes = np.sort(np.concatenate(held))
            cut = np.searchsorted(hashes, [*range(0, buckets, wide), buckets])
            for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if a < b:
                    own = cells[i * wide : (i + 1) * wide]
                    own[:] = np.minimum(own + np.bincount(hashes[a:b] - i * wide, minlength=len(own)), least)

        held, n = [], 0
        for batch in batches:
            for seq in batch.column(0):
                keys = _keys(seq.as_py())
                held.append(bucket_of(keys[keys >= 0], buckets))
                n += len(held[-1])
                if n > most:
                    add(held)
                    held, n = [], 0
        if held:
            add(held)
        task = TaskContext.get().partitionId()
        for i in range(0, buckets, chunk):
            if (own := cells[i : i + chunk]).any():
                yield pa.RecordBatch.from_arrays([pa.array([i // chunk], pa.int64()), pa.array([task], pa.int64()), _ints([own])], names=["part", "task", "cells"])

    total = _summed(seqs.mapInArrow(lean(run), "part bigint, task bigint, cells binary"), kind, least)
    out = np.zeros(buckets, bool)
    for part, cells in total.collect():
        out[part * chunk : (part + 1) * chunk] = np.frombuffer(cells, kind) >= least
    return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(keys, 77) % _U(buckets)).astype(np.int32)


def bucket_count(words: int, load: int = 24, most: int = 1 << 26) -> int:
    """So many cells that each has `load` windows on average, up to `most` cells."""
    return max(1 << 12, min(most, math.ceil(words / load)))


def _union(arrays: list[bytes]) -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer(a, np.int64) for a in arrays]))


def candidate_keys(seqs: DataFrame, possible: np.ndarray, parts: int = 64, flush: int = 2_000_000) -> DataFrame:
    """part, keys, n: the distinct keys of possible buckets, as a sorted array for each part; tasks' arrays are united as a tree."""
    shared = seqs.sparkSession.sparkContext.broadcast(np.packbits(possible).tobytes())
    n = len(possible)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(shared.value, np.uint8))[:n].view(bool)
        task = TaskContext.get().partitionId()

        def made(keys: np.ndarray) -> pa.RecordBatch:
            part = shard_of(keys, parts)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(i, keys[order[a:b]]) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([task] * len(rows), pa.int64()), _ints([k for _, k in rows])], names=["part", "task", "keys"])

        held, size = [], 0
        for batch in batches:
            for seq in batch.column(0):
                keys = _keys(seq.as_py())
                keys = keys[keys >= 0]
                held.append(np.unique(keys[bits[bucket_of(keys, n)]]))
                size += len(held[-1])
                if size > flush:
                    held = [np.unique(np.concatenate(held))]
                    size = len(held[0])
                    if size > flush // 2:
                        yield made(held[0])
                        held, size = [], 0
        if size:
            yield made(np.unique(np.concatenate(held)))

    def united(by: list[str]):
        def join(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[bytes] = []
            for b in batches:
                held = [_union([*held, *b.column("keys").to_pylist()]).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int64()) for k in key] + [pa.array(held, pa.binary()), pa.array([len(held[0]) // 8], pa.int64())], names=[*by, "keys", "n"])

        return join

    rows = seqs.mapInArrow(lean(run), "part bigint, task bigint, keys binary").selectExpr("part", "task % 16 AS task", "keys")
    once = rows.groupBy("part", "task").applyInArrow(united(["part", "task"]), "part bigint, task bigint, keys binary, n bigint")
    return once.select("part", "keys").groupBy("part").applyInArrow(united(["part"]), "part bigint, keys binary, n bigint")


_SHARD = "shard bigint, keys binary, cells binary, sizes array<int>"


def hashed(candidates: DataFrame, of: int) -> DataFrame:
    """A perfect hash for each shard of keys (part, keys)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                keys = np.frombuffer(data, np.int64)
                shard = shard_of(keys, of)
                own = [(i, keys[shard == i]) for i in np.unique(shard).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), _ints([k for _, k in own])], names=["shard", "keys"])

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        keys, levels = perfect_hash(np.concatenate([np.frombuffer(x, np.int64) for x in rows["keys"].to_pylist()]))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "keys": _ints([keys]), "cells": _ints([np.concatenate(levels)]), "sizes": pa.array([[len(x) for x in levels]], pa.list_(pa.int32()))})

    return candidates.select("keys").mapInArrow(deal, "shard bigint, keys binary").groupBy("shard").applyInArrow(build, _SHARD)


def _portions(shards: DataFrame, of: int, most: int, values: str | None = None) -> Iterator[tuple]:
    """Broadcasts of perfect hashes, `most` shards each."""
    spark = shards.sparkSession
    for first in range(0, of, most):
        rows = shards.where(F.col("shard").between(first, first + most - 1)).select("shard", "keys", "cells", "sizes", *([values] if values else [F.lit(None).cast("binary")])).collect()
        yield spark.sparkContext.broadcast([(s, bytes(k), bytes(c), list(z), None if v is None else bytes(v)) for s, k, c, z, v in rows]), uuid.uuid4().hex


def counted(seqs: DataFrame, shards: DataFrame, of: int, most: int) -> DataFrame:
    """shards with cells of counts by slot (f, 64 bits)."""
    parts = None
    for shared, name in _portions(shards, of, most):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            slots = _loaded(name, lambda: Slots(shared.value, of))
            total = np.zeros(slots.n, np.int64)
            held, n = [], 0
            for batch in batches:
                for seq in batch.column(0):
                    found = slots(_keys(seq.as_py()))
                    held.append(found[found >= 0])
                    n += len(held[-1])
                    if n > 1_000_000:
                        total += np.bincount(np.concatenate(held), minlength=slots.n)
                        held, n = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=slots.n)
            task = TaskContext.get().partitionId()
            for shard, (a, k) in slots.starts.items():
                if (own := total[a : a + k]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([task], pa.int64()), _ints([own])], names=["part", "task", "cells"])

        made = _summed(seqs.mapInArrow(lean(run), "part bigint, task bigint, cells binary"), np.int64, None)
        parts = made if parts is None else parts.unionByName(made)
    return shards.join(parts.selectExpr("part AS shard", "cells AS f"), "shard", "left")


def numbered(shards: DataFrame, least: int) -> DataFrame:
    """shards with `numbers` (32 bits by slot, -1 for what isn't frequent), counting through all shards."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [0 if x is None else int((np.frombuffer(x, np.int64) >= least).sum()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.int64())], names=["shard", "n"])

    # A row for each shard.
    sizes = shards.select("shard", "f").mapInArrow(count, "shard bigint, n bigint")
    starts = sizes.withColumn("start", F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for keys, f, start in zip(b.column("keys").to_pylist(), b.column("f").to_pylist(), b.column("start").to_pylist(), strict=True):
                often = np.frombuffer(f, np.int64) >= least if f is not None else np.zeros(len(keys) // 8, bool)
                if start + often.sum() >= 1 << 31:
                    raise ValueError("more than 2**31 frequent phrases of one length: raise `least`")
                out.append(np.where(often, start + np.cumsum(often) - 1, -1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.drop_columns(["start"]).columns, _ints(out)], names=["shard", "keys", "cells", "sizes", "f", "numbers"])

    return shards.join(starts.select("shard", "start"), "shard").select("shard", "keys", "cells", "sizes", "f", "start").mapInArrow(number, f"{_SHARD}, f binary, numbers binary")


def grams(shards: DataFrame) -> DataFrame:
    """id, prefix, suffix, f of the frequent phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, f, numbers in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                no = np.frombuffer(numbers, np.int32)
                often = no >= 0
                if often.any():
                    key = np.frombuffer(keys, np.int64)[often]
                    yield from pa.table({"id": no[often].astype(np.int64), "prefix": key >> 32, "suffix": key & 0xFFFFFFFF, "f": np.frombuffer(f, np.int64)[often]}).to_batches()

    return shards.select("keys", "f", "numbers").mapInArrow(run, "id bigint, prefix bigint, suffix bigint, f bigint")


def rewritten(seqs: DataFrame, shards: DataFrame, of: int, most: int) -> DataFrame:
    """Sequences of the numbers of phrases one word longer, -1 where none begins."""
    first = True
    for shared, name in _portions(shards, of, most, "numbers"):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            slots = _loaded(name, lambda: Slots(shared.value, of))
            for batch in batches:
                for seq, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = slots(_keys(seq))
                    if known is not None:
                        found = np.maximum(found, np.frombuffer(known, np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array([seq], pa.binary()), _ints([found])], names=["seq", "next"])

        rows = seqs.select("seq", F.lit(None).cast("binary").alias("next")) if first else made
        made, first = rows.mapInArrow(lean(run), "seq binary, next binary"), False

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_packed(np.frombuffer(x, np.int32)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([_ints([x for x in out if len(x) > 1])], names=["seq"])

    return made.select("next").mapInArrow(lean(pack), "seq binary")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, top: int = 2000, absorbed: int = 100, buckets: int | None = None, shard: int = 65_536, portion: int = 2_000_000, most_words: int = 500_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best `top` phrases.  buckets: cells of the first count (else by the words)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    with arrow_batches(spark, size="2m"):
        counts = written(count_words(rows).groupBy("lang", "word").agg(F.sum("n").alias("f")), "counts")
        totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
        words = written(exact_rank(counts.where(F.col("f") >= least), ["lang", "word"], rank="id").select("lang", "word", "f", "id"), "words")
        seqs = written(sequences(rows, words, most_words), "sequences")
        buckets = buckets or bucket_count(totals.agg(F.sum("n")).first()[0] or 0)
        one = F.array("f")
        phrases = words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", one.alias("heads"), one.alias("tails"))
        kept = None
        for length in range(2, longest + 1):
            keys = written(candidate_keys(seqs, possible_buckets(seqs, least, buckets)), "candidates")
            of = max(1, math.ceil((keys.agg(F.sum("n")).first()[0] or 0) / shard))
            most = max(1, portion // shard)
            shards = written(hashed(keys, of), "hashes")
            numbers = written(numbered(written(counted(seqs, shards, of, most), "counted"), least), "numbered")
            found = grams(numbers)
            # The shorter phrase in front brings its beginnings' counts, the one behind its ends'.
            front = phrases.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("front"), "heads")
            behind = phrases.select(F.col("id").alias("suffix"), "last", "tails")
            longer = found.join(front, "prefix").join(behind, "suffix")
            longer = longer.select("id", "lang", F.concat_ws(" ", "front", "last").alias("phrase"), "last", "f", F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"), "prefix", "suffix")
            longer = written(longer, "phrases")
            if length > 2:
                inside = longer.select(F.explode(F.array("prefix", "suffix")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("over"))
                phrases = phrases.join(inside, "id", "left").where(F.col("over").isNull() | (100 * F.col("over") < absorbed * F.col("f"))).drop("over")
                kept = phrases if kept is None else kept.unionByName(phrases)
            if length < longest:
                new = written(rewritten(seqs, numbers, of, most), "sequences")
                dropped(seqs)
                seqs = new
            phrases = longer.drop("prefix", "suffix")
        dropped(seqs)
        kept = phrases if kept is None else kept.unionByName(phrases)
    return _ranked(kept.join(totals, "lang"), top)


def _ranked(phrases: DataFrame, top: int, salts: int = 64) -> DataFrame:
    wide = "cast({} AS decimal(20, 0))".format
    up = f"cast(1000 AS decimal(4, 0)) * {wide('f')} * {wide('n')}"
    left, right = "heads[k - 1]", "tails[size(heads) - k - 1]"
    cuts = f"transform(sequence(1, size(heads) - 1), k -> struct({up} div ({wide(left)} * {wide(right)}) AS score, k AS k, {left} AS l, {right} AS r))"
    best = phrases.select("lang", "phrase", F.col("f").alias("a"), "n", F.expr(f"array_min({cuts})").alias("cut")).select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's best are the best of its parts' best.
    some = best.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
