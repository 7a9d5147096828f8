"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a whole pre-token that is itself a token (one probe, then
an exact comparison of the bytes).  Tier two: a miss is merged from its single bytes, which form a linked list, while a
heap of (rank, place) yields the next merge; a pre-token of n bytes costs n log n however long it is.

Texts are cut at the pre-tokenizer's pattern.  Nothing in it crosses a single space that follows a non-blank, so texts are
first split at such spaces and the parts' ids are remembered per task (in bounded memos).  One pass
over the texts in Arrow batches; no shuffle; the tables travel as one broadcast of the vocabulary's size.

Defined cases: null text counts as empty and gives no ids; empty text gives no ids; texts of any length are encoded
whole; repeated rows each return a row; an empty table returns no rows; other columns are dropped or kept as asked.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import lean

_M64 = (1 << 64) - 1
_BLANKS_THEN_SPACE = re.compile(r"(?:\s|^) ")


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks, which count up from 0."""
    pairs = (line.split() for line in open(path, "rb") if line.strip())
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must count up from 0")
    return [t for _, t in ranked]


def _slot(h: int, d: int, n: int) -> int:
    """The place that displacement d gives a key's hash."""
    x = (h ^ (d * 0x9E3779B97F4A7C15)) & _M64
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & _M64
    return (x >> 17) % n


class PerfectHash:
    """Minimal and perfect: n keys take the places 0..n-1.  Buckets get displacements, the fullest first; a bucket with
    one key names its place directly."""

    def __init__(self, keys: Sequence[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        self.moves = np.zeros(self.buckets, np.int64)
        self.places = np.zeros(max(1, n), np.int32)
        full: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(k)
            full.setdefault(h % self.buckets, []).append((h, i))
        free = np.ones(n, bool)
        single = []
        for b, members in sorted(full.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                single.append((b, members[0][1]))
                continue
            for d in range(1, 1 << 24):
                spots = [_slot(h, d, n) for h, _ in members]
                if len(set(spots)) == len(spots) and all(free[s] for s in spots):
                    break
            else:
                raise ValueError("two keys are equal")
            self.moves[b] = d
            for s, (_, i) in zip(spots, members, strict=True):
                free[s], self.places[s] = False, i
        for (b, i), s in zip(single, np.flatnonzero(free), strict=True):
            self.moves[b], self.places[s] = -1 - int(s), i
        self.moves, self.places = array("q", self.moves.tobytes()), array("i", self.places.tobytes())  # numpy takes longer to give one number

    def __call__(self, key: bytes) -> int:
        """The only number that key can have; the caller compares."""
        if not self.n:
            return 0
        h = xxhash.xxh3_64_intdigest(key)
        d = self.moves[h % self.buckets]
        return self.places[-1 - d if d < 0 else _slot(h, d, self.n)]


def heap_merge(piece: bytes, rank: Callable[[bytes], int | None]) -> list[int]:
    """Ids of a pre-token's bytes after all merges, lowest rank first, leftmost first among equals."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of a swallowed byte, after is -1
    # An entry is one integer: rank, place, end.  It is stale unless the place's neighbour still ends there.
    bits = n.bit_length()
    mask, twice = (1 << bits) - 1, 2 * bits
    heap = [r << twice | i << bits | i + 2 for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        x = heappop(heap)
        end = x & mask
        i = x >> bits & mask
        j = after[i]
        if j < 0 or j >= n or after[j] != end:
            continue
        after[j] = -1
        after[i] = end
        if end < n:
            before[end] = i
            e = after[end]
            if (r := rank(piece[i:e])) is not None:
                heappush(heap, r << twice | i << bits | e)
        if i:
            p = before[i]
            if (r := rank(piece[p:end])) is not None:
                heappush(heap, r << twice | p << bits | end)
    ids, i = [], 0
    while i < n:
        if (r := rank(piece[i : after[i]])) is None:
            raise ValueError(f"byte {piece[i]} isn't in the vocabulary")
        ids.append(r)
        i = after[i]
    return ids


class Memo(dict):
    """Computes what is missing; when full, what wasn't used since the last time goes.  Very long keys aren't kept."""

    def __init__(self, compute: Callable[[str], bytes], size: int, longest: int = 200):
        super().__init__()
        self.compute, self.size, self.longest, self.old = compute, size, longest, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ByteBPE:
    """Remembers the ids of parts as bytes, two an id where that is enough.  Pieces are asked for by new parts of several alone, so few are kept."""

    def __init__(self, tokens: Sequence[bytes], pattern: str, table: PerfectHash | None = None, memo: int = 200_000):
        self.tokens, self.table = list(tokens), table or PerfectHash(tokens)
        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        self.pattern = regex.compile(pattern)
        self.kind, self.width = ("H", 2) if len(self.tokens) <= 1 << 16 else ("I", 4)
        self.pieces = Memo(self._piece, memo // 10)
        self.parts = Memo(lambda part: self._text(" " + part), memo)

    def _piece(self, text: str) -> bytes:
        piece = text.encode()
        i = self.table(piece)
        if i < len(self.tokens) and self.tokens[i] == piece:
            return i.to_bytes(self.width, sys.byteorder)
        return array(self.kind, heap_merge(piece, self.ranks.get)).tobytes()

    def _text(self, text: str) -> bytes:
        found = self.pattern.findall(text)
        return self._piece(found[0]) if len(found) == 1 else b"".join(map(self.pieces.__getitem__, found))

    def encode(self, text: str) -> list[int]:
        first, *rest = text.split(" ")
        if _BLANKS_THEN_SPACE.search(text):
            # Runs of blanks that end in a space stay whole: parts are joined again behind a blank.
            joined, held = [], first
            for part in rest:
                if held and not held[-1].isspace():
                    joined.append(held)
                    held = part
                else:
                    held = f"{held} {part}"
            first, *rest = [*joined, held]
        return array(self.kind, b"".join((self._text(first), *map(self.parts.__getitem__, rest)))).tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("ids", "decoded"), vocabulary: Sequence[bytes] | None = None) -> DataFrame:
    """doc_id and the asked outputs: ids (array of int), decoded (binary, from the ids), n_tokens, ids_sha256, decoded_sha256."""
    spark: SparkSession = docs.sparkSession
    tokens = list(vocabulary) if vocabulary is not None else read_ranks(path)
    shared = spark.sparkContext.broadcast((tokens, pattern, PerfectHash(tokens)))
    kinds = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("binary", pa.binary()), "n_tokens": ("bigint", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBPE(*shared.value)  # a task's own: its memos go with it, a worker that waits holds none
        names = [str(i) for i in range(len(coder.tokens))]
        for batch in batches:
            # Long texts would make large columns of ids: they leave in portions.
            portion: dict[str, list] = {o: [] for o in outputs}
            first = held = 0
            for row, value in enumerate(batch.column(1)):
                ids = coder.encode(value.as_py() or "")
                made = {"ids": lambda: ids, "n_tokens": lambda: len(ids), "ids_sha256": lambda: hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest(), "decoded": lambda: coder.decode(ids), "decoded_sha256": lambda: hashlib.sha256(coder.decode(ids)).hexdigest()}  # noqa: B023
                for o in outputs:
                    portion[o].append(made[o]())
                held += len(ids)
                if held > 1_000_000 or row == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, row + 1 - first), *[pa.array(portion[o], kinds[o][1]) for o in outputs]], names=["doc_id", *outputs])
                    portion, first, held = {o: [] for o in outputs}, row + 1, 0

    rows = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"{o} {kinds[o][0]}" for o in outputs)
    return rows.mapInArrow(lean(run), schema)
