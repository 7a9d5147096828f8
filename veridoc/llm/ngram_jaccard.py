"""N-gram Jaccard join with a token-group matrix.

Documents are sets of hashed word shingles.  Documents with equal sets are one class and are joined once.

1. Groups.  All sets are ordered by hash.  Two sets that link share at least 8 % of either's size among the first
   n - ceil(0.8 n) + ceil(n / 10) shingles of both (an extended prefix), so a class fewer of whose prefix shingles are
   shared with a class of its own or a neighbouring size band (a factor of 1.25) is out; this sheds documents that only
   have a common passage.  Of each shingle that is among the first n - ceil(0.8 n) + 1 (linked sets share one of those)
   and band one class stands for the others: they are tied to it, and bands to the next band, so a shingle of a million
   documents makes a million ties, not their square.  Tied classes form the groups of similar documents; what isn't tied
   can't link.
2. Matrix.  A group is a block; groups above `most` classes or `per_block` shingles are cut into blocks by minimum hash
   (similar sets fall together) and, where that isn't enough, by id.  Inside a block the members are cut into small
   subgroups of neighbours; for each the union of its members' shingles is stored as a column of a sparse matrix.  A
   query's row sums bound its overlap with any member.
3. Opening.  Only subgroups whose bound reaches 80 % of the larger set are opened; their members' overlaps are counted
   exactly.  Members known to be connected already are not compared again.  The task returns the links that connect.
4. Between the blocks of a large group.  First one member of each component found meets the others' (blocks by another
   minimum hash), which joins the copies of one text however many they are.  Groups that are still in several
   components are finished exactly, with extended prefixes under one order of all shingles (rare ones first): a member
   less than 8 % of whose size stands in another component's prefixes of the group is out, and what is left is tied
   again by the first of these shingles, into groups that mostly fit into one block.  Of one that doesn't, a member asks only those
   other blocks where 8 % of its size stand in another component.
5. Components of those links, spread over classes and their documents.

Scale: prefixes travel as packed arrays, partitioned by hash ranges whose number follows the input.  Equal shingles of one
band meet inside a task first, so a shingle that a third of all documents have reaches its range as one entry a task and
band.  A block's members are bounded by number and by shingles; its queries pass by one at a time.  The order's head
(`hottest` shingles) is all that is broadcast by content; ids are broadcast up to `inline`.  Hot classes are one row; the
join that spreads components over copies is one that can be split.

Defined cases: doc_id is a whole number (bigint); null, empty and blank texts have an empty set and are a component of
their own; texts of fewer words than a shingle have one shingle, the whole sequence; very long texts are read whole;
repeated rows each return a row; ties in size or hash are broken by id; an empty table returns no rows; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import arrow_batches, dropped, lean, written
from .graph import connected_components

_U = np.uint64
_PACKED = np.dtype([("f", "<u8"), ("n", "<u4"), ("d", "<i8")])
#: Set in a packed size: another class of the band is known to have the shingle; it is one of the set's first ones.
_KNOWN, _BASE = np.uint32(1 << 31), np.uint32(1 << 30)
_SIZE = np.uint32((1 << 30) - 1)
#: Odd multipliers that give a hash's tokens other orders.
_MIXED, _SECOND = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, size: int, bound: int = 100_000):
        self.size, self.bound, self.words = size, bound, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        known = self.words
        if len(known) > self.bound:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), _U, len(words))
        if not len(h):
            return h
        size = min(self.size, len(h))
        with np.errstate(over="ignore"):
            s = np.full(len(h) - size + 1, size, _U)
            for k in range(size):
                s = s * _U(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k]
            s ^= s >> _U(32)
            s *= _U(0xD6E8FEB86659FD93)
            s ^= s >> _U(29)
        return np.unique(s)


def digests(tokens: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64)
    return int(a), int(b)


def _sets(batches: Iterator[pa.RecordBatch], size: int, column: int = 1) -> Iterator[tuple[pa.RecordBatch, Iterator[np.ndarray]]]:
    shingles = Shingler(size)
    for batch in batches:
        yield batch, (shingles(v.as_py()) for v in batch.column(column))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, d1, d2, m1, m2: how many shingles, a digest of the set and its least shingle in two orders (null if empty)."""

    def run(batches):
        for batch, sets in _sets(batches, size):
            n, more = [], []
            for s in sets:
                n.append(len(s))
                with np.errstate(over="ignore"):
                    more.append((*digests(s), int(s[0]) - (1 << 63), int((s * _SECOND).min()) - (1 << 63)) if len(s) else (None,) * 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array([x[i] for x in more], pa.int64()) for i in range(4))], names=["doc_id", "n", "d1", "d2", "m1", "m2"])

    return docs.mapInArrow(lean(run), "doc_id bigint, n bigint, d1 bigint, d2 bigint, m1 bigint, m2 bigint")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    key, parts = None, []
    for batch in batches:
        for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key and parts:
                yield key, parts
                parts = []
            key = k
            parts.append(p)
    if parts:
        yield key, parts


def _grouped(packed: DataFrame, by: str, order: list[str], run, schema: str) -> DataFrame:
    """run over partitions in which the rows of each `by` follow one another."""
    spark = packed.sparkSession
    return packed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), by).sortWithinPartitions(*order).mapInArrow(lean(run), schema)


def prefix_length(n: int) -> int:
    return min(n, n - -(-4 * n // 5) + -(-n // 10))


def base_length(n: int) -> int:
    """Linked sets share one of so many first shingles of both."""
    return min(n, n - -(-4 * n // 5) + 1)


def size_bands(n: np.ndarray) -> np.ndarray:
    """Sizes that differ by less than a factor of 1.25; sets that link are in one band or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / math.log(1.25) + 1e-9).astype(np.int64)


def _entries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed entries sorted by shingle, band and class, each class once a shingle; their bands; whether each is first of its band."""
    band = size_bands(x["n"] & _SIZE)
    order = np.lexsort((~(x["n"] & _KNOWN), x["d"], band, x["f"]))
    x, band = x[order], band[order]
    once = np.r_[True, (x["f"][1:] != x["f"][:-1]) | (x["d"][1:] != x["d"][:-1])]
    x, band = x[once], band[once]
    return x, band, np.r_[True, (x["f"][1:] != x["f"][:-1]) | (band[1:] != band[:-1])]


def _packed(bucket: int, x: np.ndarray) -> tuple[int, bytes]:
    return bucket, x.tobytes()


def shared_prefixes(docs: DataFrame, size: int, bits: int, portion: int = 500_000) -> DataFrame:
    """f, n, band, d, base: prefix shingles that another class of the same or a neighbouring size band has too, with their classes."""

    def spread(batches):
        held, total, seen = [], 0, set()

        def flush():
            x = np.empty(total, _PACKED)
            sizes = [len(h[0]) for h in held]
            x["f"] = np.concatenate([h[0] for h in held])
            x["n"] = np.repeat(np.array([min(h[1], int(_SIZE)) for h in held], np.uint32), sizes)
            place = np.arange(total) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes)
            x["n"] |= np.where(place < np.repeat([base_length(h[1]) for h in held], sizes), _BASE, np.uint32(0))
            x["d"] = np.repeat(np.array([h[2] for h in held], np.int64), sizes)
            x, _, first = _entries(x)
            # Of a shingle and band one entry goes on to its range; the others are known to be shared already.
            out = [_packed(-1, x[~first])] if not first.all() else []
            alone = np.r_[first[1:], True]
            x["n"] |= np.where(alone, np.uint32(0), _KNOWN)
            x = x[first]
            with np.errstate(over="ignore"):
                bucket = ((x["f"] * _MIXED) >> _U(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            x, bucket = x[order], bucket[order]
            cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(x)]
            out += [_packed(int(bucket[a]), x[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["bucket", "payload"])

        for _, sets in _sets(batches, size):
            for s in sets:
                if not len(s):
                    continue
                d = digests(s)[0]
                if d in seen:
                    continue
                seen.add(d)
                p = prefix_length(len(s))
                held.append((s[:p], len(s), d))
                total += p
                if total > portion:
                    yield flush()
                    held, total = [], 0
                    if len(seen) > 100_000:
                        seen = set()
        if held:
            yield flush()

    def rows(x, band):
        return pa.RecordBatch.from_arrays([pa.array(x["f"].view(np.int64) if x["f"].flags.contiguous else x["f"].copy().view(np.int64)), pa.array((x["n"] & _SIZE).astype(np.int64)), pa.array(band.astype(np.int32)), pa.array(x["d"].astype(np.int64)), pa.array((x["n"] & _BASE) != 0)], names=["f", "n", "band", "d", "base"])

    def meet(batches: Iterator[pa.RecordBatch]):
        for key, parts in _by_bucket(batches):
            if key < 0:
                for p in parts:
                    x = np.frombuffer(p, _PACKED)
                    yield rows(x, size_bands(x["n"] & _SIZE))
                continue
            x, band, first = _entries(np.concatenate([np.frombuffer(p, _PACKED) for p in parts]))
            alone = first & np.r_[first[1:], True]
            # The next band's entries of a shingle follow at once: sorted by shingle and band.
            next_to = (x["f"][1:] == x["f"][:-1]) & (band[1:] - band[:-1] == 1)
            group = np.cumsum(first) - 1
            touched = np.zeros(group[-1] + 1, bool)
            touched[group[:-1][next_to]] = True
            touched[group[1:][next_to]] = True
            keep = ~alone | touched[group] | ((x["n"] & _KNOWN) != 0)
            if keep.any():
                yield rows(x[keep], band[keep])

    packed = docs.mapInArrow(lean(spread), "bucket bigint, payload binary")
    # What is known already has no range to go to: it is dealt out by a number of its own.
    dealt = packed.withColumn("to", F.when(F.col("bucket") < 0, F.xxhash64("payload")).otherwise(F.col("bucket")))
    return _grouped(dealt.select("bucket", "payload", "to"), "to", ["bucket"], meet, "f bigint, n bigint, band int, d bigint, base boolean")


def ties(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """d of the classes that share enough; a, b: those that have a first shingle with a band's least class, and bands with the next."""
    enough = written(shared.groupBy("d", "n").agg(F.count_distinct("f").alias("m")).where("25 * m >= 2 * n").select("d").distinct(), "enough")
    left = shared.where("base").join(enough, "d", "left_semi").select("f", "band", "d")
    return enough, _stars(left, ["f"], "d")


def _stars(left: DataFrame, by: list[str], member: str) -> DataFrame:
    """a, b: members of one `by` and band with their least, and that with the next band's."""
    least = left.groupBy(*by, "band").agg(F.min(member).alias("least"))
    own = left.join(least, [*by, "band"]).where(F.col(member) != F.col("least")).select(F.col(member).alias("a"), F.col("least").alias("b"))
    above = least.select(*by, (F.col("band") - 1).alias("band"), F.col("least").alias("b"))
    return own.unionByName(least.join(above, [*by, "band"]).select(F.col("least").alias("a"), "b"))


class TokenGroupMatrix:
    """Members' sets in subgroups; unions of subgroups as columns of a sparse matrix (by shingle: which subgroups have it)."""

    def __init__(self, sets: list[np.ndarray], width: int = 24):
        # Neighbours by size, then by least shingles, fall into one subgroup.
        self.order = sorted(range(len(sets)), key=lambda i: (int(math.log(len(sets[i])) * 4), sets[i][:2].tolist()))
        self.sizes = np.array([len(sets[i]) for i in self.order])
        self.vocabulary, flat = np.unique(np.concatenate([sets[i] for i in self.order]), return_inverse=True)
        self.flat = flat.astype(np.int32)
        self.begin = np.r_[0, np.cumsum(self.sizes)]
        self.first = np.arange(0, len(sets), width)
        self.last = np.minimum(self.first + width, len(sets))
        group = np.repeat(np.arange(len(sets)) // width, self.sizes)
        union = np.unique(self.flat.astype(np.int64) * len(self.first) + group)
        self.column = (union % len(self.first)).astype(np.int32)
        self.row = np.searchsorted(union // len(self.first), np.arange(len(self.vocabulary) + 1))
        self.least = np.minimum.reduceat(self.sizes, self.first)
        self.mask = np.zeros(len(self.vocabulary), bool)

    def locate(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, tokens), len(self.vocabulary) - 1)
        return at[self.vocabulary[at] == tokens]

    def qualifying(self, found: np.ndarray, n: int) -> np.ndarray:
        """Subgroups whose union could hold a member that links with a query of n shingles."""
        if not len(found):
            return np.zeros(0, int)
        starts, counts = self.row[found], self.row[found + 1] - self.row[found]
        at = np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        bound = np.bincount(self.column[at], minlength=len(self.first))
        return np.flatnonzero(5 * bound >= 4 * np.maximum(n, self.least))

    def overlaps(self, group: int, found: np.ndarray) -> np.ndarray:
        """Exact overlaps of a subgroup's members (in order) with the located query."""
        a, b = self.first[group], self.last[group]
        self.mask[found] = True
        hit = self.mask[self.flat[self.begin[a] : self.begin[b]]]
        self.mask[found] = False
        return np.add.reduceat(hit, self.begin[a:b] - self.begin[a], dtype=np.int64)


class Block:
    """A block's members, and queries against them one at a time; gives links that connect all that links connect.

    labels: of each member the component that it is known to belong to; equal labels aren't compared.
    """

    def __init__(self, ids: list[int], sets: list[np.ndarray], labels: list[int]):
        self.matrix = TokenGroupMatrix(sets)
        self.ids = [ids[i] for i in self.matrix.order]
        self.label = np.array([labels[i] for i in self.matrix.order], np.int64)  # by place in the matrix

    def ask(self, tokens: np.ndarray, mine: int) -> list[int]:
        """Ids of members that join a query labelled `mine` to what it isn't joined to yet."""
        matrix, label, n = self.matrix, self.label, len(tokens)
        out: list[int] = []
        found = matrix.locate(tokens)
        if 5 * len(found) < 4 * n:
            return out
        for g in matrix.qualifying(found, n):
            a, b = matrix.first[g], matrix.last[g]
            if (label[a:b] == mine).all():
                continue
            both = matrix.overlaps(g, found)
            for k in np.flatnonzero(5 * both >= 4 * (n + matrix.sizes[a:b] - both)):
                if label[a + k] != mine:
                    out.append(self.ids[a + k])
                    label[label == label[a + k]] = mine
        return out

    def inner(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        return [(self.ids[p], i) for p, k in enumerate(self.matrix.order) for i in self.ask(sets[k], int(self.label[p]))]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of home, role, rep, label, payload: members (role 0, compared with one another), targets (role 1) and, after
    either, queries (role 2)."""
    home, ids, labels, sets, inner, block, out = None, [], [], [], False, None, []

    def built() -> Block:
        made = Block(ids, sets, labels)
        if inner:
            out.extend(made.inner(sets))
        return made

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for h, role, rep, label, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
            tokens = np.frombuffer(payload.as_buffer(), _U)
            if h != home:
                if block is None and inner and len(ids) > 1:
                    built()
                home, ids, labels, sets, inner, block = h, [], [], [], False, None
            if role < 2:
                ids.append(rep)
                labels.append(label)
                sets.append(tokens.copy())
                inner |= role == 0
            elif ids:
                block = block or built()
                out.extend((rep, x) for x in block.ask(tokens, label))
        if out:
            yield batch_of()
            out.clear()
    if block is None and inner and len(ids) > 1:
        built()
    if out:
        yield batch_of()


def _compared(sent: DataFrame) -> DataFrame:
    columns = ["home", "role", "rep", "label", "payload"]
    return _grouped(sent.select(*columns), "home", ["home", "role", "rep"], _links, "a bigint, b bigint")


def _homes(members: DataFrame, by: str, most: int, per_block: int) -> DataFrame:
    """members (tie, rep, n) with home, its block, and large, whether its tie has several: at most about `most` members and `per_block` shingles each."""
    cut = lambda: F.greatest(F.ceil(F.count(F.lit(1)) / most), F.ceil(F.sum("n") / per_block), F.lit(1)).cast("int")
    whole = members.groupBy("tie").agg(cut().alias("of_tie"))
    spot = members.join(whole, "tie").withColumn("bucket", F.pmod(F.xxhash64(by), F.col("of_tie")))
    part = spot.groupBy("tie", "bucket").agg(cut().alias("of_bucket"))
    placed = spot.join(part, ["tie", "bucket"])
    # A tie that fits into one block is one bucket, and its only block.
    return placed.select(*members.columns, F.xxhash64("tie", "bucket", F.pmod(F.xxhash64("rep"), F.col("of_bucket"))).alias("home"), (F.col("of_tie") > 1).alias("large"))


def _sent(rows: DataFrame, wanted: DataFrame, size: int, inline: int) -> DataFrame:
    """rep, d1, d2 and the whole numbers of wanted (rep, d1, d2 and others) with payload, the whole set of that document."""
    few = wanted.count() <= inline  # rows of a few whole numbers each
    others = [c for c in wanted.columns if c not in ("rep", "d1", "d2")]
    names = ["rep", "d1", "d2", *others]
    met = rows.join(F.broadcast(wanted) if few else wanted, F.col("doc_id") == F.col("rep")).select(*names, "text")

    def run(batches):
        for batch, sets in _sets(batches, size, len(names)):
            at, payloads, held = [], [], 0

            def flush():
                return pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(at)) for i in range(len(names))), pa.array(payloads, pa.binary())], names=[*names, "payload"])  # noqa: B023

            for i, (d1, d2, s) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), sets, strict=True)):
                if not len(s) or digests(s) != (d1, d2):
                    continue  # another row of the same id
                at.append(i)
                payloads.append(s.tobytes())
                held += 8 * len(s)
                if held > 4_000_000:
                    yield flush()
                    at, payloads, held = [], [], 0
            if at:
                yield flush()

    return met.mapInArrow(lean(run), ", ".join(f"{n} bigint" for n in names) + ", payload binary")


def frequent_shingles(sets: DataFrame, hottest: int, portion: int = 500_000, times: int = 2) -> np.ndarray:
    """Shingles by descending count, `hottest` at most, of those that occur `times` in some portion of the sets (payload).

    Only the order of comparison hangs on them: any order that is the same for all sets gives all links.
    """

    def run(batches):
        held, total = [], 0

        def counted():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            hot = n >= times
            return pa.RecordBatch.from_arrays([pa.array(tokens[hot].view(np.int64)), pa.array(n[hot])], names=["f", "c"])

        for batch in batches:
            for v in batch.column(0):
                held.append(np.frombuffer(v.as_buffer(), _U).copy())
                total += len(held[-1])
                if total > portion:
                    yield counted()
                    held, total = [], 0
        if held:
            yield counted()

    found = sets.select("payload").mapInArrow(lean(run), "f bigint, c bigint")
    top = found.groupBy("f").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "f").limit(hottest).collect()
    return np.array([r["f"] for r in top], np.int64).view(_U)


def rare_prefixes(members: DataFrame, hot: np.ndarray) -> DataFrame:
    """f, tie, rep, n, comp, band, base: the shingles of which linked sets have 8 % of either's size in common, and one that is base for both."""
    order = np.argsort(hot)
    shared = members.sparkSession.sparkContext.broadcast((hot[order], (len(hot) - order).astype(np.int64)))

    def run(batches):
        known, rank = shared.value
        for batch in batches:
            f, sizes = [], []
            for v in batch.column(4):
                s = np.frombuffer(v.as_buffer(), _U)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[at] == s, rank[at], 0), kind="stable")]  # rare ones first, by hash
                f.append(s[: prefix_length(len(s))])
                sizes.append(len(f[-1]))
            if f:
                spread = np.repeat(np.arange(len(f)), sizes)
                n = batch.column(2).to_numpy()
                band = size_bands(n).astype(np.int32)[spread]
                base = np.concatenate([np.arange(k) < base_length(int(m)) for k, m in zip(sizes, n, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f).view(np.int64)), *(batch.column(i).take(pa.array(spread)) for i in range(4)), pa.array(band), pa.array(base)], names=["f", *batch.schema.names[:4], "band", "base"])

    return members.select("tie", "rep", "n", "comp", "payload").mapInArrow(lean(run), "f bigint, tie bigint, rep bigint, n bigint, comp bigint, band int, base boolean")


def _crossing(prefixes: DataFrame) -> DataFrame:
    """Rows of prefixes whose shingle another component of the tie has too, of the members with enough of them; one row each at most."""
    several = prefixes.groupBy("f", "tie").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min("n").alias("n1"), F.max("n").alias("n2")).where("c1 <> c2")
    met = written(prefixes.join(several, ["f", "tie"]).where("4 * n <= 5 * n2 AND 4 * n1 <= 5 * n").select(*prefixes.columns), "met")
    enough = met.groupBy("rep").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n")).where("25 * m >= 2 * n").select("rep")
    out = written(met.join(enough, "rep", "left_semi").select(*prefixes.columns), "crossing")
    dropped(met)
    return out


def _labelled(members: DataFrame, components: DataFrame) -> DataFrame:
    out = members.join(components.select(F.col("node").alias("rep"), F.col("component")), "rep", "left")
    return out.withColumn("comp", F.coalesce("component", "rep")).drop("component")


def _unsettled(state: DataFrame) -> DataFrame:
    """tie of the large groups that are in more than one component."""
    each = state.groupBy("tie").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
    return each.where("x <> y").select("tie")


def _between_blocks(rows: DataFrame, large: DataFrame, links: DataFrame, size: int, most: int, per_block: int, inline: int, hottest: int) -> list[DataFrame]:
    """Written tables of further links of groups of several blocks.  large: rep, d1, d2, tie, n, m1, m2."""
    made: list[DataFrame] = []
    # One member of each component, in other blocks.
    state = _labelled(large, connected_components(links))
    hubs = state.join(_unsettled(state), "tie", "left_semi").groupBy("tie", "comp").agg(F.min(F.struct("rep", "n", "m2", "d1", "d2")).alias("hub")).select("tie", "hub.*")
    hubs = written(_homes(hubs, "m2", most, per_block).select("rep", "d1", "d2", "home"), "hubs")
    sent = _sent(rows, hubs, size, inline).select("home", F.lit(0).alias("role"), "rep", F.col("rep").alias("label"), "payload")
    made.append(written(_compared(sent), "links"))
    dropped(hubs)
    # The rest exactly.
    state = _labelled(large, connected_components(links.unionByName(made[0])))
    open_ = written(state.join(_unsettled(state), "tie", "left_semi").select("rep", "d1", "d2", "tie", "n", "comp", "m1"), "open")
    if not open_.limit(1).count():
        dropped(open_)
        return made
    small = lambda t: F.broadcast(t) if t.count() <= inline else t
    full = written(_sent(rows, open_, size, inline), "full")
    prefixes = written(rare_prefixes(full, frequent_shingles(full, hottest)), "prefixes")
    crossing = _crossing(prefixes)
    dropped(open_, prefixes)
    again = connected_components(_stars(crossing.where("base"), ["f", "tie"], "rep")).select(F.col("node").alias("rep"), F.col("component").alias("tie"))
    placed = written(_homes(full.select("rep", "n", "m1", "comp").join(small(again), "rep").distinct(), "m1", most, per_block), "placed")
    payloads = full.select("rep", "payload")
    sent = payloads.join(small(placed.select("home", "rep", "comp")), "rep").select("home", F.lit(0).alias("role"), "rep", F.col("comp").alias("label"), "payload")
    large = placed.where("large").select("rep", F.col("tie").alias("part"), "home")
    asked = None
    if large.limit(1).count():
        spots = crossing.join(small(large), "rep")
        there = spots.groupBy("f", "part", "home").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min("n").alias("n1"), F.max("n").alias("n2"))
        met = spots.select("f", "part", "rep", "n", "comp", F.col("home").alias("own")).join(there, ["f", "part"])
        met = met.where("home < own AND NOT (c1 = comp AND c2 = comp) AND 4 * n <= 5 * n2 AND 4 * n1 <= 5 * n")
        asked = written(met.groupBy("rep", "comp", "home").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n")).where("25 * m >= 2 * n").select("rep", "comp", "home"), "asked")
        sent = sent.unionByName(payloads.join(small(asked), "rep").select("home", F.lit(2).alias("role"), "rep", F.col("comp").alias("label"), "payload"))
    made.append(written(_compared(sent), "links"))
    dropped(full, crossing, placed, *([] if asked is None else [asked]))
    return made


def similar_components(docs: DataFrame, *, size: int = 5, doc_id: str = "doc_id", text: str = "text", most: int = 768, per_block: int = 400_000, inline: int = 400_000, per_range: int = 250_000, hottest: int = 200_000) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links of similarity 0.8 or more)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    with arrow_batches(spark):
        signed = written(signatures(rows, size), "signatures")
        total = signed.agg(F.sum("n")).first()[0] or 0
        bits = min(24, max(4, math.ceil(math.log2(max(1, 0.3 * total / per_range)))))
        shared = written(shared_prefixes(rows, size, bits), "shared")
        enough, pairs = ties(shared)
        tied = connected_components(pairs)
        dropped(shared)
        classes = signed.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.first("m1").alias("m1"), F.first("m2").alias("m2"))
        grouped = classes.join(tied.select(F.col("node").alias("d1"), F.col("component").alias("tie")), "d1")
        members = written(_homes(grouped.select("rep", "d1", "d2", "tie", "n", "m1", "m2"), "m1", most, per_block), "members")
        dropped(enough)
        sent = _sent(rows, members.select("rep", "d1", "d2", "home"), size, inline).select("home", F.lit(0).alias("role"), "rep", F.col("rep").alias("label"), "payload")
        links = written(_compared(sent), "links")
        found = [links]
        large = members.where("large").select("rep", "d1", "d2", "tie", "n", "m1", "m2")
        if large.limit(1).count():
            found += _between_blocks(rows, large, links, size, most, per_block, inline, hottest)
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        joined = connected_components(every)
        dropped(members, *found)
    spread = classes.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component"))
    return signed.select("doc_id", "n", "d1", "d2").join(spread, ["d1", "d2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
