"""Suffix-array dedup: bytes covered by a string of `least` bytes that starts anywhere else too.

A full suffix array holds every byte's suffix.  Here it is sparse: suffixes start at anchors, and an anchor depends on nothing but
the `least` bytes around it, so equal strings have equal anchors at equal offsets.

1. The anchor of a string of `least` bytes is the place of its smallest hash of 17 bytes (the first of equals).  The
   strings that share an anchor are cut by their offset to it into nodes of 192 neighbours.  All strings of a node share a
   core (209 bytes) and lie within its hull (591 bytes).
2. Nodes are sorted as suffixes: sampled splitters range-partition them by their leading tokens, each bucket sorts its own by a
   multikey quicksort (token by token, three ways), neighbours are compared, and so are a bucket's first and
   last with the next bucket's.  A token stands for many bytes: the first eight of the stretch, then fingerprints of it.
3. A node whose core occurs once is done (nothing in it repeats).  Of the others, those whose hull occurs again repeat as a
   whole.  The rest, mostly at the ends of repeated passages, are cut into nodes of 16 strings and sorted again, then into single
   strings, where core and hull are one; one whole node of each content goes with them, if it shares a core with one of the
   rest.  So the work on finer nodes grows with the number of passages' ends.
4. The repeated nodes' bytes are merged to spans in each document and cut out.

Cores are compared by their first eight bytes and 64-bit fingerprints (a collision only leaves a node undecided), hulls and single
strings by their first eight bytes and 128 bits of fingerprints.

Scale: what is sorted is about a node for every 130 bytes, and less at each finer step; texts are not shuffled while fewer than
`inline` nodes or spans are concerned (their lists are broadcast), beyond that they are shuffled by document.  Equal
suffixes are also ordered by their places, so copies by the thousand spread over buckets; buckets hold about `bucket`
rows.  The driver sees two rows a bucket.  Each step is a written table.

Defined cases: null and empty texts have no bytes and stay as they are; texts shorter than `least` keep all bytes; very long texts
are worked through in slices; a string counts wherever it starts, in rows with equal doc_id and text as well (both lose all
their bytes); overlapping repeats within one document count; matches never cross documents; kept bytes may begin or end
inside a character, so they are binary; an empty table returns no rows; rows without a doc_id take part; other columns,
whatever their names, aren't returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import arrow_batches, dropped, lean, written

#: Bytes of an anchor's hash.
GRAM = 17
_U = np.uint64
#: Two odd bases with a random value for each byte.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_VALUES = [np.random.default_rng(7 + i).integers(0, 1 << 63, 256, np.int64).astype(_U) * _U(2) + _U(1) for i in range(2)]
_SLICE = 1 << 17


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


class Prints:
    """Fingerprints of stretches of a buffer in constant time each."""

    tables: dict[int, tuple] = {}

    def __init__(self, data: np.ndarray, kinds: int = 2):
        n = len(data) + 1
        size = 1 << max(12, n.bit_length())
        if size not in self.tables:
            self.tables[size] = tuple((_powers(b, size), _powers(pow(b, -1, 1 << 64), size)) for b in _BASES)
        self.data, self.sums, self.inverse = data, [], []
        for values, (power, inverse) in list(zip(_VALUES, self.tables[size], strict=True))[:kinds]:
            sums = np.zeros(n, _U)
            np.cumsum(values[data] * power[: n - 1], dtype=_U, out=sums[1:])
            self.sums.append(sums)
            self.inverse.append(inverse)

    def of(self, begin: np.ndarray, end: np.ndarray, kind: int) -> np.ndarray:
        x = (self.sums[kind][end] - self.sums[kind][begin]) * self.inverse[kind][begin]
        x = (x ^ (x >> _U(32))) * _U(0xBF58476D1CE4E5B9)
        return (x ^ (x >> _U(29))).view(np.int64)

    def leading(self, begin: np.ndarray) -> np.ndarray:
        """The first eight bytes, as a number that orders like they do."""
        out = np.zeros(len(begin), _U)
        for i in range(8):
            out = (out << _U(8)) | self.data[begin + i].astype(_U)
        return (out ^ _U(1 << 63)).view(np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values (forward and backward minima of blocks of that width)."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors_of(prints: Prints, n: int, least: int) -> np.ndarray:
    """The anchor of each of the n - least + 1 strings of `least` bytes in a buffer of n bytes."""
    at = np.arange(n - GRAM + 1, dtype=np.int64)
    order = prints.of(at, at + GRAM, 0).view(_U)
    keyed = (order & _U(0xFFFFFFFF00000000)) | at.astype(_U)
    return (sliding_min(keyed, least - GRAM + 1) & _U(0xFFFFFFFF)).astype(np.int64)


def nodes_of(data: np.ndarray, ends: np.ndarray, least: int, width: int, slice_bytes: int = _SLICE) -> Iterator[tuple[Prints, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(fingerprints, their first byte, text, anchor and first offset of each node) of texts that end at `ends` in data."""
    n, last = len(data), None
    for first in range(0, max(0, n - least + 1), slice_bytes):
        stop = min(first + slice_bytes, n - least + 1)
        low, high = max(0, first - least), min(n, stop + 2 * least)
        prints = Prints(data[low:high])
        anchor = anchors_of(prints, high - low, least)[first - low : stop - low] + low
        at = np.arange(first, stop)
        text = np.searchsorted(ends, at, side="right")
        inside = at + least <= ends[text]
        offset = (anchor - at) // width
        key = np.where(inside, anchor * (least // width + 1) + offset, -1)
        new = np.r_[True, key[1:] != key[:-1]]
        if last is not None and key[0] == last:
            new[0] = False
        last = key[-1]
        chosen = np.flatnonzero(new & inside)
        if len(chosen):
            yield prints, low, text[chosen], anchor[chosen], offset[chosen] * width


#: With the offset: two anchors may have nodes of one and the same place, and equal strings have equal offsets anyway.
_TOKENS = {"core": ("c0", "c1", "first"), "hull": ("h0", "h1", "h2", "first")}
_NODE = "doc bigint, th bigint, anchor bigint, first int"
_NODES = [("doc", pa.int64()), ("th", pa.int64()), ("anchor", pa.int64()), ("first", pa.int32())]


def _described(prints: Prints, low: int, begin: np.ndarray, end: np.ndarray, anchor: np.ndarray, first: np.ndarray, width: int, least: int) -> dict[str, pa.Array]:
    """Tokens of the nodes' cores and hulls (null where a hull leaves its text)."""
    core = anchor - first - low
    core_end = core + least - width + 1
    out = {"c0": pa.array(prints.leading(core)), "c1": pa.array(prints.of(core, core_end, 0))}
    hull, hull_end = anchor - first - width + 1, anchor - first + least
    whole = (hull >= begin) & (hull_end <= end)
    a, b = np.where(whole, hull - low, 0), np.where(whole, hull_end - low, 8)
    for name, values in (("h0", prints.leading(a)), ("h1", prints.of(a, b, 0)), ("h2", prints.of(a, b, 1))):
        out[name] = pa.array(values, mask=~whole)
    return out


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, one after the other, and where each ends."""
    texts = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _table(columns: dict) -> Iterator[pa.RecordBatch]:
    yield from pa.table(columns).to_batches(max_chunksize=100_000)


def _all_nodes(rows: DataFrame, least: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _buffers(batch.column(2))
            begins = np.r_[0, ends[:-1]]
            doc, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for prints, low, text, anchor, first in nodes_of(data, ends, least, width):
                tokens = _described(prints, low, begins[text], ends[text], anchor, first, width, least)
                yield from _table({"doc": doc[text], "th": th[text], "anchor": anchor - begins[text], "first": first.astype(np.int32)} | tokens)

    return rows.mapInArrow(lean(run), f"{_NODE}, c0 bigint, c1 bigint, h0 bigint, h1 bigint, h2 bigint")


def _finer_nodes(rows: DataFrame, open_nodes: DataFrame, least: int, width: int, finer: int, inline: int) -> DataFrame:
    """The nodes of `finer` strings inside open_nodes, which are `width` wide."""
    lists = open_nodes.groupBy("doc", "th").agg(F.collect_set(F.struct("anchor", "first")).alias("open"))
    found = rows.join(_listed(lists, "open", inline), ["doc", "th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, th, text, opened in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3), strict=True):
                data, end = _buffers(pa.array([text.as_py()], pa.large_string()))
                chosen = opened.values
                anchors, firsts = chosen.field("anchor").to_numpy(), chosen.field("first").to_numpy()
                wanted = np.sort(anchors * (least + 1) + firsts)
                # Only slices with an open node: its strings begin within a node before its anchor.
                for low, high in _stretches(anchors - firsts - width + 1, anchors - firsts + 1, least, int(end[0])):
                    for prints, at, _, anchor, first in nodes_of(data[low:high], np.array([high - low]), least, finer):
                        anchor = anchor + low
                        key = anchor * (least + 1) + first // width * width
                        keep = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
                        anchor, first = anchor[keep], first[keep]
                        if len(anchor):
                            tokens = _described(prints, at + low, np.full(len(anchor), low), np.full(len(anchor), high), anchor, first, finer, least)
                            yield from _table({"doc": np.full(len(anchor), doc.as_py()), "th": np.full(len(anchor), th.as_py()), "anchor": anchor, "first": first.astype(np.int32)} | tokens)

    return found.mapInArrow(lean(_joined(run)), f"{_NODE}, c0 bigint, c1 bigint, h0 bigint, h1 bigint, h2 bigint")


def _stretches(begin: np.ndarray, end: np.ndarray, least: int, n: int) -> list[tuple[int, int]]:
    """Parts of a text of n bytes that hold all strings starting in [begin, end), with a string's length to each side."""
    order = np.argsort(begin)
    out: list[list[int]] = []
    for a, b in zip(np.maximum(begin[order] - least, 0).tolist(), np.minimum(end[order] + 2 * least, n).tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _joined(run):
    """Puts small batches together."""

    def out(batches):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n > 50_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return out


def _listed(lists: DataFrame, column: str, inline: int) -> DataFrame:
    """lists, broadcast if they have at most `inline` entries in all."""
    lists = written(lists, "lists")
    return F.broadcast(lists) if (lists.agg(F.sum(F.size(column) + 2)).first()[0] or 0) <= inline else lists


def multikey_order(tokens: list[np.ndarray], small: int = 4096) -> np.ndarray:
    """Indices that sort rows of tokens: three-way partitions by a pivot token, equal rows going on with the next token."""
    n = len(tokens[0])
    out = np.arange(n)
    left = [(0, n, 0)]
    while left:
        a, b, depth = left.pop()
        own = out[a:b]
        if b - a <= small:
            out[a:b] = own[np.lexsort([t[own] for t in reversed(tokens[depth:])])]
            continue
        values = tokens[depth][own]
        some = np.sort(values[:: max(1, (b - a) // 127)])
        pivot = some[len(some) // 2]
        less, same = values < pivot, values == pivot
        below, equal = int(less.sum()), int(same.sum())
        out[a:b] = np.concatenate([own[less], own[same], own[~(less | same)]])
        left.append((a, a + below, depth))
        if depth + 1 < len(tokens):
            left.append((a + below, a + below + equal, depth + 1))
        left.append((a + below + equal, b, depth))
    return out


def repeated(suffixes: DataFrame, tokens: tuple[str, ...], bucket: int = 400_000) -> DataFrame:
    """The rows of suffixes (a written table) whose tokens another row has too."""
    spark = suffixes.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(suffixes.count() / bucket))
    names, fields = list(tokens), suffixes.columns
    # By place as well, so that equal suffixes don't have to meet in one bucket.
    dealt = suffixes.repartitionByRange(n, *names, "doc", "anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        columns = [rows[t].to_numpy() for t in names]
        order = multikey_order(columns)
        same = np.ones(len(order) - 1, bool)
        for c in columns:
            same &= c[order[1:]] == c[order[:-1]]
        again = np.r_[same, False] | np.r_[False, same]
        bucket_no = TaskContext.get().partitionId()
        edge = np.zeros(len(order), np.int64)
        edge[0] += 1
        edge[-1] += 2
        keep = again | (edge > 0)
        rows = rows.take(pa.array(order[keep]))
        rows = rows.append_column("again", pa.array(again[keep])).append_column("edge", pa.array(np.where(edge[keep] > 0, bucket_no * 4 + edge[keep], 0)))
        yield from rows.combine_chunks().to_batches(max_chunksize=100_000)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in suffixes.schema.fields)
    out = written(dealt.mapInArrow(lean(run), f"{kinds}, again boolean, edge bigint"), "sorted")
    ends = sorted(out.where("edge > 0").select("edge", *names).collect())  # two rows a bucket
    first = {r.edge >> 2: r for r in ends if r.edge & 1}
    last = {r.edge >> 2: r for r in ends if r.edge & 2}
    met, before = set(), None
    for no in sorted(first):
        if before is not None and last[before][1:] == first[no][1:]:
            met |= {last[before].edge, first[no].edge}
        before = no
    across = F.col("edge").isin(*met) if met else F.lit(False)
    return out.where(F.col("again") | across).select(*fields)


def _span(width: int, least: int) -> list:
    begin = F.col("anchor") - F.col("first") - (width - 1)
    return [F.col("doc"), F.col("th"), begin.alias("begin"), (begin + (width - 1) + least).alias("end")]


def repeated_spans(rows: DataFrame, least: int, widths: tuple[int, ...], inline: int) -> DataFrame:
    """doc, th, begin, end of stretches that repeat, overlapping ones not yet merged, of rows (doc, th, text)."""
    found, open_nodes, before = None, None, 0
    for width in widths:
        made = _all_nodes(rows, least, width) if open_nodes is None else _finer_nodes(rows, open_nodes, least, before, width, inline)
        nodes = written(made, f"nodes-{width}")
        node = ["doc", "th", "anchor", "first"]
        if width == 1:  # the string itself
            whole = repeated(nodes.select(*node, "h0", "h1", "h2"), _TOKENS["hull"])
        else:
            alive = written(repeated(nodes, _TOKENS["core"]), "alive")
            whole = written(repeated(alive.where("h0 IS NOT NULL"), _TOKENS["hull"]), "whole")
            rest = written(alive.select(*node, "c0", "c1").join(whole.select(*node), node, "left_anti"), "rest")
            # Of nodes that repeat as a whole, one of each kind stays for the sake of those that share its core.
            cores = written(rest.select(*_TOKENS["core"]).distinct(), "cores")
            kinds = whole.groupBy(*_TOKENS["hull"]).agg(F.min(F.struct("doc", "th", "anchor")).alias("one"), F.min("c0").alias("c0"), F.min("c1").alias("c1"))
            kinds = kinds.join(cores, list(_TOKENS["core"]), "left_semi").select("one.*", "first")
            open_nodes = written(rest.select(*node).unionByName(kinds), "open")
            dropped(nodes)
        spans = whole.select(*_span(width, least))
        found = spans if found is None else found.unionByName(spans)
        before = width
    return found


_SPANS = "spans array<struct<begin: bigint, end: bigint>>"
_SPAN_LIST = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's stretches (doc, th, found) as maximal ones in order."""
    for batch in batches:
        out = []
        for found in batch.column(2):
            values = found.values
            begin, end = values.field("begin").to_numpy(), values.field("end").to_numpy()
            order = np.argsort(begin, kind="stable")
            begin, reach = begin[order], np.maximum.accumulate(end[order])
            new = np.r_[True, begin[1:] > reach[:-1]]
            last = np.r_[np.flatnonzero(new)[1:] - 1, len(begin) - 1]
            out.append([{"begin": a, "end": b} for a, b in zip(begin[new].tolist(), reach[last].tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, _SPAN_LIST)], names=["doc", "th", "spans"])


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 400, widths: tuple[int, ...] = (192, 16, 1), inline: int = 2_000_000) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans, spans (array of begin, end in bytes).

    least: 32 or more.  widths: strings a node, from coarse to fine, each a multiple of the next, the last 1, the first under
    least - 16.
    """
    if widths[-1] != 1 or any(a % b for a, b in zip(widths, widths[1:], strict=False)) or widths[0] > least - GRAM or least < 32:
        raise ValueError("widths must divide each other down to 1 and fit into a string")
    ids = F.col(doc_id)
    base = docs.select(F.coalesce(ids.cast("bigint"), F.lit(0)).alias("doc"), F.xxhash64(text, F.isnull(ids)).alias("th"), F.col(text).alias("text"), ids.alias("doc_id"))
    with arrow_batches(docs.sparkSession, size="2m"):
        spans = repeated_spans(base.select("doc", "th", "text"), least, widths, inline)
        lists = spans.groupBy("doc", "th").agg(F.collect_set(F.struct("begin", "end")).alias("found")).mapInArrow(_merged, f"doc bigint, th bigint, {_SPANS}")
        lists = _listed(lists, "spans", inline)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, gone, spans = [], [], [], []
            for value, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data, found = value.as_py().encode() if value.is_valid else b"", found or []
                stops = [0, *[x for m in found for x in (m["begin"], m["end"])], len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(stops[::2], stops[1::2], strict=True)) if value.is_valid else None)
                sizes.append(len(data))
                gone.append(sum(m["end"] - m["begin"] for m in found))
                spans.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(map(len, spans), pa.int64()), pa.array(spans, _SPAN_LIST)], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "spans"])

    joined = base.join(lists, ["doc", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(lean(run), f"doc_id {dict(base.dtypes)['doc_id']}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, {_SPANS}")
