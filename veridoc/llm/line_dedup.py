"""Line dedup by a deletion-neighbourhood join, keeping the earliest of equal and nearly equal lines.

A line (between newlines) is its sequence of words.  Order is (doc_id, hash of the text, line number).  A line is dropped if an earlier line has
the same words, or, for lines of `near_words` words and more, if its words become an earlier line's by at most one
edit (a word put in, left out or exchanged).  Lines of fewer than `least_words` words always stay; with WHOLE, which
the query and the pipeline use, every line with a word takes part, and lines of five words and more match nearly.

1. Equal lines: each distinct sequence's earliest place (one aggregation on a 128-bit hash).
2. Suspects: two sequences within one edit have equal first or equal second halves (of the shorter one's length), so only
   distinct lines that share a half's hash with another can have a neighbour.  Four keys a line find them.
3. Neighbourhood: suspects emit every deletion variant as a hashed key: for an exchange, the line without word i together
   with i and the length; for a word put in or left out, the line without word i against the whole shorter line.  Only
   the half in which the edit must be is varied.  Two lines that each become the same shorter one by leaving out different
   words are two edits apart, so a key's whole line and its variants are kept apart: the whole line's partner is the
   earliest variant's line, each variant's partner the whole line.  Lines that share an exchange's key are all within one
   edit; their partner is the earliest (aggregations, no pairs).
4. Each (line, key's partner) is verified on the words' own hashes, and a line goes if any of them holds; then texts are
   written without the dropped lines.

An earlier line counts whether or not it stays itself, so a chain of lines, each one word from the one before, goes but for its
first: "keep earliest" then needs no order of decisions, and which lines go doesn't hang on how the table is split.  The
bound is one word at any length: lines with two changed words stay.

Scale: a line that holds a third of all lines is summed before each shuffle, and joins on a line's or variant's key are
ones that can be split.  Documents are read three times and only shuffled if more than `inline` lines are
concerned (below, their numbers are broadcast).

Defined cases: null text stays null, empty text empty, and neither has lines; blank lines stay; repeated rows of one doc_id and
text are one place and get the same result, rows of one doc_id with other texts have places of their own; rows without a doc_id stay as they are; ties can't arise (a
place is unique); texts and lines of any length are taken whole; an empty table returns no rows; doc_id is a whole number
(bigint); all columns of the input are returned whatever their names, n_chars brought up to date, but for those called as
the `counts`, whose place the result's take.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_batches, dropped, lean, unused, written

#: Parameters of the whole job.
WHOLE = {"least_words": 1, "near_words": 5}
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


#: What tells a row's text from others, and a line from others.
_TEXT, _PLACE = ["doc_id", "th"], ["doc_id", "th", "line"]


def text_hash(text: Column) -> Column:
    """60 bits of the text's MD5, which SQL engines share."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _key(words: list[bytes], kind: bytes, n: int) -> int:
    return _signed(xxhash.xxh3_64_intdigest(kind + n.to_bytes(4, "little") + b" ".join(words)))


def half_keys(words: list[bytes]) -> list[int]:
    """Halves as a line of its own length (first, second) and as the longer one of a pair (first, second)."""
    n = len(words)
    out = []
    for m in (n, n - 1):
        p = m // 2
        out += [_key(words[:p], b"first", m), _key(words[n - (m - p) :], b"second", m)]
    return out


def lines_of(docs: DataFrame, least_words: int, near_words: int) -> DataFrame:
    """doc_id, th, line, n, h, g (128-bit hash of the words), halves (null for short lines) of lines of least_words and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for i, line in enumerate((text.as_py() or "").encode().split(b"\n")):
                    words = line.split()
                    if len(words) >= least_words:
                        whole = xxhash.xxh3_128_intdigest(b" ".join(words))
                        out.append((doc, th, i, len(words), _signed(whole >> 64), _signed(whole & (1 << 64) - 1), half_keys(words) if len(words) >= near_words else None))
                if len(out) > 50_000:
                    yield _batch(out, _LINES)
                    out = []
            if out:
                yield _batch(out, _LINES)

    return docs.mapInArrow(lean(run), "doc_id bigint, th bigint, line int, n int, h bigint, g bigint, halves array<bigint>")


_LINES = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("line", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("g", pa.int64()), ("halves", pa.list_(pa.int64()))])
_VARIANTS = pa.schema([("key", pa.int64()), ("kind", pa.int8()), ("doc_id", pa.int64()), ("th", pa.int64()), ("line", pa.int32())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _small(lists: DataFrame, inline: int) -> DataFrame:
    """lists (doc_id, th, lines and a few numbers), to be broadcast if they have at most `inline` lines in all."""
    return F.broadcast(lists) if (lists.agg(F.sum(F.size("lines"))).first()[0] or 0) <= inline else lists


def _word_hashes(docs: DataFrame, at: DataFrame, inline: int) -> DataFrame:
    """doc_id, th, line, flags, words (hashes in order) of the lines that at (doc_id, th, lines: array of line, flags) names."""
    rows = docs.join(_small(at, inline), _TEXT).select(*_TEXT, "text", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("line", pa.int32()), ("flags", pa.int32()), ("words", pa.list_(pa.int64()))])
        for batch in batches:
            out = []
            for doc, th, text, lines in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = (text or "").encode().split(b"\n")
                out += [(doc, th, x["line"], x["flags"], [_signed(xxhash.xxh3_64_intdigest(w)) for w in own[x["line"]].split()]) for x in lines if x["line"] < len(own)]
                if len(out) > 5_000:
                    yield _batch(out, schema)
                    out = []
            if out:
                yield _batch(out, schema)

    return rows.mapInArrow(lean(run), "doc_id bigint, th bigint, line int, flags int, words array<bigint>")


#: Kinds of keys: a whole line, a line without a word, a line without a word whose place and length count.
_WHOLE, _SHORTER, _EXCHANGE = 0, 1, 2


def variant_keys(words: np.ndarray, flags: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed keys of a line and their kinds: itself, its one-word deletions against shorter lines, and with place and length for exchanges.

    flags: 1 if a first half is shared (so the second may be edited), 2 if a second half is.
    """
    n = len(words)
    with np.errstate(over="ignore"):
        w = words.astype(_U) | _U(1)
        power = np.r_[_U(1), np.cumprod(np.full(n, _BASE, _U), dtype=_U)]
        terms = w * power[n - 1 :: -1][:n] if n else w
        # Before i the terms lose one power of the base (times its inverse), after i they stay.
        inverse = _U(pow(_BASE, -1, 1 << 64))
        before = np.r_[_U(0), np.cumsum(terms, dtype=_U)]
        whole = before[-1]
        without = before[:-1] * inverse + (whole - before[1:])
        # One word of slack: the middle differs between n and n - 1 words.
        edit = np.arange(0 if flags & 2 else n // 2 - 1, n if flags & 1 else n // 2 + 1)
        without = without[edit]

        def mixed(x, length, place):
            x = x ^ (_U(length) * _U(0xC2B2AE3D27D4EB4F)) ^ ((place + _U(1)) * _U(0x165667B19E3779F9))
            x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
            return x ^ (x >> _U(29))

        alone = _U((1 << 40) - 1)
        shorter = np.unique(mixed(without, n - 1, alone))
        keys = np.r_[mixed(np.array([whole]), n, alone), shorter, mixed(without, n, edit.astype(_U))].view(np.int64)
        return keys, np.repeat(np.array([_WHOLE, _SHORTER, _EXCHANGE], np.int8), [1, len(shorter), len(edit)])


def _variants(suspects: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, th, line, flags, words in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                keys, kinds = variant_keys(words.values.to_numpy(), flags)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(kinds), pa.array(np.full(len(keys), doc, np.int64)), pa.array(np.full(len(keys), th, np.int64)), pa.array(np.full(len(keys), line, np.int32))], schema=_VARIANTS)

    return suspects.mapInArrow(lean(_merged(run, 100_000)), "key bigint, kind tinyint, doc_id bigint, th bigint, line int")


def _merged(run, rows: int):
    """Joins the small batches that run makes."""

    def out(batches):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return out


def within_one_edit(a: list, b: list) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _verified(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [within_one_edit(a, b) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(list(batch.columns[:3]), names=["doc_id", "th", "line"]).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(lean(run), "doc_id bigint, th bigint, line int")


def dropped_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_words: int = 5, near_words: int = 10, inline: int = 1_000_000) -> DataFrame:
    """doc_id, th, lines (sorted line numbers to drop), n_near (how many of them only nearly equal an earlier one)."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_hash(F.col(text)).alias("th"), F.col(text).alias("text")).where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    lines = written(lines_of(rows, least_words, near_words), "lines")
    place = F.struct(*_PLACE)
    firsts = written(lines.groupBy("h", "g").agg(F.min(place).alias("first"), F.first("halves").alias("halves")), "firsts")
    halves = firsts.where(F.col("halves").isNotNull()).select("first", F.posexplode("halves").alias("kind", "key"))
    # A line's keys as itself and as the longer one may agree: only other lines count.
    shared = halves.groupBy("key").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a != b").select("key")
    flags = halves.join(shared, "key").groupBy("first").agg(F.max(F.when(F.col("kind") % 2 == 0, 1).otherwise(0)).alias("p"), F.max(F.when(F.col("kind") % 2 == 1, 2).otherwise(0)).alias("s"))
    at = written(flags.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th")).agg(F.collect_set(F.struct(F.col("first.line").alias("line"), (F.col("p") + F.col("s")).alias("flags"))).alias("lines")), "at")
    suspects = written(_word_hashes(rows, at, inline).dropDuplicates(_PLACE), "suspects")
    variants = written(_variants(suspects), "variants")
    first = lambda kind: F.min(F.when(F.col("kind") == kind, place))
    earliest = variants.groupBy("key").agg(first(_WHOLE).alias("whole"), first(_SHORTER).alias("shorter"), first(_EXCHANGE).alias("exchanged"), F.max(place).alias("latest"))
    earliest = earliest.where((F.col("whole").isNotNull() & F.col("shorter").isNotNull()) | (F.col("exchanged") != F.col("latest"))).drop("latest")
    partner = F.when(F.col("kind") == _WHOLE, F.col("shorter")).when(F.col("kind") == _SHORTER, F.col("whole")).otherwise(F.col("exchanged"))
    partners = variants.join(earliest, "key").withColumn("partner", partner).where(F.col("partner") < place).select(*_PLACE, "partner").distinct()
    of = suspects.select(F.col("doc_id").alias("p_doc"), F.col("th").alias("p_th"), F.col("line").alias("p_line"), F.col("words").alias("p_words"))
    pairs = partners.join(suspects, _PLACE).join(of, (F.col("partner.doc_id") == F.col("p_doc")) & (F.col("partner.th") == F.col("p_th")) & (F.col("partner.line") == F.col("p_line"))).select(*_PLACE, "words", "p_words")
    near = written(_verified(pairs), "near")
    repeats = lines.join(firsts.select("h", "g", "first"), ["h", "g"]).where(place != F.col("first")).select(*_PLACE, F.lit(0).alias("near"))
    every = repeats.unionByName(near.withColumn("near", F.lit(1)))
    out = written(every.groupBy(*_PLACE).agg(F.max("near").alias("near")).groupBy(*_TEXT).agg(F.array_sort(F.collect_list("line")).alias("lines"), F.sum("near").alias("n_near")), "drop")
    for passed in (lines, firsts, at, suspects, variants, near):
        dropped(passed)
    return out


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", inline: int = 1_000_000, counts: tuple[str, str, str] = ("n_lines", "n_dropped", "n_near"), **more) -> DataFrame:
    """docs with the kept lines as text (n_chars brought up to date) and, beside its columns, the counts of lines, dropped and nearly equal ones."""
    at, of, lines, near, new = (unused(docs.columns, n) for n in ("id", "of", "lines", "near", "new"))
    with arrow_batches(docs.sparkSession):
        found = dropped_lines(docs, doc_id=doc_id, text=text, inline=inline, **more)
    drop = _small(found, inline).withColumnsRenamed({"doc_id": at, "th": of, "lines": lines, "n_near": near})
    joined = docs.join(drop, (F.col(doc_id).cast("bigint") == F.col(at)) & (text_hash(F.col(text)) == F.col(of)), "left")
    parts = F.split(F.col(text), "\n", -1)
    # The runs between dropped lines, in one sweep: a long text may lose many.
    ends = F.concat(F.col(lines), F.array(F.size(parts)))
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), F.col(lines)), ends, lambda a, b: F.slice(parts, a + 2, b - a - 1))
    kept = F.when(F.col(lines).isNull(), F.col(text)).otherwise(F.array_join(F.flatten(runs), "\n"))
    joined = joined.withColumn(new, kept)
    changed = {text: F.col(new)} | ({"n_chars": F.char_length(new).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    names = [F.col(c) if c not in changed else changed[c].alias(c) for c in docs.columns if c not in counts]
    values = [F.size(parts), F.coalesce(F.size(lines), F.lit(0)), F.coalesce(near, F.lit(0))]
    return joined.select(*names, *[c.cast("bigint").alias(n) for c, n in zip(values, counts, strict=True)])
