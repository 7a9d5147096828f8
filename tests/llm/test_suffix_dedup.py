"""Repeated substrings against a plain count of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from veridoc.llm import suffix_dedup as sd
from veridoc.llm.common import table
from veridoc.llm.queries import QUERIES


def brute(texts, least):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + least] for d in data for i in range(len(d) - least + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - least + 1):
            if seen[d[i : i + least]] > 1:
                gone[i : i + least] = True
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        out.append((len(d), int(gone.sum()), len(edges) // 2, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def texts(seed, n=40, word=6):
    rng = random.Random(seed)
    rand = lambda k: "".join(rng.choice("abcdé \n") for _ in range(k))
    passages = [rand(rng.choice([30, 64, 90, 200, 400])) for _ in range(6)]
    out = [None, "", "short", "a" * 500, "a" * 300, "ab" * 200, "xyz" * 40 + "q" + "xyz" * 50]
    while len(out) < n:
        parts = [rand(rng.randint(0, 150)) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p))
            parts.insert(rng.randint(0, len(parts)), p if rng.random() < 0.5 else p[a:] if rng.random() < 0.5 else p[:a])
        out.append("".join(parts))
        if rng.random() < 0.3:
            out.append(out[-1])
    return out


def frame(spark, values):
    rows = [(None if i == 9 else i // 2 if i > 30 else i, t, "en", f"th{i}") for i, t in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, th string"), rows


@pytest.mark.parametrize("seed,widths,bucket", [(1, (32, 8, 1), 400_000), (2, (40, 1), 50), (3, (16, 4, 1), 7)])
def test_against_brute_force(spark, monkeypatch, seed, widths, bucket):
    monkeypatch.setattr(sd.repeated, "__defaults__", (bucket,))
    values = texts(seed)
    df, rows = frame(spark, values)
    out = sd.dedup_substrings(df.repartition(3), least=64, widths=widths, inline=0 if seed == 2 else 10**6).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept or b"").hexdigest()) for r in out)
    assert got == sorted((str(r[0]), *b) for r, b in zip(rows, brute(values, 64), strict=True))
    assert sum(b[1] for b in brute(values, 64)) > 2000
    assert all((r.kept is None) == (values_null is None) for r, values_null in [(r, None) for r in out if r.kept is None])


def test_slices_and_long_texts(spark):
    """Anchors and nodes don't hang on where slices begin."""
    rng = np.random.default_rng(5)
    data = rng.integers(97, 101, 9000).astype(np.uint8)
    data[3000:3600] = 97
    ends = np.array([4000, 4000, 9000])
    for width in (192, 16, 1):
        whole, cut = ([(t, a, f) for _, _, text, anchor, first in sd.nodes_of(data, ends, 400, width, s) for t, a, f in zip(text, anchor, first, strict=True)] for s in (1 << 17, 333))
        assert whole == cut and len(set(whole)) == len(whole)
    long = "".join(map(chr, rng.integers(97, 123, 400_000)))
    df = spark.createDataFrame([(1, long), (2, long[100_000:101_000] + "|" + " " * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in sd.dedup_substrings(df).collect()}
    assert [(s.begin, s.end) for s in got[1].spans] == [(100_000, 101_000)]
    assert [(s.begin, s.end) for s in got[2].spans] == [(0, 1000), (1001, 101_001)]
    assert sd.dedup_substrings(df.limit(0)).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 20_000):
        tokens = [rng.integers(-3, 3, n), rng.integers(-(2**60), 2**60, n) // (1 << 58), rng.integers(0, 9, n)]
        order = sd.multikey_order(tokens, small=16)
        rows = list(zip(*[t[order].tolist() for t in tokens], strict=True))
        assert rows == sorted(rows) and sorted(order.tolist()) == list(range(n))


def test_query(spark, small):
    docs = table(spark, small, "documents").collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op13_suffix_dedup"](spark, small).collect())
    assert got == sorted((r.doc_id, *b) for r, b in zip(docs, brute([r.text for r in docs], 400), strict=True))
