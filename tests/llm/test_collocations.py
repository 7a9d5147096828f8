"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from veridoc.llm import collocations as col

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest=5, top=2000, absorbed=100):
    n, f = Counter(), Counter()
    for lang, text in rows:
        g = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[g] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[g, tuple(w[i : i + m])] += 1
    often = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = {}
    for (g, p), a in often.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
        if any(h == g and len(q) > len(p) and 100 * v >= absorbed * a and inside(q) for (h, q), v in often.items()):
            continue
        cuts = [(1000 * a * n[g] // (f[g, p[:k]] * f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(g, []).append((score, a, " ".join(p), left, right))
    return [(g, i + 1, p, a, x, y, n[g], s) for g in sorted(out) for i, (s, a, p, x, y) in enumerate(sorted(out[g], key=lambda r: (-r[0], -r[1], r[2].encode()))[:top])]


def corpus(seed):
    rng = random.Random(seed)
    words = ["The", "of", "aé", "B", "x y", "É", "c\x00d", "z1", "-", "und", "q", "\x1cw"]
    rows = [("en", None), (None, ""), ("en", " \t\n.,"), ("und", "one"), ("en", "word " * 20_000)]
    for _ in range(150):
        n = rng.randint(1, 40)
        text = "".join(rng.choice(words[: rng.choice([4, 12])]) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(n))
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text + rng.choice(["", " The of B z1 q", " of B z1. The of"])))
    return rows


@pytest.mark.parametrize("more", [{}, {"shard": 7, "portion": 14, "buckets": 17, "most_words": 3, "top": 4}, {"absorbed": 70, "longest": 3, "buckets": 1 << 10}])
def test_collocations(spark, more):
    rows = corpus(len(more))
    df = spark.createDataFrame([(g, t, "x", 1) for g, t in rows], "lang string, text string, word string, n int").repartition(4)
    got = col.collocations(df, least=5, **more).orderBy("lang", "rank").collect()
    want = brute(rows, 5, **{k: v for k, v in more.items() if k in ("longest", "top", "absorbed")})
    assert [tuple(r) for r in got] == want and len(want) > 8
    assert col.collocations(df.limit(0), least=5).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(2**62), 2**62, 5000))
    shards = []
    own = col.shard_of(keys, 3)
    for s in (0, 2):
        k, levels = col.perfect_hash(keys[own == s])
        assert sorted(k.tolist()) == keys[own == s].tolist()
        shards.append((s, k.tobytes(), np.concatenate(levels).tobytes(), [len(x) for x in levels], None))
    slots = col.Slots(shards, 3)
    found = slots(keys)
    assert sorted(found[own != 1].tolist()) == list(range(slots.n)) and (found[own == 1] == -1).all()
    assert (slots.keys[found[own != 1]] == keys[own != 1]).all()
    assert (slots(rng.integers(-(2**62), 2**62, 5000)) == -1).all()
    assert col.perfect_hash(keys[:0])[1] == [] and col.Slots([], 1)(keys[:3]).tolist() == [-1] * 3
