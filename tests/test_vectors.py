"""Groups of vectors by their best cosines, in blocks."""

import math

import pytest

from veridoc.operators import metrics as M


def brute(a, b):
    def cosine(x, y):
        if x is None or y is None or len(x) != len(y) or None in x or None in y:
            return 0.0
        n = math.sqrt(sum(i * i for i in x)) * math.sqrt(sum(i * i for i in y))
        return sum(i * j for i, j in zip(x, y, strict=True)) / n if n else 0.0

    p, r = (sum(max(cosine(x, y) for y in there) for x in here) / len(here) for here, there in ((b, a), (a, b)))
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def test_blocks_equal_brute_force(spark):
    """blocks of a few numbers, ragged, null, zero and negative vectors; groups with one side give no row."""
    v = lambda i, n=3: [math.sin(i * 7 + k) for k in range(n)]
    groups = {0: ([v(i) for i in range(40)], [v(i + 100) for i in range(25)]), 1: ([[1.0, 0.0], None, [0.0, 0.0], [1.0, None]], [[-1.0, 0.0], [1.0, 2.0, 3.0]]), 2: ([v(1, 2)], [[-x for x in v(1, 2)]])}
    rows = [(g, side, i, x) for g, both in groups.items() for side, xs in zip(("left", "right"), both, strict=True) for i, x in enumerate(xs)] + [(3, "left", 0, [1.0]), (None, "left", 0, [1.0]), (None, "right", 0, [1.0])]
    df = spark.createDataFrame(rows, "label int, side string, id int, vector array<double>").repartition(3)
    for per_block in (8, 2_000_000):
        out = M.greedy_similarity(df, ["label"], "left", "right", per_block)
        assert {r.label: [r.precision, r.recall, r.f1] for r in out.collect()} == {g: pytest.approx(brute(*both)) for g, both in groups.items()}
    assert "zip_with" not in out._jdf.queryExecution().executedPlan().toString()  # no product number by number
