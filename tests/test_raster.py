"""Kernels against brute force."""

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from veridoc.functions import geometry as G
from veridoc.operators import raster, spatial

GRIDS = st.integers(1, 9).flatmap(lambda h: st.integers(1, 9).flatmap(lambda w: st.lists(st.booleans(), min_size=h * w, max_size=h * w).map(lambda v: np.array(v).reshape(h, w))))


def flood(mask, connectivity):
    out, k = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if out[y, x]:
            continue
        k += 1
        work = [(y, x)]
        while work:
            a, b = work.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                out[a, b] = k
                work += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if connectivity == 8 or abs(i) + abs(j) == 1]
    return out


@settings(max_examples=150, deadline=None)
@given(GRIDS, st.sampled_from([4, 8]))
def test_components(mask, connectivity):
    assert (raster.components(mask, connectivity) == flood(mask, connectivity)).all()


@settings(max_examples=60, deadline=None)
@given(GRIDS)
def test_opening_only_removes(mask):
    o = raster.opened(mask, 3)
    assert (o <= mask).all() and (raster.opened(o, 3) == o).all() and (raster.opened(mask, 1) == mask).all()


def test_gap_and_split():
    assert raster.interior_gap(np.array([0, 1, 0, 0, 1, 0, 0, 1], bool)) == (2, 3)
    assert raster.interior_gap(np.zeros(4, bool)) == (0, -1)
    m = np.zeros((8, 8), bool)
    m[:2, :2] = m[6:, 6:] = True
    assert raster.sparse_boxes(m, least_area=2) == [[0, 0, 2, 2], [6, 6, 8, 8]]


def test_reading_lines():
    assert raster.reading_lines([[0, 0, 5, 10], [6, 2, 9, 12], [0, 30, 5, 40]]) == [0, 0, 1]
    assert raster.reading_lines([]) == []


def test_words_are_ordered_in_batches(spark):
    """no call for each page; the result is the fold's, page by page."""
    rng = np.random.default_rng(5)
    boxes = {(d, i): [int(x), int(y), int(x) + 5, int(y) + 3 + i % 4] for d in range(30) for i, (x, y) in enumerate(rng.integers(0, 40, (d, 2)))}
    df = spark.createDataFrame([(d, i, *b) for (d, i), b in boxes.items()], "doc bigint, id int, x1 int, y1 int, x2 int, y2 int").repartition(5)
    out = raster.order_words(df)
    got = {(r.doc, r.id): (r.line, r.place) for r in out.collect()}
    assert len(got) == len(boxes) and "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    for d in range(1, 30):
        line = raster.reading_lines([boxes[d, i] for i in range(d)])
        for i in range(d):
            before = [j for j in range(d) if line[j] == line[i] and (boxes[d, j][0], j) <= (boxes[d, i][0], i)]
            assert got[d, i] == (line[i], len(before))


def test_pixel_counts_equal_a_raster(spark):
    rng = np.random.default_rng(3)
    rows = [(doc, side, *map(int, (x, y, x + w, y + h))) for doc in range(12) for side in (0, 1) for x, y, w, h in rng.integers(0, 12, (rng.integers(1, 5), 4))]
    df = spark.createDataFrame(rows, "doc long, side int, x1 int, y1 int, x2 int, y2 int")
    got = {r.doc: (r.tp, r.fp, r.fn) for r in spatial.pixel_counts(df.where("side = 0"), df.where("side = 1")).collect()}
    for doc in range(12):
        m = np.zeros((2, 30, 30), bool)
        for _, side, x1, y1, x2, y2 in (r for r in rows if r[0] == doc):
            m[side, y1:y2, x1:x2] = True
        expected = (int((m[0] & m[1]).sum()), int((~m[0] & m[1]).sum()), int((m[0] & ~m[1]).sum()))
        assert got.get(doc, (0, 0, 0)) == expected


def test_box_edges(spark):
    boxes = [(0, 0, 4, 4), (4, 0, 8, 4), (1, 1, 1, 3), (0, 0, 4, 4)]
    df = spark.createDataFrame([(*a, *b) for a in boxes for b in boxes], "ax1 int, ay1 int, ax2 int, ay2 int, bx1 int, by1 int, bx2 int, by2 int")
    a, b = G.Box.of("a"), G.Box.of("b")
    got = df.select(G.iou(a, b).alias("i"), G.iou(b, a).alias("j"), G.intersection_over_min(a, b).alias("m")).collect()
    assert all(r.i == r.j and 0 <= r.i <= 1 and r.m >= 0 for r in got) and got[0].i == 1 and got[1].i == 0


def test_clip_variants(spark):
    df = spark.createDataFrame([(150, 2, 160, 9)], "x1 int, y1 int, x2 int, y2 int")
    width = {v: df.select((G.clip_box(G.Box.of(), F.lit(100), F.lit(50), v).x2 - G.clip_box(G.Box.of(), F.lit(100), F.lit(50), v).x1).alias("w")).first().w for v in ("sorted", "unsorted", "edge")}
    assert width == {"sorted": 0, "unsorted": 0, "edge": 1}


def test_merge_shallow_by_flooding():
    """Labels are one when a path of passes joins them, on a 256 x 256 map."""
    rng = np.random.default_rng(4)
    labels = np.kron(np.arange(1, 257).reshape(16, 16), np.ones((16, 16), int))
    labels[rng.random((256, 256)) < 0.05] = 0
    prob = rng.random((256, 256)) * np.kron(rng.random((16, 16)), np.ones((16, 16)))
    for ratio in (0.5, 0.8, 0.95):
        peak = {k: prob[labels == k].max() for k in range(1, 257)}
        links = {k: {k} for k in peak}
        for dy, dx in ((0, 1), (1, 0)):
            a, b = labels[: 256 - dy, : 256 - dx], labels[dy:, dx:]
            v = np.minimum(prob[: 256 - dy, : 256 - dx], prob[dy:, dx:])
            for i, j, x in zip(a.ravel(), b.ravel(), v.ravel(), strict=True):
                if i != j and i and j and x >= ratio * min(peak[i], peak[j]):
                    links[i].add(j)
                    links[j].add(i)
        want = {}
        for k in links:
            if k not in want:
                group, todo = set(), [k]
                while todo:
                    if (x := todo.pop()) not in group:
                        group.add(x)
                        todo += links[x]
                want |= dict.fromkeys(group, min(group))
        got = raster.merge_shallow(labels, prob, ratio)
        assert (got == np.vectorize(lambda k: want.get(k, 0))(labels)).all()
