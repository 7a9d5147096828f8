"""Offsets, replaced coordinates, tiled joins and summed-area tables against plain loops."""

import re

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from veridoc.functions.matches import matches, rebuilt, whole_number
from veridoc.operators import coordinates as C, raster, spatial


def test_matches_have_the_offsets_of_a_scan(spark):
    rng = np.random.default_rng(1)
    texts = ["", "ab", "xxab", "abab\nab", "é😀ab ab", None, "ab" * 500] + ["".join(rng.choice(list("ab \nß"), 30)) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.m for r in df.select("i", matches(F.col("t"), "a+b").alias("m")).collect()}
    for i, t in enumerate(texts):
        assert (got[i] is None) if t is None else [(m.at, m.found) for m in got[i]] == [(m.start(), m.group()) for m in re.finditer("a+b", t)]
    marked = df.select("i", rebuilt(F.col("t"), "a+b", F.array(F.lit("<1>"), F.lit(None).cast("string"))).alias("t"))
    for r in marked.collect():
        want = texts[r.i] and re.sub("a+b", lambda m, n=iter(range(10**6)): "<1>" if next(n) == 0 else m.group(), texts[r.i])
        assert r.t == want


def plain(text, raw):
    said = {m[1]: [str(int(m[k])) for k in (2, 3, 4, 5)] for m in re.finditer(r"(?i)ANOMALY_([0-9]+)\s*:.*\n\[GROUNDING\]\s*:\s*" + C.BOX, raw)}

    def new(m):
        before = re.findall(C.HEADER, text[max(0, m.start() - 2000) : m.start()])
        return C.WRITTEN % tuple(said[before[-1]]) if before and before[-1] in said else m[0]

    return re.sub(C.IN_REPORT, new, text)


def test_reports_take_the_teachers_boxes(spark):
    box = "[GROUNDING]: [ 1,2, -03 ,4]"
    raw = "ANOMALY_1: a\n[GROUNDING]: [5,6,7,8]\nanomaly_2 : b\n[grounding] : [ 009, -0, 1, 2 ]\nANOMALY_1: again\n[GROUNDING]: [50,60,70,80]\n"
    texts = [
        f"{box}\n### ANOMALY_1: x\n{box} {box}\n###anomaly_2\n{box}",
        f"### ANOMALY_1{'.' * 1986}{box}", f"### ANOMALY_1{'.' * 1987}{box}", f"### ANOMALY_1{'.' * 1988}{box}",
        f"### ANOMALY_01: not the same number\n{box}", "no boxes", "",
    ]
    rows = [(i, t, "kept") for i, t in enumerate(texts)] + [(98, None, "kept"), (99, texts[0], "kept"), (None, texts[0], "kept")]
    reports = spark.createDataFrame(rows, "doc int, text string, index string")
    raws = spark.createDataFrame([(i, raw) for i in range(len(texts))] + [(98, raw), (99, None), (None, raw)], "doc int, raw string")
    got = {r.doc: r for r in C.with_teacher_boxes(reports, raws).collect()}
    assert len(got) == len(rows) and all(r["index"] == "kept" for r in got.values())
    assert all(got[i].text == plain(t, raw) for i, t in enumerate(texts))
    assert got[98].text is None and got[99].text == got[None].text == texts[0]
    assert [p.replaced for p in got[0].replacements] == [None, ["50", "60", "70", "80"], ["50", "60", "70", "80"], ["9", "0", "1", "2"]]
    assert got[0].replacements[0].original == ["1", "2", "-3", "4"]
    assert C.with_teacher_boxes(reports.limit(0), raws).count() == 0
    assert spark.range(1).select(whole_number(F.lit("-000")).alias("v")).first().v == "0"


def test_tiles_find_each_overlapping_pair_once(spark):
    rng = np.random.default_rng(2)

    def boxes(n, key):
        xy, wh = rng.integers(-40, 300, (n, 2)), rng.integers(0, 90, (n, 2))
        return [(int(i % 3), i, *map(int, (*xy[i], *(xy[i] + wh[i])))) for i in range(n)] + [(0, n, None, 1, 2, 3)]

    a, b = boxes(150, "i"), boxes(150, "j")
    left, right = (spark.createDataFrame(r, f"doc int, {k} int, x1 int, y1 int, x2 int, y2 int") for r, k in ((a, "i"), (b, "j")))
    want = sorted((p[1], q[1]) for p in a[:-1] for q in b[:-1] if p[0] == q[0] and min(p[4], q[4]) > max(p[2], q[2]) and min(p[5], q[5]) > max(p[3], q[3]))
    for cell in (7, 64, 1000):
        assert sorted((r.l_i, r.r_j) for r in spatial.overlapping(left, right, "l_", "r_", cell).collect()) == want
    assert len(want) > 100


def test_a_crowded_document_is_no_single_key(spark):
    """20,000 words and 5,000 regions of one page: a key holds few of them, and results equal a plain count."""
    words = spark.range(20000).selectExpr("1 doc", "id", "concat('w', id) text", "(id % 200) * 20 x1", "(id div 200) * 40 y1", "(id % 200) * 20 + 15 x2", "(id div 200) * 40 + 20 y2")
    regions = spark.range(5000).selectExpr("1 doc", "cast(id as int) region", "(id % 100) * 40 x1", "(id div 100) * 80 y1", "(id % 100) * 40 + 35 x2", "(id div 100) * 80 + 60 y2")
    cells = spatial._cells(spatial.renamed(words, "w_"), "w_", spatial.CELL)
    assert cells.groupBy("cell_x", "cell_y").count().agg(F.max("count")).first()[0] < 200
    assert spatial.region_words(regions, words).select(F.sum(F.size("words"))).first()[0] == 20000


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.lists(st.tuples(*[st.integers(-3, 15)] * 4), min_size=1, max_size=6))
def test_box_means(h, w, boxes):
    m = np.random.default_rng(h * 13 + w).random((h, w))
    for got, (x1, y1, x2, y2) in zip(raster.box_means(m, np.array(boxes)), boxes, strict=True):
        part = m[max(y1, 0) : max(y2, 0), max(x1, 0) : max(x2, 0)]
        assert abs(got - (part.mean() if part.size else 0)) < 1e-9


def test_region_confidence(spark):
    maps = spark.createDataFrame([(1, 2, 2, [1.0, 2.0, 3.0, 4.0])], "doc long, h int, w int, data array<double>")
    regions = spark.createDataFrame([(1, 1, 0, 0, 2, 2), (1, 2, 1, 0, 2, 1), (1, 3, 1, 1, 1, 2), (2, 1, 0, 0, 1, 1), (1, 4, None, 0, 1, 1)], "doc long, region int, x1 int, y1 int, x2 int, y2 int")
    got = {(r.doc, r.region): r.confidence for r in raster.region_confidence(regions, maps).collect()}
    assert got == {(1, 1): 2.5, (1, 2): 2.0, (1, 3): 0.0, (2, 1): 0.0, (1, 4): 0.0}
