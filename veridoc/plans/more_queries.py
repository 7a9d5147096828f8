"""Queries for geometry, report text, budgets and composed pipelines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import geometry as G, report as R, text as T
from ..functions.geometry import Box
from ..operators import budget, columns, contracts, metrics as M, raster, spatial as S
from . import inputs as I, pipelines as P
from .inputs import BOX_SQL, read
from .queries import CELLS, PAIRS, inter_sql, iou_sql, query, r6

# --- G: geometry ------------------------------------------------------------------------------------------------


def _pairs(spark, d):
    """Detector region and word of equal number."""
    a, b = I.boxes(spark, d, "R"), I.boxes(spark, d, "N")
    return S.renamed(a.drop("f"), "a_").join(S.renamed(b.drop("f"), "b_"), (F.col("a_item") == F.col("b_item")) & (a["doc"] == b["doc"])).select(a["doc"], F.col("a_item").alias("item"), *Box.of("a_").named("a_"), *Box.of("b_").named("b_"))


PAIR_SQL = f"WITH {BOX_SQL}, p AS (SELECT a.doc, a.item, a.x1 AS a_x1, a.y1 AS a_y1, a.x2 AS a_x2, a.y2 AS a_y2, b.x1 AS b_x1, b.y1 AS b_y1, b.x2 AS b_x2, b.y2 AS b_y2 FROM bx a JOIN bx b ON a.doc = b.doc AND a.item = b.item AND a.f = 'R' AND b.f = 'N')"
INTER = inter_sql("a_", "b_")
AREA = {k: f"({k}x2 - {k}x1) * ({k}y2 - {k}y1)" for k in ("a_", "b_")}


def _scalar(name, expression, sql):
    @query(name, f"{PAIR_SQL} SELECT doc, item, round({sql}, 6) AS value FROM p")
    def _(spark, d):
        return _pairs(spark, d).select("doc", "item", r6(expression(Box.of("a_"), Box.of("b_"))).alias("value"))


_scalar("g01_iou", G.iou, iou_sql("a_", "b_"))
_scalar("g02_iomin", G.intersection_over_min, f"CASE WHEN {INTER} > 0 THEN CAST({INTER} AS DOUBLE) / least(greatest(1, {AREA['a_']}), greatest(1, {AREA['b_']})) ELSE 0.0 END")
_scalar("g03_overlap_frac", G.overlap_fraction, f"CAST({INTER} AS DOUBLE) / greatest(1, {AREA['b_']})")
_scalar("g05_iou_viz", G.iou_clamped, f"CAST({INTER} AS DOUBLE) / ({AREA['a_']} + {AREA['b_']} - {INTER})")


@query("g04_union_box", f"{PAIR_SQL} SELECT doc, item, least(a_x1, b_x1) AS x1, least(a_y1, b_y1) AS y1, greatest(a_x2, b_x2) AS x2, greatest(a_y2, b_y2) AS y2 FROM p")
def _(spark, d):
    return _pairs(spark, d).select("doc", "item", *G.union_box(Box.of("a_"), Box.of("b_")).named())


@query("g06_poly", f"{PAIR_SQL} SELECT doc, item, CAST(trunc(least(a_x1 + 0.7, b_x1 + 0.2)) AS INTEGER) AS x1, CAST(trunc(greatest(a_y2 + 0.7, b_y2 + 0.2)) AS INTEGER) AS y2 FROM p")
def _(spark, d):
    point = lambda x, y, by: F.struct((F.col(x) + by).cast("double").alias("x"), (F.col(y) + by).cast("double").alias("y"))
    b = G.polygon_box(F.array(point("a_x1", "a_y2", 0.7), point("b_x1", "b_y2", 0.2)))
    return _pairs(spark, d).select("doc", "item", b.x1.alias("x1"), b.y2.alias("y2"))


@query("g08_boxes_to_mask_variants", f"""WITH {BOX_SQL} SELECT doc, item, greatest(0, least(x1, 60)) AS u_x1, greatest(0, least(x2, 60)) AS u_x2, greatest(0, least(x1, 59)) AS e_x1, least(x1, least(60, x2)) AS c_x1, greatest(x1, least(60, x2)) AS c_x2 FROM bx WHERE f = 'R'""")
def _(spark, d):
    w, h = F.lit(60), F.lit(50)
    v = {k: G.clip_box(Box.of(), w, h, n) for k, n in (("u", "unsorted"), ("e", "edge"), ("c", "clip_first"))}
    return I.family(spark, d, "R", "item").select("doc", "item", v["u"].x1.alias("u_x1"), v["u"].x2.alias("u_x2"), v["e"].x1.alias("e_x1"), v["c"].x1.alias("c_x1"), v["c"].x2.alias("c_x2"))


COMPONENTS = """WITH RECURSIVE px AS (SELECT vec_id AS doc, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(1, 65)) AS i FROM embeddings) WHERE v >= 0.1),
 lab AS (SELECT doc, y, x, y * 8 + x AS l, 0 AS step FROM px UNION ALL SELECT p.doc, p.y, p.x, min(q.l), any_value(q.step) + 1 FROM px p JOIN lab q ON p.doc = q.doc AND {near} WHERE q.step < 40 GROUP BY p.doc, p.y, p.x),
 fin AS (SELECT * FROM lab WHERE step = 40) SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY l) AS INTEGER) AS number, x1, y1, x2, y2 FROM (SELECT doc, l, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM fin GROUP BY 1, 2 HAVING count(*) >= 3)"""


@query("g09_mask_to_boxes", COMPONENTS.format(near="abs(p.y - q.y) + abs(p.x - q.x) <= 1"))
def _(spark, d):
    return raster.map_boxes(I.maps(spark, d), lambda m: raster.component_boxes(m.astype(np.float32) >= np.float32(0.1), 3, 4))


@query("g10_cc8", COMPONENTS.format(near="abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1"))
def _(spark, d):
    return raster.map_boxes(I.maps(spark, d), lambda m: raster.component_boxes(m.astype(np.float32) >= np.float32(0.1), 3, 8))


@query("g11_regions")
def _(spark, d):
    return raster.map_boxes(I.maps(spark, d), lambda m: raster.detector_regions(m, 0.0, 2, opening=0))


@query("g12_split_sparse")
def _(spark, d):
    return raster.map_boxes(I.maps(spark, d), lambda m: raster.sparse_boxes(m >= 0.1, least_area=2, least_gap=1, fill=0.7))


@query("g13_morph_open")
def _(spark, d):
    return raster.map_masks(I.maps(spark, d), lambda m: raster.opened(m >= 0.0, 3))


@query("g14_small_objects")
def _(spark, d):
    return raster.map_masks(I.maps(spark, d), lambda m: raster.without_small(m >= 0.1, 3))


@query("g15_watershed")
def _(spark, d):
    return raster.map_masks(I.maps(spark, d), lambda m: raster.watershed(m, 0.0, 0.7, 0.02, 2))


@query("g16_shallow_merge")
def _(spark, d):
    return raster.map_masks(I.maps(spark, d), lambda m: raster.merge_shallow(raster.watershed(m, 0.0, 0.0, 0.0, 1), m, 0.5))


@query("g18_rescale", f"WITH {BOX_SQL} SELECT doc, item, CAST(round_even(x1 * 0.5, 0) AS BIGINT) AS x1, CAST(round_even(y2 * 1.5, 0) AS BIGINT) AS y2 FROM bx WHERE f = 'R'")
def _(spark, d):
    b = G.rescale(Box.of(), F.lit(0.5), F.lit(1.5))
    return I.family(spark, d, "R", "item").select("doc", "item", b.x1.alias("x1"), b.y2.alias("y2"))


@query("g19_nearest_resize")
def _(spark, d):
    return raster.map_masks(I.maps(spark, d), lambda m: raster.nearest_resize(m >= 0.1, 4, 12))


@query("g20_region_conf", "SELECT vec_id AS doc, round(avg(v), 5) AS confidence FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings) WHERE i % 8 BETWEEN 1 AND 4 AND i // 8 BETWEEN 2 AND 5 GROUP BY 1")
def _(spark, d):
    m = I.maps(spark, d)
    regions = m.select("doc", F.lit(1).alias("region"), F.lit(1).alias("x1"), F.lit(2).alias("y1"), F.lit(5).alias("x2"), F.lit(6).alias("y2"))
    return raster.region_confidence(regions, m).select("doc", F.round("confidence", 5).alias("confidence"))


@query("g21_tiles", "SELECT p_partkey, array_to_string(CASE WHEN p_size * 3 <= 32 THEN [0] ELSE list_sort(list_distinct(list_concat(range(0, p_size * 3 - 31, 32), [p_size * 3 - 32]))) END, ',') AS starts FROM part")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", F.array_join(G.tile_starts(F.col("p_size") * 3, 32).cast("array<string>"), ",").alias("starts"))


@query("g22_stitch_tta", "SELECT l_orderkey AS doc, CAST(l_linenumber AS INTEGER) AS x, round(min(v), 6) AS value FROM (SELECT l_orderkey, l_linenumber, l_returnflag, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2")
def _(spark, d):
    px = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("pass"), F.lit(0).alias("y"), F.col("l_linenumber").alias("x"), F.col("l_quantity").alias("value"))
    return raster.combine_passes(px, "min").select("doc", "x", r6("value").alias("value"))


SNAP = "greatest(28, CAST(round_even({c} / 28.0, 0) AS BIGINT) * 28)"


@query("g23_smart_resize", f"""WITH s AS (SELECT p_partkey, greatest(28, p_size * 20) AS h, greatest(28, 900 - p_size * 10) AS w FROM part), b AS (SELECT *, {SNAP.format(c='h')} AS hb, {SNAP.format(c='w')} AS wb FROM s)
 SELECT p_partkey, CAST(CASE WHEN hb * wb > 250000 THEN greatest(28, floor(h / sqrt(h * w / 250000.0) / 28) * 28) WHEN hb * wb < 60000 THEN ceil(h * sqrt(60000.0 / (h * w)) / 28) * 28 ELSE hb END AS BIGINT) AS h, CAST(CASE WHEN hb * wb > 250000 THEN greatest(28, floor(w / sqrt(h * w / 250000.0) / 28) * 28) WHEN hb * wb < 60000 THEN ceil(w * sqrt(60000.0 / (h * w)) / 28) * 28 ELSE wb END AS BIGINT) AS w FROM b""")
def _(spark, d):
    h, w = G.smart_resize(F.col("p_size") * 20, 900 - F.col("p_size") * 10, 60000, 250000)
    return read(spark, d, "part").select("p_partkey", h.cast("bigint").alias("h"), w.cast("bigint").alias("w"))


@query("g24_smart_resize_approx", """WITH s AS (SELECT p_partkey, p_size * 20 AS w, 900 - p_size * 10 AS h FROM part), r AS (SELECT *, greatest(28, CAST(round_even(w * sqrt(250000.0 / (w * h)) / 28, 0) AS BIGINT) * 28) AS nw, greatest(28, CAST(round_even(h * sqrt(250000.0 / (w * h)) / 28, 0) AS BIGINT) * 28) AS nh FROM s),
 q AS (SELECT *, greatest(28, least(nw, 250000 // nh // 28 * 28)) AS w2 FROM r) SELECT p_partkey, CASE WHEN w * h <= 250000 THEN CAST(round_even(w / 28.0, 0) AS BIGINT) * 28 ELSE w2 END AS w, CASE WHEN w * h <= 250000 THEN CAST(round_even(h / 28.0, 0) AS BIGINT) * 28 ELSE greatest(28, least(nh, 250000 // w2 // 28 * 28)) END AS h FROM q""")
def _(spark, d):
    w, h = G.smart_resize_approx(F.col("p_size") * 20, 900 - F.col("p_size") * 10, 250000)
    return read(spark, d, "part").select("p_partkey", w.cast("bigint").alias("w"), h.cast("bigint").alias("h"))


@query("g25_image_tokens", "SELECT p_partkey, CAST(greatest(1, p_size * 20 // 28) * greatest(1, (900 - p_size * 10) // 28) AS BIGINT) AS tokens FROM part")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", G.image_tokens(F.col("p_size") * 20, 900 - F.col("p_size") * 10).cast("bigint").alias("tokens"))


@query("g27_proportional", "WITH w AS (SELECT conv_id, turn, u.i AS i, greatest(1, length(u.t)) AS l FROM conversations, LATERAL (SELECT unnest(string_split(text, ' ')) AS t, generate_subscripts(string_split(text, ' '), 1) AS i) u), c AS (SELECT *, sum(l) OVER (PARTITION BY conv_id, turn ORDER BY i) AS upto, sum(l) OVER (PARTITION BY conv_id, turn) AS total FROM w) SELECT conv_id, turn, CAST(i AS INTEGER) AS i, CAST(round_even(1000.0 * CAST(upto - l AS DOUBLE) / CAST(total AS DOUBLE), 0) AS BIGINT) AS x1, CAST(round_even(1000.0 * CAST(upto AS DOUBLE) / CAST(total AS DOUBLE), 0) AS BIGINT) AS x2 FROM c")
def _(spark, d):
    from pyspark.sql import Window

    w = read(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ", -1)).alias("p", "t")).select("conv_id", "turn", (F.col("p") + 1).alias("i"), F.greatest(F.lit(1), F.length("t")).alias("l"))
    by = Window.partitionBy("conv_id", "turn")
    upto, total = F.sum("l").over(by.orderBy("i")), F.sum("l").over(by).cast("double")
    return w.select("conv_id", "turn", "i", G.half_even(1000.0 * (upto - F.col("l")).cast("double") / total).alias("x1"), G.half_even(1000.0 * upto.cast("double") / total).alias("x2"))


@query("g28_sobel_split", """WITH v AS (SELECT vec_id AS doc, x, sum(abs(CAST(embedding[8 * y + least(x + 1, 7) + 1] AS DOUBLE) - embedding[8 * y + greatest(x - 1, 0) + 1])) AS e FROM embeddings CROSS JOIN (SELECT unnest(range(0, 8)) AS x) CROSS JOIN (SELECT unnest(range(0, 8)) AS y) GROUP BY 1, 2),
  t AS (SELECT doc, max(e) AS top FROM v GROUP BY 1), ink AS (SELECT v.doc, x FROM v JOIN t USING (doc) WHERE e > 0.7 * top),
  d AS (SELECT doc, min(x) AS a, max(x) + 1 AS b FROM ink GROUP BY 1), g0 AS (SELECT doc, lag(x) OVER (PARTITION BY doc ORDER BY x) + 1 AS g1, x AS g2 FROM ink), g AS (SELECT doc, g1, g2, g2 - g1 AS w FROM g0 WHERE g2 > g1),
  n AS (SELECT doc, count(*) AS n FROM g GROUP BY 1), j0 AS (SELECT doc, g1, w, lead(w) OVER (PARTITION BY doc ORDER BY w, g1) AS nx, row_number() OVER (PARTITION BY doc ORDER BY w, g1) AS i FROM g),
  j AS (SELECT doc, (w + nx) / 2.0 AS cut FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY nx - w DESC, i) AS r FROM j0 WHERE nx > w) WHERE r = 1),
  k AS (SELECT g.*, cut, count(*) FILTER (w > cut) OVER (PARTITION BY g.doc) AS m, row_number() OVER (PARTITION BY g.doc ORDER BY w DESC, g1) AS r FROM g JOIN n ON n.doc = g.doc AND n.n >= 2 LEFT JOIN j ON j.doc = g.doc),
  c AS (SELECT doc, g1, g2 FROM k WHERE CASE WHEN m = 2 THEN w > cut ELSE r <= 2 END),
  s1 AS (SELECT doc, x1, row_number() OVER (PARTITION BY doc ORDER BY x1) AS word FROM (SELECT doc, g2 AS x1 FROM c UNION ALL SELECT doc, a FROM d JOIN n USING (doc) WHERE n >= 2)),
  s2 AS (SELECT doc, x2, row_number() OVER (PARTITION BY doc ORDER BY x2) AS word FROM (SELECT doc, g1 AS x2 FROM c UNION ALL SELECT doc, b FROM d JOIN n USING (doc) WHERE n >= 2)),
  p AS (SELECT d.doc, word, floor(a + (b - a) * CAST(word * (word - 1) // 2 AS DOUBLE) / 6) AS x1, floor(a + (b - a) * CAST(word * (word + 1) // 2 AS DOUBLE) / 6) AS x2 FROM d CROSS JOIN (SELECT unnest([1, 2, 3]) AS word) LEFT JOIN n USING (doc) WHERE coalesce(n, 0) < 2)
  SELECT doc, CAST(word AS INTEGER) AS word, CAST(x1 AS INTEGER) AS x1, CAST(x2 AS INTEGER) AS x2, true AS split FROM s1 JOIN s2 USING (doc, word) UNION ALL SELECT doc, CAST(word AS INTEGER), CAST(x1 AS INTEGER), CAST(x2 AS INTEGER), false FROM p""")
def _(spark, d):
    """Three words of lengths 1, 2 and 3 on each line image."""
    maps = I.maps(spark, d)
    words = maps.select("doc", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("word")).withColumn("length", F.col("word"))
    return columns.word_columns(maps, words, 3, 0.7)


@query("g29_smooth")
def _(spark, d):
    return raster.map_masks(I.maps(spark, d), lambda m: np.round(1000 * raster.smoothed(m.sum(0), 1.0)))


REPORT_SQL = f"WITH {BOX_SQL}, r AS (SELECT doc, count(*) AS n FROM bx WHERE f = 'R' GROUP BY 1)"


@query("g30_report_boxes", f"WITH {BOX_SQL} SELECT doc, item, x1, y1, x2, y2 FROM bx WHERE f = 'R'")
def _(spark, d):
    r = I.reports(spark, d).select("doc", F.posexplode(R.boxes(R.parse_report(F.col("text")))).alias("i", "b"))
    return r.select("doc", (F.col("i") + 1).alias("item"), *[F.get("b", i).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


# --- H: reports and model text ----------------------------------------------------------------------------------


def _on_report(name, expression, sql):
    @query(name, f"{REPORT_SQL} SELECT doc, {sql} AS value FROM r")
    def _(spark, d):
        return I.reports(spark, d).select("doc", expression(F.col("text")).alias("value"))


TX = "text"
_on_report("h01_conclusion", R.conclusion, "CASE WHEN doc % 2 = 0 THEN 'FORGED' ELSE 'PRISTINE' END")
_on_report("h02_risk", R.risk_score, "CAST(doc % 101 AS INTEGER)")
_on_report("h03_headers", lambda x: F.size(R.blocks(x)).cast("bigint"), "n")
_on_report("h07_summary", R.summary, "concat('seen ', n, ' times')")
_on_report("h44_conclusion_strict", lambda x: R.conclusion_strict(F.regexp_replace(x, r"\*\*", "")), "CASE WHEN doc % 2 = 0 THEN 'FORGED' ELSE 'AUTHENTIC' END")


def _on_anomaly(name, field, sql):
    @query(name, f"WITH {BOX_SQL} SELECT doc, item, {sql} AS value FROM bx WHERE f = 'R'")
    def _(spark, d):
        a = I.reports(spark, d).select("doc", F.explode(R.parse_report(F.col(TX))["anomalies"]).alias("a"))
        return a.select("doc", F.col("a.index").alias("item"), field(F.col("a")).alias("value"))


_on_anomaly("h04_location", lambda a: F.concat_ws("|", a["type"], a["location"]), "concat('Visual Clumsy|row ', y1)")
_on_anomaly("h05_grounding", lambda a: F.array_join(a["grounding"].cast("array<string>"), ","), "concat(x1, ',', y1, ',', x2, ',', y2)")
_on_anomaly("h06_reason", lambda a: a["reason"], "concat('strokes differ', chr(10), 'at ', x2)")
_on_anomaly("h06_content", lambda a: a["forged_content"], "concat('total ', x1)")


@query("h08_parse_report", f"{REPORT_SQL} SELECT doc, CASE WHEN doc % 2 = 0 THEN 'FORGED' ELSE 'PRISTINE' END AS conclusion, CAST(doc % 101 AS INTEGER) AS risk_score, CAST(n AS INTEGER) AS n_anomalies, concat('seen ', n, ' times') AS summary FROM r")
def _(spark, d):
    return I.reports(spark, d).select("doc", R.parse_report(F.col(TX)).alias("r")).select("doc", "r.conclusion", "r.risk_score", F.size("r.anomalies").alias("n_anomalies"), "r.summary")


@query("h09_serialize_dataset", f"{REPORT_SQL}, s AS (SELECT doc, string_agg(concat('### ANOMALY_', lpad(CAST(item AS VARCHAR), 3, '0'), ': Visual Clumsy (row ', y1, ')', chr(10), '[GROUNDING]: [', x1, ', ', y1, ', ', x2, ', ', y2, ']', chr(10), '[FORGED_CONTENT]: total ', x1, chr(10), '[REASON]: strokes differ', chr(10), 'at ', x2, chr(10)), chr(10) ORDER BY item) AS b FROM bx WHERE f = 'R' GROUP BY 1) SELECT r.doc, md5(concat('# FORGERY ANALYSIS REPORT', chr(10), chr(10), '**[Conclusion]:** ', CASE WHEN r.doc % 2 = 0 THEN 'FORGED' ELSE 'PRISTINE' END, chr(10), '**[RISK_SCORE]:** ', r.doc % 101, chr(10), chr(10), b, chr(10), '## SUMMARY', chr(10), 'seen ', n, ' times', chr(10))) AS digest FROM r JOIN s USING (doc)")
def _(spark, d):
    return I.reports(spark, d).select("doc", F.md5(R.serialize_dataset(R.parse_report(F.col(TX)))).alias("digest"))


@query("h10_serialize_submission", f"{REPORT_SQL}, s AS (SELECT doc, string_agg(concat('Region ', item, ': [', x1, ', ', y1, ', ', x2, ', ', y2, '], total ', x1), chr(10) ORDER BY item) AS b FROM bx WHERE f = 'R' GROUP BY 1) SELECT r.doc, md5(concat('Conclusion: ', CASE WHEN r.doc % 2 = 0 THEN 'Forged' ELSE 'Authentic' END, chr(10), 'Score: ', r.doc % 101, chr(10), chr(10), 'Tamper Regions:', chr(10), b, chr(10), chr(10), 'Summary:', chr(10), 'seen ', n, ' times', chr(10))) AS digest FROM r JOIN s USING (doc)")
def _(spark, d):
    return I.reports(spark, d).select("doc", F.md5(R.serialize_submission(R.parse_report(F.col(TX)))).alias("digest"))


@query("h11_explanation", f"{REPORT_SQL}, s AS (SELECT doc, string_agg(concat('strokes differ', chr(10), 'at ', x2), chr(10) ORDER BY item) AS b FROM bx WHERE f = 'R' GROUP BY 1) SELECT r.doc, md5(concat(b, chr(10), 'seen ', n, ' times')) AS digest FROM r JOIN s USING (doc)")
def _(spark, d):
    return I.reports(spark, d).select("doc", F.md5(R.explanation(R.parse_report(F.col(TX)))).alias("digest"))


SAID = "regexp_replace(text, '[^A-Za-z ]', '', 'g')"
THINK = f"concat('--- STAGE 1: Knowledge Preparation ---', chr(10), {SAID}, chr(10), '--- STAGE 2: Filter ---', chr(10), 'REGION_001 [1, 2, ', turn, ', 9]: soft edge. → KEEP as Visual Clumsy.', chr(10), 'REGION_002 [3, 3, 5, 5]: noise. → DROP.', chr(10), '--- STAGE 3: Semantics ---', chr(10), 'none', chr(10), '--- STAGE 4: Verdict ---', chr(10), 'done')"
ONE = f"concat('--- STAGE 1: Knowledge Preparation ---', CASE WHEN trim({SAID}) = '' THEN '' ELSE concat(chr(10), rtrim({SAID})) END)"


def _on_trace(name, expression, sql=None):
    @query(name, sql and f"SELECT conv_id, turn, {sql} AS value FROM conversations")
    def _(spark, d):
        return I.traces(spark, d).select("conv_id", "turn", expression().alias("value"))


RAW, THOUGHT = "raw", "think"


def _on_answer(name, columns, sql):
    @query(name, f"WITH {I.ANSWERS_SQL} SELECT conv_id, turn, {sql} FROM a")
    def _(spark, d):
        return I.answers(spark, d).select("conv_id", "turn", *columns(F.col("raw")))


BODY = "concat('# FORGERY ANALYSIS REPORT', chr(10), 'body ', turn, chr(10), '**END OF REPORT**')"
OUTER = "CASE shape WHEN 0 THEN {body} WHEN 1 THEN {second} WHEN 2 THEN concat('# FORGERY ANALYSIS REPORT', chr(10), 'final ', turn) ELSE trim(concat('stage 1 ', said)) END AS report"
SPACED = "concat('#  Forgery Analysis  Report', chr(10), 'body ', turn)"
_on_answer("h12_clean_report", lambda t: [T.clean_report(t).alias("report")], OUTER.format(body=BODY, second=f"concat({SPACED}, chr(10), '```')"))
_on_answer("h13_clean_report_v0", lambda t: [T.clean_report_v0(t).alias("report")], OUTER.format(body=BODY, second=SPACED))
_on_answer("h14_think", lambda t: [T.think_or_stages(t).alias("think")], "CASE shape WHEN 0 THEN said WHEN 3 THEN trim(concat('stage 1 ', said)) END AS think")
_on_answer(
    "h15_strip_thinking",
    lambda t: [T.strip_thinking(t)["thinking"].alias("thinking"), T.strip_thinking(t)["answer"].alias("answer")],
    f"""CASE shape WHEN 0 THEN said WHEN 1 THEN concat('<report>', chr(10), '```md') WHEN 2 THEN trim(concat('stage1 ', said)) ELSE '' END AS thinking,
    CASE shape WHEN 0 THEN concat('<report>', {BODY}, chr(10), 'tail</report>') WHEN 1 THEN concat({SPACED}, chr(10), '```', chr(10), '</report> after')
      WHEN 2 THEN concat('# FORGERY ANALYSIS REPORT', chr(10), 'draft', chr(10), '# FORGERY ANALYSIS REPORT', chr(10), 'final ', turn) ELSE trim(concat('stage 1 ', said)) END AS answer""",
)
_on_trace("h16_blocks", lambda: T.block(F.col(RAW), "report"), "concat('# FORGERY ANALYSIS REPORT', chr(10), 'body ', turn, chr(10), '**END OF REPORT**', chr(10), 'tail')")
_on_trace("h17_trim_tail", lambda: T.trim_tail(F.concat(F.col("role"), F.lit(" body </think>\n```json\n**END OF REPORT** "))), "concat(role, ' body')")
_on_trace("h18_stage1", lambda: T.stage_one(F.col(THOUGHT)), ONE)
_on_trace("h19_first_two", lambda: F.md5(T.stages(F.col(THOUGHT), 1, 3)), f"md5(concat('--- STAGE 1: Knowledge Preparation ---', chr(10), {SAID}, chr(10), '--- STAGE 2: Filter ---', chr(10), 'REGION_001 [1, 2, ', turn, ', 9]: soft edge. → KEEP as Visual Clumsy.', chr(10), 'REGION_002 [3, 3, 5, 5]: noise. → DROP.'))")
_on_trace("h19_stages_34", lambda: T.stages(F.col(THOUGHT), 3, None), "concat('--- STAGE 3: Semantics ---', chr(10), 'none', chr(10), '--- STAGE 4: Verdict ---', chr(10), 'done')")
_on_trace("h19_reasoning", lambda: F.md5(T.stages(F.col(THOUGHT), 1, None)), f"md5({THINK})")
_on_trace("h20_keep_blocks", lambda: F.array_join(T.kept_blocks(F.col(THOUGHT)), "\n"), "concat('REGION_001 [1, 2, ', turn, ', 9]: soft edge. → KEEP as Visual Clumsy.')")
_on_trace("h21_filtered", lambda: F.md5(T.filtered_regions(F.col(THOUGHT))), f"md5(concat({ONE}, chr(10), chr(10), '--- STAGE 2 KEEP regions (filtered) ---', chr(10), chr(10), 'REGION_001 [1, 2, ', turn, ', 9]: soft edge. → KEEP as Visual Clumsy.'))")


def _first_stage():
    n = F.col("turn").cast("string")
    return F.concat(F.lit("before KEEP as Visual Clumsy [9, 9, 9, 9]\nREGION 1: [1, 2, "), n, F.lit(", 9], [5,6,7,8] and [5, 6, 7, 8] soft → keep  as Visual Clumsy, but "), F.col("said"), F.lit("\nREGION 2 [3, 3, 5, 5] DROP\nREGION  3 [-4 ,0,"), n, F.lit(",9] KEEP as Logical Fraud [1, 1, 2, x] REGION_4 [7, 7, 8, 8]"))


_on_trace("h22_kept_boxes", lambda: F.to_json(T.kept_boxes(_first_stage())), "concat('[[1,2,', turn, ',9],[5,6,7,8],[-4,0,', turn, ',9],[7,7,8,8]]')")
_on_trace("h40_truncate", lambda: T.truncate(F.col("text"), 40), "CASE WHEN length(text) > 40 THEN concat(substring(text, 1, 39), '…') ELSE text END")
_on_trace("h42_is_sentence", lambda: T.is_sentence(F.col("text")), "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) >= 3 OR length(text) - length(replace(text, ' ', '')) >= 2")


@query("h23_grounding_list", f"WITH {BOX_SQL} SELECT doc, count(*) AS n, CAST(sum(x1) AS BIGINT) AS total FROM bx WHERE f = 'R' GROUP BY 1")
def _(spark, d):
    g = I.reports(spark, d).select("doc", T.groundings(F.col(TX)).alias("g"))
    return g.select("doc", F.size("g").cast("bigint").alias("n"), F.aggregate("g", F.lit(0).cast("bigint"), lambda s, b: s + F.get(b, F.lit(0))).alias("total"))


@query("h24_replace_grounding", f"WITH {BOX_SQL} SELECT doc, '7,8,9,10' AS first FROM bx WHERE f = 'R' GROUP BY 1")
def _(spark, d):
    new = T.replace_first_grounding(F.col(TX), F.array(*map(F.lit, (7, 8, 9, 10))))
    return I.reports(spark, d).select("doc", F.array_join(F.get(T.groundings(new), F.lit(0)).cast("array<string>"), ",").alias("first"))


VALIDATED = f"SELECT conv_id, turn, turn % 2 = 0 AS report_match, CASE WHEN contains(lower({SAID}), 'as revealed') THEN 'as revealed' END AS forbidden_phrase, turn % 2 = 0 AND NOT contains(lower({SAID}), 'as revealed') AS ok FROM conversations"


def _validated(traces):
    wanted = F.concat(F.lit("# FORGERY ANALYSIS REPORT  body "), F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")).otherwise("x"), F.lit("\n**END OF REPORT** tail"))
    return traces.select("conv_id", "turn", T.validation(F.col(RAW), wanted).alias("v")).select("conv_id", "turn", "v.report_match", "v.forbidden_phrase", "v.ok")


@query("h25_validate", VALIDATED)
def _(spark, d):
    return _validated(I.traces(spark, d))


JUDGED = "SELECT p_partkey, CAST(least(100, p_size * 3) AS DOUBLE) AS factuality, CASE WHEN p_partkey % 3 = 2 THEN 0.0 ELSE CAST(p_partkey % 90 AS DOUBLE) END AS reasoning FROM part"


@query("h27_judge_json_robust", JUDGED)
def _(spark, d):
    k = F.col("p_partkey")
    f, r = (F.col("p_size") * 3).cast("string"), (k % 90).cast("string")
    said = F.when(k % 3 == 0, F.concat(F.lit('{"Factuality": '), f, F.lit(', "reasoning": '), r, F.lit("}"))).when(k % 3 == 1, F.concat(F.lit('Sure: {"factuality": '), f, F.lit(', "reasoning": "'), r, F.lit('"} done'))).otherwise(F.concat(F.lit("factuality = "), f, F.lit("; none")))
    return read(spark, d, "part").select("p_partkey", T.judge_scores(said).alias("s")).select("p_partkey", "s.factuality", "s.reasoning")


@query("h26_judge_json_simple", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE 0.0 END AS factuality FROM part")
def _(spark, d):
    said = F.concat(F.lit("x {"), F.when(F.col("p_partkey") % 2 == 0, '"factuality": ').otherwise('"other": '), F.col("p_size").cast("string"), F.lit("} y"))
    return read(spark, d, "part").select("p_partkey", T.judge_scores_simple(said)["factuality"].alias("factuality"))


@query("h28_chunk_text")
def _(spark, d):
    return budget.chunked(read(spark, d, "documents"), "text").select("doc_id", F.size("chunks").alias("n"), F.array_max(F.transform("chunks", lambda c: F.length(c))).alias("longest"))


@query("h29_align_chunks", "SELECT user_id, greatest(count(*) FILTER (event_type = 'view'), count(*) FILTER (event_type = 'click')) AS n FROM events GROUP BY 1")
def _(spark, d):
    lists = read(spark, d, "events").groupBy("user_id").agg(*[F.collect_list(F.when(F.col("event_type") == t, F.lit("c"))).alias(t) for t in ("view", "click")])
    return lists.select("user_id", F.size(budget.aligned(F.col("view"), F.col("click"))).cast("bigint").alias("n"))


def _region_array(spark, d, *more):
    r = I.family(spark, d, "R", "region")
    return r.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("region", "x1", "y1", "x2", "y2", *more))).alias("regions"))


HEAD = "concat('DTD flagged ', count(*), ' suspicious region(s):', chr(10), string_agg(concat('  Region ', item, ': [', x1, ', ', y1, ', ', x2, ', ', y2, ']'{more}), chr(10) ORDER BY item))"


@query("h32_hints_plain", f"WITH {BOX_SQL} SELECT doc, {HEAD.format(more='')} AS value FROM bx WHERE f = 'R' GROUP BY 1")
def _(spark, d):
    return _region_array(spark, d).select("doc", T.hints_plain(F.col("regions")).alias("value"))


@query("h31_hints_conf", f"WITH {BOX_SQL} SELECT doc, {HEAD.format(more=', concat(chr(32), chr(40), chr(109), $$ean confidence $$, printf($$%.3f$$, x1 / 8.0), chr(41))')} AS value FROM bx WHERE f = 'R' GROUP BY 1")
def _(spark, d):
    return _region_array(spark, d, (F.col("x1") / 8.0).alias("confidence")).select("doc", T.hints_confidence(F.col("regions")).alias("value"))


@query("h33_tp_fp_text", f"WITH {BOX_SQL} SELECT doc, string_agg(concat('  DTD Region ', item, ' [', x1, ', ', y1, ', ', x2, ', ', y2, ']: ', CASE WHEN x1 % 2 = 0 THEN 'TP (real tampering — KEEP)' ELSE 'FP (false alarm — DROP)' END), chr(10) ORDER BY item) AS value FROM bx WHERE f = 'R' GROUP BY 1")
def _(spark, d):
    return _region_array(spark, d, (F.col("x1") % 2 == 0).alias("tp")).select("doc", T.hints_tp_fp(F.col("regions")).alias("value"))


@query("h30_hints")
def _(spark, d):
    r = S.region_words(I.family(spark, d, "R", "region"), I.words(spark, d), 0.4, 6)
    return r.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("region", "x1", "y1", "x2", "y2", "words"))).alias("regions")).select("doc", T.hints_words(F.col("regions")).alias("value"))


def _items(spark, d):
    w = I.words(spark, d).withColumn("confidence", F.lit(0.5))
    return w.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("id", "text", "x1", "y1", "x2", "y2", "confidence"))).alias("items"))


@query("h34_ocr_compact", f"WITH {BOX_SQL} SELECT doc, concat('Detected words as (text, [bbox], confidence) triplets:', chr(10), chr(10), string_agg(concat('(\"w', x1, '\", [', x1, ', ', y1, ', ', x2, ', ', y2, '], 0.5)'), ', ' ORDER BY item), chr(10), chr(10), 'Reading-order text:', chr(10), chr(10), 'all ', doc) AS value FROM bx WHERE f = 'N' GROUP BY 1")
def _(spark, d):
    return _items(spark, d).select("doc", T.ocr_compact(F.col("items"), F.concat(F.lit(" all "), F.col("doc").cast("string"))).alias("value"))


@query("h35_ocr_json")
def _(spark, d):
    return _items(spark, d).select("doc", F.to_json("items").alias("value"))


@query("h36_ocr_prompt")
def _(spark, d):
    return _items(spark, d).select("doc", T.ocr_listing(F.lit("en"), F.col("items"), F.lit("all")).alias("value"))


@query("h37_substitute", "SELECT conv_id, turn, concat('Look at ', role, ' then ', turn, ' end') AS value FROM conversations")
def _(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.substitute(F.lit("Look at {{OCR_JSON}} then {{DTD_HINTS}}{{FILTERED_DTD}} end"), {"OCR_JSON": F.col("role"), "DTD_HINTS": F.col("turn").cast("string")}, ("FILTERED_DTD",)).alias("value"))


@query("h38_image_meta", "SELECT p_partkey, CASE WHEN p_size > 25 THEN concat('p Image size: ', p_size) ELSE concat('p Image size: 0', ' #') END AS value FROM part")
def _(spark, d):
    p = F.when(F.col("p_size") > 25, "p").otherwise("p Image size: 0")
    return read(spark, d, "part").select("p_partkey", F.when(p.contains("Image size"), F.concat(p, F.lit(" #"))).otherwise(F.concat(p, F.lit(" Image size: "), F.col("p_size").cast("string"))).alias("value"))


@query("h39_chat", "SELECT conv_id, concat('{\"id\":\"', conv_id, '\",\"n\":', count(*), '}') AS value FROM conversations GROUP BY 1")
def _(spark, d):
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    return turns.select("conv_id", F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), F.size("messages").alias("n")), {"ignoreNullFields": "false"}).alias("value"))


@query("h41_viz_parse", f"WITH {BOX_SQL} SELECT doc, CAST(item AS VARCHAR) AS item, 'Clumsy' AS type, concat(x1, ',', y1, ',', x2, ',', y2) AS box, concat('strokes differ [NOTE] at ', x2) AS reason FROM bx WHERE f = 'R' AND item % 3 <> 0")
def _(spark, d):
    """Headers in the middle of lines, tags inside reasons, boxes that aren't whole numbers."""
    s = lambda c: F.col(c).cast("string")
    corner = F.concat(s("x1"), F.when(F.col("item") % 3 == 0, ".5").otherwise(""))
    one = F.concat(F.lit("seen ### anomaly"), s("item"), F.lit(" : Clumsy: \n[GROUNDING]: [ "), corner, F.lit(" ,"), s("y1"), F.lit(", "), s("x2"), F.lit(","), s("y2"), F.lit("]\n[REASON]: strokes  differ\n[NOTE] at "), s("x2"), F.lit("\n --- \nrest "))
    texts = I.boxes(spark, d, "R").groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", one.alias("t")))), lambda x: x["t"]), "").alias("text"))
    a = texts.select("doc", F.explode(R.visual_anomalies(F.col("text"))).alias("a"))
    return a.select("doc", F.col("a.index").alias("item"), "a.type", F.array_join(F.col("a.grounding").cast("array<string>"), ",").alias("box"), "a.reason")


@query("h43_lang_class", "SELECT DISTINCT lang, CASE WHEN lang IN ('ar', 'fa', 'ur', 'he') THEN 'rtl' WHEN lang IN ('zh', 'ja', 'th') THEN 'continuous' ELSE 'spaced' END AS kind FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("lang").distinct().select("lang", T.script_class(F.col("lang")).alias("kind"))


# --- I: budgets -------------------------------------------------------------------------------------------------


@query("i01_head_budget", "SELECT doc_id, len(string_split(text, ' ')) AS n, least(len(string_split(text, ' ')), CASE WHEN 500 - n_chars % 600 < 64 THEN 175 ELSE 500 - n_chars % 600 END) AS kept FROM documents")
def _(spark, d):
    t = F.split("text", " ", -1)
    b = T.head_budget(700, 100, (F.col("n_chars") % 600), 100)
    return read(spark, d, "documents").select("doc_id", F.size(t).cast("bigint").alias("n"), F.size(T.keep_head(t, b.cast("int"))).cast("bigint").alias("kept"))


@query("i02_head_teacher", "SELECT doc_id, least(len(string_split(text, ' ')), 300 - 64) AS kept FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(T.keep_head(F.split("text", " ", -1), F.lit(300 - 64))).cast("bigint").alias("kept"))


@query("i03_fit_sample")
def _(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.col("text").alias("prompt"), F.col("text").alias("target"))
    return budget.fitted_pairs(docs, "prompt", "target", 200).select("doc_id", "fitted.status", F.length("fitted.prompt").alias("prompt_chars"))


@query("i04_pad", "SELECT lang, CAST(ceil(max(n_chars) / 8.0) * 8 AS BIGINT) AS padded FROM documents GROUP BY 1")
def _(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(T.padded_length(F.max("n_chars")).alias("padded"))


# --- K: composed ------------------------------------------------------------------------------------------------


@query("k05_augment", f"WITH {BOX_SQL} SELECT doc, count(*) AS n FROM bx WHERE f = 'A' GROUP BY 1")
def _(spark, d):
    out = P.augment(I.family(spark, d, "A", "item"), I.family(spark, d, "R", "candidate"), I.family(spark, d, "N", "candidate"), I.family(spark, d, "A", "candidate"))
    return out.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


@query("k06_prerender")
def _(spark, d):
    words = S.region_words(I.family(spark, d, "R", "region"), I.words(spark, d), 0.4, 6)
    regions = words.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("region", "x1", "y1", "x2", "y2", "words"))).alias("regions"))
    records = regions.join(_items(spark, d), "doc").select(F.col("doc").alias("id"), F.lit("part000").alias("part"), "items", F.lit("all").alias("reading_order"), "regions", F.lit("").alias("raw"))
    templates = spark.createDataFrame([("one", "A {{OCR_JSON}} B"), ("two", "C {{DTD_HINTS}} {{FILTERED_DTD}}")], "name string, text string")
    return P.render_prompts(records, templates).select("id", "template", F.md5("prompt").alias("digest"))


@query("k08_train_set", "SELECT CASE WHEN turn % 5 = 0 THEN 'excluded' WHEN turn % 2 = 1 THEN 'not_valid' ELSE 'ok' END AS reason, count(*) AS n FROM conversations GROUP BY 1")
def _(spark, d):
    t = I.traces(spark, d).select(F.col("turn").cast("string").alias("stem"), "raw", F.lit("r").alias("report"), (F.col("turn") % 2 == 0).alias("ok"), F.lit("a.jpg").alias("image"))
    excluded = read(spark, d, "conversations").where("turn % 5 = 0").select(F.col("turn").cast("string").alias("stem")).distinct()
    return P.training_rows(t, excluded).groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("k10_two_stage", "SELECT conv_id, turn, concat('# FORGERY ANALYSIS REPORT', chr(10), 'seen') AS report FROM conversations")
def _(spark, d):
    items = I.traces(spark, d).select("conv_id", "turn", F.col("think").alias("prompt"))
    out = P.two_stages(items, lambda: (lambda ps: ps), lambda: (lambda ps: ["<report># FORGERY ANALYSIS REPORT\nseen</report>" for _ in ps]), F.lit("go {{FILTERED_DTD}}"))
    return out.select("conv_id", "turn", "report")


@query("k14_prompt_stats", "SELECT CAST(sum(len(list_filter(regexp_split_to_array(text, '[\\s\\x1c-\\x1f\\x85\\xa0]+'), lambda x: x <> ''))) AS BIGINT) AS total FROM conversations")
def _(spark, d):
    return P.prompt_statistics(read(spark, d, "conversations"), "conv_id", "text", 100)["stats"].select("total")


@query("similarity_contract")
def _(spark, d):
    v = read(spark, d, "embeddings").select("label", F.when(F.col("vec_id") % 2 == 0, "left").otherwise("right").alias("side"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out = M.greedy_similarity(v, ["label"], "left", "right")
    return out.select("label", *[F.round(c, 5).alias(c) for c in ("precision", "recall", "f1")])


@query("judge_contract", "SELECT 75.0 AS factuality, 70.0 AS reasoning, 65.0 AS completeness, count(*) AS n FROM benchmark")
def _(spark, d):
    s = read(spark, d, "benchmark").select(T.judge_scores(contracts.judge(F.col("text"))).alias("s"))
    return s.groupBy("s.factuality", "s.reasoning", "s.completeness").agg(F.count(F.lit(1)).alias("n"))
