"""Queries through registered SQL functions, and text similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import session
from ..operators import relational as L, similarity
from . import inputs as I, pipelines as P
from .inputs import BOX_SQL, read
from .more_queries import AREA, COMPONENTS, INTER, PAIR_SQL, REPORT_SQL, _pairs
from .queries import iou_sql, query, r6

_BOXES = "named_struct('x1', a_x1, 'y1', a_y1, 'x2', a_x2, 'y2', a_y2), named_struct('x1', b_x1, 'y1', b_y1, 'x2', b_x2, 'y2', b_y2)"


@query("sql_geometry", f"""{PAIR_SQL} SELECT doc, item, round({iou_sql('a_', 'b_')}, 6) AS iou,
  round(CASE WHEN {INTER} > 0 THEN CAST({INTER} AS DOUBLE) / least(greatest(1, {AREA['a_']}), greatest(1, {AREA['b_']})) ELSE 0.0 END, 6) AS iomin, round(CAST({INTER} AS DOUBLE) / greatest(1, {AREA['b_']}), 6) AS overlap,
  round(CAST({INTER} AS DOUBLE) / ({AREA['a_']} + {AREA['b_']} - {INTER}), 6) AS iou_viz, CAST(least(a_x1, b_x1) AS BIGINT) AS x1, CAST(greatest(a_y2, b_y2) AS BIGINT) AS y2 FROM p""")
def _(spark, d):
    session.register(spark)
    _pairs(spark, d).createOrReplaceTempView("vd_pairs")
    return spark.sql(f"""SELECT doc, item, round(box_iou({_BOXES}), 6) AS iou, round(box_intersection_over_min({_BOXES}), 6) AS iomin, round(box_overlap_fraction({_BOXES}), 6) AS overlap,
        round(box_iou_clamped({_BOXES}), 6) AS iou_viz, box_union({_BOXES}).x1 AS x1, box_union({_BOXES}).y2 AS y2 FROM vd_pairs""")


@query("sql_reports", f"""{REPORT_SQL} SELECT doc, CASE WHEN doc % 2 = 0 THEN 'FORGED' ELSE 'PRISTINE' END AS conclusion, CAST(doc % 101 AS INTEGER) AS risk, CAST(n AS INTEGER) AS n_blocks, concat('seen ', n, ' times') AS summary, CAST(n AS INTEGER) AS n_boxes,
  concat('# FORGERY ANALYSIS REPORT', chr(10), 'x ', doc) AS cleaned FROM r""")
def _(spark, d):
    session.register(spark)
    I.reports(spark, d).createOrReplaceTempView("vd_reports")
    return spark.sql(r"""SELECT doc, report_conclusion(text) AS conclusion, report_risk_score(text) AS risk, size(report_blocks(text)) AS n_blocks, report_summary(text) AS summary, size(report_boxes(parse_report(text))) AS n_boxes,
        clean_report(concat('```md\n', text, '\n# FORGERY ANALYSIS REPORT\nx ', doc, '\n```\n')) AS cleaned FROM vd_reports""")


@query("sql_table_functions", COMPONENTS.format(near="abs(p.y - q.y) + abs(p.x - q.x) <= 1"))
def _(spark, d):
    session.register(spark)
    I.maps(spark, d).createOrReplaceTempView("vd_maps")
    return spark.sql("SELECT doc, number, x1, y1, x2, y2 FROM mask_to_boxes(TABLE(vd_maps) PARTITION BY (doc), 0.1D, 3, 4)")


_G = "list_distinct(list_transform(range(1, length({0}) + 1), lambda k: substring('^' || {0} || '$', k, 3)))"
_TOKENS = "SELECT conv_id, turn, i, t, count(*) AS n FROM (SELECT conv_id, turn, i, unnest(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')) AS t FROM c) GROUP BY 1, 2, 3, 4"


_SCORED = """
  lt AS ({left}), rt AS ({right}),
  s AS (SELECT conv_id, turn, i, x, y, 2.0 * len(list_intersect(gx, gy)) / (len(gx) + len(gy)) AS s FROM (
    SELECT lt.conv_id, lt.turn, lt.i, lt.t AS x, rt.t AS y, {gx} AS gx, {gy} AS gy FROM lt JOIN rt ON lt.conv_id = rt.conv_id AND lt.turn = rt.turn AND lt.i = rt.i)),
  bx_ AS (SELECT conv_id, turn, i, x AS t, max(s) AS s FROM s WHERE s >= 0.5 GROUP BY 1, 2, 3, 4), by_ AS (SELECT conv_id, turn, i, y AS t, max(s) AS s FROM s WHERE s >= 0.5 GROUP BY 1, 2, 3, 4),
  rc AS (SELECT lt.conv_id, lt.turn, lt.i, sum(n * coalesce(s, 0.0)) / sum(n) AS v FROM lt LEFT JOIN bx_ USING (conv_id, turn, i, t) GROUP BY 1, 2, 3),
  pc AS (SELECT rt.conv_id, rt.turn, rt.i, sum(n * coalesce(s, 0.0)) / sum(n) AS v FROM rt LEFT JOIN by_ USING (conv_id, turn, i, t) GROUP BY 1, 2, 3),
  e AS (SELECT c.conv_id, c.turn, c.i, coalesce(pc.v, 0.0) AS p, coalesce(rc.v, 0.0) AS r FROM c LEFT JOIN pc USING (conv_id, turn, i) LEFT JOIN rc USING (conv_id, turn, i))"""
_SCORED = _SCORED.format(left=_TOKENS.format("l"), right=_TOKENS.format("r"), gx=_G.format("lt.t"), gy=_G.format("rt.t"))


@query("text_similarity", f"""
  WITH p AS (SELECT a.conv_id, a.turn, string_split(a.text, '. ') AS l, string_split(b.text, '. ') AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
  c AS (SELECT conv_id, turn, i, l[i] AS l, r[i] AS r FROM (SELECT *, unnest(range(1, greatest(len(l), len(r)) + 1)) AS i FROM p)),
  {_SCORED}
  SELECT conv_id, turn, CAST(count(*) AS INTEGER) AS n_chunks, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END), 6) AS f1 FROM e GROUP BY 1, 2""")
def _(spark, d):
    """Each turn against the next one, sentence by sentence."""
    turns = read(spark, d, "conversations").select("conv_id", "turn", F.split("text", r"\. ", -1).alias("said"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("said").alias("next"))
    out = similarity.chunk_similarity(turns.join(after, ["conv_id", "turn"]), ["conv_id", "turn"], "said", "next")
    return out.select("conv_id", "turn", "n_chunks", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def _evaluation(limit: str = "") -> str:
    """Scores of reports against the report of another document (one or two before, so that verdicts agree in part)."""
    return f"""WITH {BOX_SQL}, k AS (SELECT doc, count(*) AS n FROM bx WHERE f = 'R' GROUP BY 1),
  q AS (SELECT t.doc AS id, o.doc AS other, t.n AS tn, o.n AS pn FROM k t JOIN k o ON o.doc = t.doc - 1 - (t.doc // 3) % 2 {limit}),
  det AS (SELECT count(*) AS n, CAST(count(*) FILTER (id % 2 = 0 AND other % 2 = 0) AS DOUBLE) AS tp, count(*) FILTER (id % 2 = 1 AND other % 2 = 0) AS fp, count(*) FILTER (id % 2 = 0 AND other % 2 = 1) AS fn FROM q),
  side AS (SELECT id, true AS real, x1, y1, x2, y2 FROM q JOIN bx ON bx.doc = q.id AND f = 'R' UNION ALL SELECT id, false, x1, y1, x2, y2 FROM q JOIN bx ON bx.doc = q.other AND f = 'R'),
  cell AS (SELECT id, x, y, bool_or(real) AS a, bool_or(NOT real) AS b FROM (SELECT id, real, x, unnest(range(y1, y2)) AS y FROM (SELECT id, real, y1, y2, unnest(range(x1, x2)) AS x FROM side)) GROUP BY 1, 2, 3),
  px AS (SELECT id, CAST(count(*) FILTER (a AND b) AS DOUBLE) AS tp, count(*) AS u, count(*) FILTER (a) + count(*) FILTER (b) AS ab FROM cell GROUP BY 1),
  gr AS (SELECT avg(tp / u) AS miou, avg(2 * tp / ab) AS mf1 FROM px),
  said AS (SELECT doc, string_agg(concat('strokes differ at ', x2), ' ') AS t FROM bx WHERE f = 'R' GROUP BY 1),
  c AS (SELECT id AS conv_id, 0 AS turn, 1 AS i, concat(x.t, ' seen ', tn, ' times') AS l, concat(y.t, ' seen ', pn, ' times') AS r FROM q JOIN said x ON x.doc = id JOIN said y ON y.doc = other),
  {_SCORED},
  ex AS (SELECT avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END) AS explanation FROM e),
  f AS (SELECT n, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1, miou, mf1, explanation FROM det CROSS JOIN gr CROSS JOIN ex)"""


_PARTS = ("precision", "recall", "f1", "miou", "mf1", "explanation")
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in _PARTS)


def _judged(spark, d):
    r = I.reports(spark, d)
    truth = r.select(F.col("doc").alias("id"), (F.col("doc") - 1 - F.expr("doc div 3") % 2).alias("other"), F.col("text").alias("truth"))
    return truth.join(r.select(F.col("doc").alias("other"), F.col("text").alias("predicted")), "other").select("id", "truth", "predicted", F.lit(150).alias("width"), F.lit(150).alias("height"))


def _axes(prompt: str) -> str:
    """A judge whose verdict depends on what it reads: how many lines there are."""
    return f'{{"factuality": {min(100, prompt.count(chr(10)))}, "reasoning": 50, "completeness": 0}}'


@query("k01_evaluate_against_meta", f"{_evaluation()} SELECT n, {_ROUNDED} FROM f")
def _(spark, d):
    return P.evaluate(_judged(spark, d)).select("n", *[r6(F.col(c)).alias(c) for c in _PARTS])


@query("k02_batch_eval", f"{_evaluation()}, ru AS (SELECT avg((least(100, 3 + 2 * tn + 2 * pn) + 50) / 3.0) / 100 AS rubric FROM q) SELECT n, round(rubric, 6) AS rubric, round(0.30 * f1 + 0.40 * (miou + mf1) / 2 + 0.15 * explanation + 0.15 * rubric, 6) AS final_score FROM f CROSS JOIN ru")
def _(spark, d):
    return P.evaluate(_judged(spark, d), judge=_axes).select("n", r6(F.col("rubric")).alias("rubric"), r6(F.col("final_score")).alias("final_score"))


@query("k03_folder_eval", f"{_evaluation('ORDER BY id LIMIT 100')} SELECT n, {_ROUNDED} FROM f")
def _(spark, d):
    return P.evaluate(L.head(_judged(spark, d), 100, "id")).select("n", *[r6(F.col(c)).alias(c) for c in _PARTS])
