"""Queries for discovery, sinks and the remaining pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import cli
from ..functions import report as R, text as T
from ..operators import contracts, metrics as M, raster, relational as L, spatial as S
from ..sources import files
from . import inputs as I, pipelines as P
from .inputs import BOX_SQL, META_SQL, read
from .queries import CELLS, SPLIT, query, r6


@query("a11_img_scan", f"WITH {META_SQL} SELECT image_file FROM meta WHERE image_file LIKE '%.jpg' ORDER BY image_file LIMIT 30")
def _(spark, d):
    return L.head(I.meta(spark, d).select("image_file").where(F.lower("image_file").rlike(r"\.(?:jpe?g|png)$") & ~F.lower("image_file").endswith(".png")), 30, "image_file")


@query("a13_tmpl_scan", "SELECT 'one' AS name, 'A {{OCR_JSON}}' AS text UNION ALL SELECT 'two', 'B'")
def _(spark, d):
    return spark.createDataFrame([("one", "A {{OCR_JSON}}"), ("two", "B")], "name string, text string")


@query("a15_hub_prune", "SELECT DISTINCT concat('train/images/part', lpad(CAST(doc_id // 100 AS VARCHAR), 3, '0'), '/*') AS pattern FROM documents WHERE lang = 'de' AND doc_id // 100 IN (0, 1, 2, 3)")
def _(spark, d):
    parts = read(spark, d, "documents").where("lang = 'de'").select(F.expr("doc_id div 100").alias("part")).distinct().where(F.col("part").isin(0, 1, 2, 3))
    return parts.select(F.concat(F.lit("train/images/part"), F.lpad(F.col("part").cast("string"), 3, "0"), F.lit("/*")).alias("pattern"))


@query("a23_eval_sink", "SELECT count(*) AS n, count(*) FILTER (quality = 0) AS n_forged FROM labels")
def _(spark, d):
    return read(spark, d, "labels").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 0).alias("n_forged"))


@query("a27_npy_sink")
def _(spark, d):
    m = I.maps(spark, d).select(F.col("doc").cast("string").alias("stem"), "h", "w", "data")
    return files.npy_bytes(m).select("stem", F.length("content").alias("n_bytes"))


@query("d09_weights", "SELECT 'library' AS name, 0.25::DOUBLE AS detection, 0.25::DOUBLE AS grounding UNION ALL SELECT 'command line', 0.3::DOUBLE, 0.4::DOUBLE")
def _(spark, d):
    return spark.createDataFrame([("library", M.EVEN["detection"], M.EVEN["grounding"]), ("command line", M.COMMAND_LINE["detection"], M.COMMAND_LINE["grounding"])], "name string, detection double, grounding double")


@query("k04_single_pair", "SELECT 75.0::DOUBLE AS factuality, 70.0::DOUBLE AS reasoning, 65.0::DOUBLE AS completeness")
def _(spark, d):
    one = spark.createDataFrame([("true report", "predicted report")], "truth string, predicted string")
    return one.select(T.judge_scores(contracts.judge(F.concat_ws("\n", "truth", "predicted"))).alias("s")).select("s.*")


@query("k07_extract")
def _(spark, d):
    found = raster.map_boxes(I.maps(spark, d), lambda m: raster.detector_regions(m, 0.05, 2, opening=0)).withColumnRenamed("number", "region")
    w = found.select("doc", F.col("region").alias("id"), F.concat(F.lit("t"), F.col("region").cast("string")).alias("text"), "x1", "y1", "x2", "y2")
    return S.region_words(found, w).select("doc", "region", F.size("words").alias("n_words"))


@query("k09_distill", "SELECT conv_id, turn, true AS ok FROM conversations WHERE NOT contains(lower(text), 'as revealed')")
def _(spark, d):
    t = I.traces(spark, d).where(~F.lower("text").contains("as revealed"))
    out = contracts.generate(t.select("conv_id", "turn", "raw"), "raw", lambda: (lambda ps: ps), "echo")
    wanted = F.concat(F.lit("# FORGERY ANALYSIS REPORT body "), F.col("turn").cast("string"), F.lit(" **END OF REPORT** tail"))
    return out.select("conv_id", "turn", T.validation(F.col("output"), wanted)["ok"].alias("ok"))


@query("k11_combined", f"WITH {BOX_SQL} SELECT doc, CASE WHEN doc % 2 = 0 THEN 'image' ELSE concat('DTD flagged ', count(*), ' suspicious region(s):') END AS hint FROM bx WHERE f = 'R' GROUP BY 1")
def _(spark, d):
    r = I.family(spark, d, "R", "region").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("region", "x1", "y1", "x2", "y2"))).alias("regions"))
    first = F.get(F.split(T.hints_plain(F.col("regions")), "\n"), F.lit(0))
    return r.select("doc", F.when(F.col("doc") % 2 == 0, "image").otherwise(first).alias("hint"))


@query("k13_stage1_eval", f"WITH {CELLS} SELECT round(avg(tp / CAST(tp + fp + fn AS DOUBLE)), 6) AS miou FROM px")
def _(spark, d):
    px = S.pixel_counts(I.family(spark, d, "A", "i"), I.family(spark, d, "R", "i"))
    return px.agg(r6(F.avg(M.pixel_metrics(F.col("tp"), F.col("fp"), F.col("fn"))["iou"])).alias("miou"))


@query("k15_cli", f"WITH {META_SQL} SELECT count(*) AS n, count(*) FILTER (has_mask) AS n_masks FROM meta")
def _(spark, d):
    return cli.stats(I.meta(spark, d)).select("n", "n_masks")


@query("report_round_trip", f"WITH {BOX_SQL} SELECT DISTINCT doc, true AS same FROM bx WHERE f = 'R'")
def _(spark, d):
    once = R.serialize_dataset(R.parse_report(F.col("text")))
    return I.reports(spark, d).select("doc", once.alias("a")).select("doc", (R.serialize_dataset(R.parse_report(F.col("a"))) == F.col("a")).alias("same"))
