"""Queries for sweeps of all modes, coordinates by offsets, and documents as files."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as T
from ..operators import contracts, coordinates, ranking as K, relational as L, sweep
from ..sources import documents as D, files
from ..streaming import incremental, resume
from ..tables import new_folder
from . import inputs as I, pipelines as P
from .inputs import BOX_SQL, META_SQL, read
from .queries import SPLIT, query, r6
from .session_queries import _axes

THRESHOLDS = (0.0, 0.05, 0.1, 0.15, 0.2)
RULES = {"regions": sweep.RegionRule(least_area=4, opening=0), "basin": sweep.BasinRule(height=0.02, least_area=4)}
PIXELS = f"""px AS (SELECT doc, i % 32 AS x, i // 32 AS y, v FROM (SELECT doc, (k - 1) * 64 + j - 1 AS i, CAST(e[j] AS DOUBLE) AS v FROM (SELECT doc, k, e, unnest(range(1, 65)) AS j FROM
    (SELECT vec_id // 16 AS doc, row_number() OVER (PARTITION BY vec_id // 16 ORDER BY vec_id) AS k, embedding AS e FROM embeddings)))),
  gt AS (SELECT doc, v, doc % 7 <> 0 AND x >= doc % 8 AND x < doc % 8 + 12 AND y >= doc % 5 AND y < doc % 5 + 9 AS real FROM px),
  c AS (SELECT doc, p AS place, t AS threshold, CAST(count(*) FILTER (real AND v >= t) AS DOUBLE) AS tp, count(*) FILTER (NOT real AND v >= t) AS fp, count(*) FILTER (real AND v < t) AS fn
    FROM gt CROSS JOIN (SELECT unnest([{", ".join(map(str, range(len(THRESHOLDS))))}]) AS p, CAST(unnest([{", ".join(map(str, THRESHOLDS))}]) AS DOUBLE) AS t) GROUP BY ALL),
  s AS (SELECT place, threshold, count(*) AS n, avg(CASE WHEN tp + fp + fn = 0 THEN 1 ELSE tp / (tp + fp + fn) END) AS miou, avg(CASE WHEN tp + fp + fn = 0 THEN 1 ELSE 2 * tp / (2 * tp + fp + fn) END) AS mf1,
    avg(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END) AS miou_no_fp, avg(CASE WHEN tp + fn = 0 THEN 1 ELSE 2 * tp / (2 * tp + fn) END) AS mf1_no_fp, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
    avg(tp) AS mean_tp, avg(fp) AS mean_fp, avg(fn) AS mean_fn FROM c GROUP BY 1, 2)"""
MEANS = ("miou", "mf1", "miou_no_fp", "mf1_no_fp", "mean_tp", "mean_fp", "mean_fn")


def _counts(spark, d, modes):
    return sweep.counts(I.map_pairs(spark, d), THRESHOLDS, modes, **RULES)


def _rounded(s):
    return s.select("mode", "threshold", "n", "tp", "fp", "fn", *[r6(F.col(c)).alias(c) for c in (*MEANS, "score", "score_no_fp")])


@query("k12_raw_sweep", f"WITH {PIXELS} SELECT 'raw' AS mode, threshold, n, tp, fp, fn, {', '.join(f'round({c}, 6) AS {c}' for c in MEANS)}, round((miou + mf1) / 2, 6) AS score, round((miou_no_fp + mf1_no_fp) / 2, 6) AS score_no_fp FROM s")
def _(spark, d):
    return _rounded(sweep.summary(_counts(spark, d, ["raw"])))


@query("k12_threshold_sweep")
def _(spark, d):
    """All modes; tests/test_sweep.py holds the counts against flooding at each threshold."""
    return _rounded(sweep.summary(_counts(spark, d, sweep.MODES)))


@query("k12_best_thresholds", f"WITH {PIXELS}, l AS (UNPIVOT (SELECT place, threshold, miou, mf1, (miou + mf1) / 2 AS score, miou_no_fp, mf1_no_fp, (miou_no_fp + mf1_no_fp) / 2 AS score_no_fp FROM s) ON miou, mf1, score, miou_no_fp, mf1_no_fp, score_no_fp INTO NAME metric VALUE value) SELECT 'raw' AS mode, metric, threshold, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY round(value, 12) DESC, place) AS r FROM l) WHERE r = 1")
def _(spark, d):
    found = sweep.best(sweep.summary(_counts(spark, d, ["raw"])).withColumns({c: F.round(c, 12) for c in ("miou", "mf1", "score", "miou_no_fp", "mf1_no_fp", "score_no_fp")}))
    return found.withColumn("value", r6("value"))


@query("c15_report_headers", f"WITH {BOX_SQL} SELECT doc, item AS number, lpad(CAST(item AS VARCHAR), 3, '0') AS index FROM bx WHERE f = 'R'")
def _(spark, d):
    """The header before each box of a report, by offsets in the report's text."""
    found = coordinates.grounding_headers(I.reports(spark, d))
    return found.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("at")).alias("number"), "index")


_ANOMALY = "concat('### ANOMALY_', lpad(CAST(r.item AS VARCHAR), 3, '0'), ': Visual Clumsy (row ', r.y1, ')', chr(10), '[GROUNDING]: [', coalesce(t.x1, r.x1), ', ', coalesce(t.y1, r.y1), ', ', coalesce(t.x2, r.x2), ', ', coalesce(t.y2, r.y2), ']', chr(10), '[FORGED_CONTENT]: total ', r.x1, chr(10), '[REASON]: strokes differ', chr(10), 'at ', r.x2, chr(10), chr(10))"


@query("c16_report_coords", f"""WITH {BOX_SQL}, t AS (SELECT * FROM (SELECT doc, item % 5 AS k, x1, y1, x2, y2, row_number() OVER (PARTITION BY doc, item % 5 ORDER BY item DESC) AS r FROM bx WHERE f = 'N') WHERE r = 1),
  w AS (SELECT r.doc, count(*) AS n, count(t.k) AS n_replaced, string_agg({_ANOMALY}, '' ORDER BY r.item) AS body FROM bx r LEFT JOIN t ON t.doc = r.doc AND t.k = r.item WHERE r.f = 'R' GROUP BY 1)
  SELECT doc, n_replaced, md5(concat('# FORGERY ANALYSIS REPORT', chr(10), chr(10), '**[Conclusion]:** ', CASE WHEN doc % 2 = 0 THEN 'FORGED' ELSE 'AUTHENTIC' END, chr(10), '**[RISK_SCORE]:** ', doc % 101, chr(10), chr(10), body, '## SUMMARY', chr(10), 'seen ', n, ' times', chr(10))) AS text_md5 FROM w""")
def _(spark, d):
    """Whole reports with the boxes of raw outputs that name some numbers twice and others not at all."""
    line = lambda b: F.format_string("ANOMALY_%03d: seen\n[GROUNDING] : [ %d,%d , %d, %d ]\n", b["item"] % 5, b["x1"], b["y1"], b["x2"], b["y2"])
    said = I.boxes(spark, d, "N").groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "x1", "y1", "x2", "y2"))), line), "").alias("raw"))
    out = coordinates.with_teacher_boxes(I.reports(spark, d), said)
    return out.select("doc", F.size(F.filter("replacements", lambda p: p["replaced"].isNotNull())).cast("bigint").alias("n_replaced"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


# --- files: each query writes what it then reads ---------------------------------------------------------------


@query("a04_pred_jsonl", "SELECT CAST(page_id AS VARCHAR) AS image_name, html AS report FROM pages")
def _(spark, d):
    root = new_folder(spark, "predictions")
    lines = read(spark, d, "pages").select(F.explode(F.array(F.to_json(F.struct(F.col("page_id").cast("string").alias("image_name"), F.col("html").alias("report"))), F.lit(""))).alias("value"))
    lines.write.option("compression", "gzip").text(root)
    return files.load_predictions(spark, root).select("image_name", "report")


@query("a05_pred_dir", "SELECT CASE WHEN doc_id % 4 = 0 THEN concat('folder', doc_id) ELSE concat(doc_id, '.jpg') END AS image_name, md5(coalesce(text, '')) AS report_md5 FROM documents WHERE doc_id % 7 <> 0")
def _(spark, d):
    """A folder for each document: every seventh file is broken, every fourth doesn't name its image."""
    root, n = new_folder(spark, "prediction-folders"), F.col("doc_id")
    image = F.when(n % 4 != 0, F.concat(n.cast("string"), F.lit(".jpg")))
    content = F.when(n % 7 == 0, "{broken").otherwise(F.to_json(F.struct(image.alias("image_name"), F.coalesce("text", F.lit("")).alias("report"))))
    D.write_documents(read(spark, d, "documents").select(F.format_string("folder%d/report.json", "doc_id").alias("name"), content.alias("content")), root)
    return files.load_prediction_folders(spark, root).select("image_name", F.md5(F.col("report").cast("binary")).alias("report_md5"))


@query("a07_npy_scan", "SELECT printf('part%03d', vec_id // 100) AS part, CAST(vec_id AS VARCHAR) AS stem, 8 AS h, 8 AS w, round(CAST(list_max(embedding) AS DOUBLE), 6) AS top, round(CAST(embedding[12] AS DOUBLE), 6) AS inner FROM embeddings")
def _(spark, d):
    """Maps under the second of two names, so that the first finds nothing."""
    root = new_folder(spark, "maps")
    maps = I.maps(spark, d).select(F.format_string("part%03d/%d", F.expr("doc div 100"), "doc").alias("stem"), "h", "w", "data")
    D.write_documents(files.npy_bytes(maps).select(F.concat("stem", F.lit(".dtd.prob.npy")).alias("name"), "content"), root)
    found = D.load_documents(spark, root, "*_dtd_prob.npy", "*.dtd.prob.npy").select(F.concat_ws("/", "part", "stem").alias("stem"), "content")
    at, v = F.split("stem", "/"), lambda c: r6(c.cast("double"))
    return files.decoded_maps(found).select(at[0].alias("part"), at[1].alias("stem"), "h", "w", v(F.array_max("data")).alias("top"), v(F.get("data", F.lit(11))).alias("inner"))


def _records(spark, d, suffix: str, each: str) -> str:
    root, docs = new_folder(spark, "records"), read(spark, d, "documents")
    size = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    record = F.to_json(F.struct(F.col("doc_id").cast("string").alias("stem"), F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image_name"), size.cast("int").alias("n_regions")))
    name = F.format_string(f"part%03d/%d{suffix}", F.expr(f"doc_id div {each}"), "doc_id")
    D.write_documents(docs.select(name.alias("name"), record.alias("content")), root)
    return root


@query("a09_record_scan", "SELECT CAST(doc_id AS VARCHAR) AS stem, concat(doc_id, '.jpg') AS image_name, printf('part%03d', doc_id // 250) AS part, CAST(n_chars AS INTEGER) AS n_regions FROM documents WHERE doc_id // 250 IN (0, 2) ORDER BY doc_id LIMIT 40")
def _(spark, d):
    """The first records of two parts, as a caller with a limit reads them; other parts aren't listed."""
    root = _records(spark, d, "_dtd.json", "250")
    at = [f"part{p:03d}" for p in (0, 2) if files.exists(spark, f"{root}/part{p:03d}")]
    found = files.load_records(spark, root, files.REGIONS, "_dtd.json", at).select("stem", "image_name", "part", "n_regions")
    return L.head(found.withColumn("k", F.col("stem").cast("bigint")), 40, "k").drop("k")


@query("a10_cot_scan", "SELECT printf('part%03d', doc_id // 100) AS part, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY 1")
def _(spark, d):
    found = files.load_records(spark, _records(spark, d, ".cot.json", "100"), files.REGIONS, ".cot.json")
    return found.groupBy("part").agg(F.count("stem").alias("n"), F.sum("n_regions").alias("total"))


@query("a14_exclude_list", "SELECT DISTINCT CAST(item_id AS VARCHAR) AS stem FROM benchmark WHERE item_id % 2 = 0")
def _(spark, d):
    root, n = new_folder(spark, "excluded"), F.col("item_id").cast("string")
    line = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("a/b/"), n, F.lit(".jpg  # why"))).when(F.col("item_id") % 2 == 0, n).when(F.col("item_id") % 3 == 0, "").otherwise(F.concat(F.lit("# "), n))
    read(spark, d, "benchmark").select(line.alias("value")).write.text(root)
    return files.load_excluded(spark, root)


@query("a17_partial_copy", "SELECT doc_id, CASE WHEN doc_id // 100 IN (0, 2) AND doc_id % 3 <> 2 AND doc_id % 5 <> 0 THEN 'two parts' WHEN doc_id % 5 = 0 AND doc_id % 3 = 0 THEN 'test images' END AS copy FROM documents")
def _(spark, d):
    """Which copies take a file: images and masks of two parts, or all images of the other split."""
    kind = F.element_at(F.array(F.lit("image"), F.lit("mask"), F.lit("report")), (F.col("doc_id") % 3 + 1).cast("int"))
    split = F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")
    paths = read(spark, d, "documents").select("doc_id", F.format_string("%s/%s/part%03d/%d.bin", split, kind, F.expr("doc_id div 100"), "doc_id").alias("path"))
    two, test = D.snapshot_patterns([0, 2], ("image", "mask")), D.snapshot_patterns(None, ("image",), "test")
    return paths.select("doc_id", F.when(D.in_snapshot("path", two), "two parts").when(D.in_snapshot("path", test), "test images").alias("copy"))


@query("a18_split_sink", f"WITH {SPLIT} SELECT split, sample_id FROM sp")
def _(spark, d):
    root = new_folder(spark, "split")
    files.write_split(L.stratified_split(I.meta(spark, d), "sample_id", ["language_code", "type"]), root)
    return spark.read.parquet(root).select("split", "sample_id")


@query("a21_record_update", "SELECT doc_id, n_chars, CASE WHEN quality = 0 THEN 'old' WHEN quality = 1 THEN 'new 1' END AS augmentation FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, d):
    """A new version of the records: what an earlier one added stays, the rest is added where there is something to add."""
    first, second = new_folder(spark, "records"), new_folder(spark, "records")
    labels = read(spark, d, "labels")
    old = labels.where("quality = 0").select("doc_id", F.lit("old").alias("augmentation"))
    read(spark, d, "documents").select("doc_id", "n_chars").join(old, "doc_id", "left").write.json(first)
    records = spark.read.schema("doc_id bigint, n_chars bigint, augmentation string").json(first)
    L.updated_records(records, labels.select("doc_id", F.concat(F.lit("new "), F.col("quality").cast("string")).alias("augmentation")), "doc_id", "augmentation").write.json(second)
    return spark.read.schema(records.schema).json(second)


@query("a22_doc_bundle", "SELECT conv_id, turn, 5 AS n_files, concat('# FORGERY ANALYSIS REPORT', chr(10), 'body ', turn, chr(10), '**END OF REPORT**', chr(10)) AS report, concat(turn, '.jpg') AS image_name FROM conversations")
def _(spark, d):
    """Five files a turn, written and read back by folder."""
    root = new_folder(spark, "bundles")
    stem = F.format_string("c%s_t%s", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    D.write_documents(P.bundle(I.traces(spark, d).select(stem.alias("stem"), F.concat(F.col("turn").cast("string"), F.lit(".jpg")).alias("image_name"), F.col("text").alias("prompt"), "raw")), root)
    found = D.load_documents(spark, root).withColumn("text", F.col("content").cast("string"))
    of = lambda file: F.max(F.when(F.col("stem").endswith(file), F.col("text")))
    docs = found.groupBy(F.regexp_extract("name", r"^c(.*)_t([0-9]+)/", 1).alias("conv_id"), F.regexp_extract("name", r"_t([0-9]+)/", 1).alias("turn"))
    out = docs.agg(F.count(F.lit(1)).cast("int").alias("n_files"), of("report.md").alias("report"), of("report.json").alias("json"))
    kinds = dict(read(spark, d, "conversations").dtypes)
    return out.select(F.col("conv_id").cast(kinds["conv_id"]).alias("conv_id"), F.col("turn").cast(kinds["turn"]).alias("turn"), "n_files", "report", F.get_json_object("json", "$.image_name").alias("image_name"))


@query("a24_judge_log", "SELECT item_id, CAST(least(100, length(text) - length(replace(text, 'e', ''))) AS DOUBLE) AS factuality FROM benchmark")
def _(spark, d):
    """Two runs append to one log; the judge's verdict depends on what it reads."""
    root = new_folder(spark, "judge-log")
    lines = F.regexp_replace(F.regexp_replace("text", "\\n", " "), "e", "\n")
    judged = read(spark, d, "benchmark").select("item_id", T.judge_scores(contracts.judge(lines, _axes)).alias("s"))
    for rest in (0, 1):
        files.append_log(judged.where(F.col("item_id") % 2 == rest), root)
    return spark.read.schema(judged.schema).json(root).select("item_id", F.col("s.factuality").cast("double").alias("factuality"))


@query("a25_prompt_sink", "SELECT doc_id, CASE WHEN doc_id IN (SELECT item_id FROM benchmark) THEN 'old' ELSE md5(coalesce(text, '')) END AS prompt FROM documents")
def _(spark, d):
    """Prompts of an earlier run stay; the others are written whole."""
    root, docs = new_folder(spark, "prompts"), read(spark, d, "documents")
    name = F.format_string("part%03d/%d.prompt.txt", F.expr("doc_id div 100"), "doc_id").alias("name")
    old = docs.join(read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi")
    D.write_documents(old.select(name, F.lit("old").alias("content")), root)
    D.write_documents(docs.select(name, F.coalesce("text", F.lit("")).alias("content")), root, "skip")
    content = F.when(F.col("content") == F.lit("old").cast("binary"), "old").otherwise(F.md5("content"))
    return D.load_documents(spark, root, "*.prompt.txt").select(F.col("stem").cast("bigint").alias("doc_id"), content.alias("prompt"))


def _mask_files(spark, d, root):
    masks = I.maps(spark, d).select(F.when(F.col("doc") % 2 == 0, F.col("doc").cast("string")).otherwise(F.concat(F.col("doc").cast("string"), F.lit("_mask"))).alias("stem"), "h", "w", F.transform("data", lambda v: (v > F.lit(0.2).cast("double")).cast("int")).alias("data"))
    D.write_documents(files.png_bytes(masks).select(F.concat("stem", F.lit(".png")).alias("name"), "content"), root)


@query("a06_meta_from_dirs", "SELECT CAST(d.doc_id AS VARCHAR) AS sample_id, e.vec_id IS NOT NULL AS has_mask, CASE WHEN l.quality = 0 THEN 'BLACK' WHEN l.quality = 1 THEN 'PRISTINE' WHEN e.vec_id IS NOT NULL AND list_max(e.embedding) > CAST(0.2 AS DOUBLE) THEN 'BLACK' ELSE 'PRISTINE' END AS type, CASE WHEN d.doc_id % 4 = 0 THEN NULL WHEN d.doc_id % 3 = 0 THEN concat(d.doc_id, '.jpg') ELSE concat(d.doc_id, '.png') END AS image FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def _(spark, d):
    """Reports, masks (half of them named with _mask) and images as files; every fourth image is absent, some are there twice."""
    root, n = new_folder(spark, "folders"), F.col("doc_id").cast("string")
    docs = read(spark, d, "documents").select("doc_id")
    _mask_files(spark, d, f"{root}/masks")
    images = docs.where("doc_id % 4 <> 0").select(F.explode(F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(".png"), F.lit(".jpg"))).otherwise(F.array(F.lit(".png")))).alias("kind"), n.alias("n"))
    D.write_documents(images.select(F.concat("n", "kind").alias("name"), F.lit("pixels").alias("content")), f"{root}/images")
    verdict = F.when(F.col("quality") == 0, "FORGED").otherwise("AUTHENTIC")
    D.write_documents(read(spark, d, "labels").where("quality IS NOT NULL").select(F.concat(n, F.lit("_report.md")).alias("name"), F.concat(F.lit("# FORGERY ANALYSIS REPORT\n\n**[Conclusion]:** "), verdict, F.lit("\n")).alias("content")), f"{root}/reports")
    out = files.metadata_from_folders(spark, docs.select(F.concat(n, F.lit(".jpeg")).alias("image_file")), f"{root}/reports", f"{root}/masks", f"{root}/images")
    return out.select("sample_id", F.col("mask_path").isNotNull().alias("has_mask"), "type", F.nullif(F.regexp_extract("image_path", "([^/]+)$", 1), F.lit("")).alias("image"))


@query("a08_mask_scan", "SELECT CAST(vec_id AS VARCHAR) AS stem, 8 AS h, 8 AS w, len(list_filter(embedding, lambda x: x > CAST(0.2 AS DOUBLE))) AS n_set FROM embeddings")
def _(spark, d):
    root = new_folder(spark, "masks")
    _mask_files(spark, d, root)
    return files.load_masks(spark, root).select("stem", "h", "w", F.size(F.filter("data", lambda v: v > 0)).cast("bigint").alias("n_set"))


@query("b03_getitem", f"WITH {META_SQL}, r AS (SELECT sample_id, language_code, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM meta) SELECT 'id' AS kind, 0 AS place, sample_id, language_code FROM r WHERE sample_id = '17' UNION ALL SELECT 'last', 0, sample_id, language_code FROM r WHERE k = n - 1 UNION ALL SELECT 'slice', (k - 5) // 7, sample_id, language_code FROM r WHERE k >= 5 AND k < n - 3 AND (k - 5) % 7 = 0 UNION ALL SELECT 'back', (n - 1 - k) // 50, sample_id, language_code FROM r WHERE (n - 1 - k) % 50 = 0 UNION ALL SELECT 'list', p, sample_id, language_code FROM r JOIN (SELECT unnest([0, 1, 2]) AS p, unnest([3, -2, 3]) AS q) ON k = CASE WHEN q < 0 THEN n + q ELSE q END")
def _(spark, d):
    m = I.meta(spark, d).select("doc_id", "sample_id", "language_code")
    asked = {"id": "17", "last": -1, "slice": slice(5, -3, 7), "back": slice(None, None, -50), "list": [3, -2, 3]}
    out = None
    for kind, key in asked.items():
        got = K.items(m, ["doc_id"], key).select(F.lit(kind).alias("kind"), F.col("place").cast("bigint").alias("place"), "sample_id", "language_code")
        out = got if out is None else out.unionByName(got)
    return out


@query("resumed_scores", "WITH t AS (SELECT quality = 0 AS truth, coalesce(toxic = 1, false) AS predicted, doc_id FROM documents LEFT JOIN labels USING (doc_id)), c AS (SELECT count(*) AS n, count(*) FILTER (truth IS NULL) AS n_without_truth, count(*) FILTER (truth) AS n_true, count(*) FILTER (predicted) AS n_predicted, count(*) FILTER (truth AND predicted) AS tp, count(*) FILTER (NOT truth AND predicted) AS fp, count(*) FILTER (truth AND NOT predicted) AS fn, count(*) AS n_grounded, avg(doc_id % 101 / 100.0) AS m FROM t) SELECT n, n_without_truth, n_true, n_predicted, tp, fp, fn, n_grounded, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS detection_f1, round(m, 6) AS mean_iou FROM c")
def _(spark, d):
    """Results arrive in two lots that overlap; the second run goes on from the state of the first."""
    src, out, check = (new_folder(spark, f"resume-{k}") for k in ("results", "sums", "state"))
    share = (F.col("doc_id") % 101) / 100.0
    docs = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left")
    rows = docs.select(F.col("doc_id").cast("string").alias("sample_id"), (F.col("quality") == 0).alias("truth"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("predicted"), share.alias("iou"), share.alias("f1"), "doc_id")
    for lot in (rows.where("doc_id % 3 <> 0"), rows.where("doc_id % 3 <> 1")):
        lot.drop("doc_id").write.mode("append").json(src)
        resume.running_scores(incremental.new_files(spark, src, resume.RESULT), out, check).awaitTermination()
    resume.finished(spark, check)
    names = ("n", "n_without_truth", "n_true", "n_predicted", "tp", "fp", "fn", "n_grounded")
    return resume.totals(spark, out).select(*names, r6("detection_f1").alias("detection_f1"), r6("mean_iou").alias("mean_iou"))
