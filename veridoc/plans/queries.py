"""Queries over the driver's tables, one for each operator, and the SQL that returns the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import geometry as G, report as R, text as T
from ..functions.geometry import Box
from ..operators import metrics as M, raster, ranking as K, relational as L, spatial as S
from ..sources import files
from . import inputs as I
from .inputs import BOX_SQL, META_SQL, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def r6(c):
    return F.round(c, 6)


MD5 = "md5(concat({}, '|42')), {}"
IOU = "CASE WHEN least({a}x2, {b}x2) > greatest({a}x1, {b}x1) AND least({a}y2, {b}y2) > greatest({a}y1, {b}y1) THEN CAST((least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * (least({a}y2, {b}y2) - greatest({a}y1, {b}y1)) AS DOUBLE) / ({aa} + {ab} - (least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * (least({a}y2, {b}y2) - greatest({a}y1, {b}y1))) ELSE 0.0 END"


def iou_sql(a: str, b: str) -> str:
    return IOU.format(a=a, b=b, aa=f"({a}x2 - {a}x1) * ({a}y2 - {a}y1)", ab=f"({b}x2 - {b}x1) * ({b}y2 - {b}y1)")


def inter_sql(a: str, b: str) -> str:
    return f"(greatest(0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1)))"


# --- A: sources ------------------------------------------------------------------------------------------------


@query("a01_meta_load", "SELECT doc_id, lang, source FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", "lang", "source")


@query("a02_missing_cols", "SELECT unnest(['has_mask', 'image_file', 'language', 'language_code', 'mask_file', 'report_file', 'report_text', 'sample_id', 'type']) AS missing")
def _(spark, d):
    return spark.createDataFrame([(c,) for c in files.missing_columns(read(spark, d, "documents"))], "missing string")


@query("a03_resolve_paths", f"WITH {META_SQL} SELECT sample_id, CASE WHEN doc_id % 2 = 0 THEN concat('images/part000/', image_file) END AS image_path FROM meta")
def _(spark, d):
    m = I.meta(spark, d)
    found = m.where("doc_id % 2 = 0").select(F.col("image_file").alias("name"), F.concat(F.lit("images/part000/"), "image_file").alias("path"))
    blank = m.withColumns({"mask_file": F.lit(None).cast("string"), "report_file": F.lit(None).cast("string")})
    return files.resolve_paths(blank, found).select("sample_id", "image_path")


@query("a12_items", "SELECT CAST(p.page_id % 7 AS BIGINT) AS part, count(*) AS n, count(*) FILTER (d.doc_id IS NULL) AS no_prompt, count(*) FILTER (l.doc_id IS NULL) AS no_heatmap FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id * 3 LEFT JOIN labels l ON l.doc_id = p.page_id GROUP BY 1")
def _(spark, d):
    p = read(spark, d, "pages").select("page_id")
    prompts = read(spark, d, "documents").select((F.col("doc_id") / 3).alias("k"), F.lit(1).alias("prompt"))
    heat = read(spark, d, "labels").select(F.col("doc_id").alias("page_id"), F.lit(1).alias("heat"))
    items = p.join(prompts, p.page_id.cast("double") == prompts.k, "left").join(heat, "page_id", "left")
    return items.groupBy((F.col("page_id") % 7).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prompt").isNull()).alias("no_prompt"), F.count_if(F.col("heat").isNull()).alias("no_heatmap"))


@query("a16_infer_parts", "SELECT DISTINCT CAST(doc_id // 1000 AS INTEGER) AS part FROM documents")
def _(spark, d):
    m = I.meta(spark, d)
    return files.infer_parts(m, ["image_file"])


@query("a19_sft_sink", "SELECT count(*) AS n FROM documents WHERE doc_id % 3 <> 0")
def _(spark, d):
    return I.meta(spark, d).where(F.col("image_file").endswith(".jpg")).agg(F.count(F.lit(1)).alias("n"))


@query("a20_regions_sink", f"WITH {BOX_SQL} SELECT doc % 3 AS part, count(*) AS n_regions FROM bx WHERE f = 'R' GROUP BY 1")
def _(spark, d):
    return I.family(spark, d, "R", "region").groupBy((F.col("doc") % 3).alias("part")).agg(F.count(F.lit(1)).alias("n_regions"))


@query("a26_step_stats", "SELECT event_type, count(*) AS steps, max(value) AS longest, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("steps"), F.max("value").alias("longest"), r6(F.avg("value")).alias("mean"))


# --- B: filters, samples, limits --------------------------------------------------------------------------------


@query("b01_filter", f"WITH {META_SQL} SELECT sample_id FROM meta WHERE language_code IN ('en', 'fr') AND type = 'black'")
def _(spark, d):
    return L.filter_equal(I.meta(spark, d), language_code=["en", "fr"], type="black").select("sample_id")


@query("b02_strict", f"WITH {META_SQL} SELECT sample_id FROM meta WHERE type IS NOT NULL")
def _(spark, d):
    return I.meta(spark, d).where(F.col("type").isNotNull()).select("sample_id")


@query("b04_sample", f"WITH {META_SQL} SELECT sample_id FROM meta ORDER BY {MD5.format('sample_id', 'sample_id')} LIMIT 25")
def _(spark, d):
    return L.sample(I.meta(spark, d), 25, "sample_id").select("sample_id")


@query("b05_split_restrict", f"WITH {META_SQL} SELECT sample_id FROM meta WHERE doc_id IN (SELECT item_id FROM benchmark)")
def _(spark, d):
    ids = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("original_sample_id"))
    return L.restrict(I.meta(spark, d), ids, "sample_id").select("sample_id")


@query("b06_balanced", f"WITH {META_SQL} (SELECT sample_id, type FROM meta WHERE type = 'black' ORDER BY {MD5.format('sample_id', 'sample_id')} LIMIT 10) UNION ALL (SELECT sample_id, type FROM meta WHERE coalesce(type, '') <> 'black' ORDER BY {MD5.format('sample_id', 'sample_id')} LIMIT 11)")
def _(spark, d):
    return L.balanced(I.meta(spark, d), 21, F.col("type") == "black", "sample_id").select("sample_id", "type")


@query("b07_judge_subset", f"WITH {META_SQL} SELECT sample_id FROM meta WHERE type = 'white' ORDER BY {MD5.format('sample_id', 'sample_id')} LIMIT 40")
def _(spark, d):
    return L.sample(I.meta(spark, d).where("type = 'white'"), 40, "sample_id").select("sample_id")


@query("b08_exclude", f"WITH {META_SQL} SELECT sample_id FROM meta WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def _(spark, d):
    return L.exclude(I.meta(spark, d), read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("sample_id")), "sample_id").select("sample_id")


@query("b09_skip_existing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 30")
def _(spark, d):
    return L.pending(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), "doc_id", 30)


@query("b10_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return L.pending(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), "doc_id")


@query("b11_skip_png", f"WITH {META_SQL} SELECT image_file FROM meta WHERE doc_id % 3 <> 0")
def _(spark, d):
    return I.meta(spark, d).where(~F.lower("image_file").endswith(".png")).select("image_file")


@query("b12_validation_ok", "SELECT doc_id FROM labels WHERE quality = 1")
def _(spark, d):
    v = read(spark, d, "labels").withColumn("validation", F.struct((F.col("quality") == 1).alias("ok")))
    return v.where(F.coalesce("validation.ok", F.lit(False))).select("doc_id")


@query("b13_permute", f"WITH {META_SQL} SELECT sample_id, row_number() OVER (ORDER BY {MD5.format('sample_id', 'sample_id')}) <= 50 AS first_half FROM meta")
def _(spark, d):
    m = I.meta(spark, d).select("sample_id")
    top = L.sample(m, 50, "sample_id").withColumn("first_half", F.lit(True))
    return m.join(top, "sample_id", "left").select("sample_id", F.coalesce("first_half", F.lit(False)).alias("first_half"))


@query("b14_head", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def _(spark, d):
    return L.head(read(spark, d, "documents").select("doc_id"), 100, "doc_id")


@query("b15_over", "SELECT doc_id, n_chars, round((SELECT count(*) FILTER (n_chars > 4000) * 100.0 / count(*) FROM documents), 6) AS share FROM documents WHERE n_chars > 4000 ORDER BY n_chars DESC, doc_id LIMIT 20")
def _(spark, d):
    return M.over_cutoff(read(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 4000, 20, "doc_id").withColumn("share", r6("share"))


@query("b16_dtd_entries", f"WITH {BOX_SQL} SELECT doc, count(*) AS n FROM bx WHERE f = 'R' AND item % 2 = 1 GROUP BY doc")
def _(spark, d):
    logs = I.boxes(spark, d).groupBy("doc").agg(F.collect_list(F.struct(F.when(F.col("f") == "R", "dtd").otherwise("ocr").alias("source"), (F.col("item") % 2 == 1).alias("kept"), F.array("x1", "y1", "x2", "y2").alias("box"))).alias("log"))
    kept = F.filter("log", lambda e: (e["source"] == "dtd") & e["kept"] & (F.size(e["box"]) == 4))
    return logs.select("doc", F.size(kept).cast("bigint").alias("n")).where("n > 0")


@query("b17_first_valid", f"WITH {META_SQL} SELECT sample_id, CASE WHEN doc_id % 3 = 0 THEN 'png' WHEN type IS NULL THEN 'no_label' WHEN n_chars < 500 THEN 'short' END AS reject_reason FROM meta")
def _(spark, d):
    rules = [("png", F.col("image_file").endswith(".png")), ("no_label", F.col("type").isNull()), ("short", F.col("n_chars") < 500)]
    return I.meta(spark, d).select("sample_id", L.reject_reason(rules).alias("reject_reason"))


@query("b18_random_split", f"WITH {META_SQL} SELECT sample_id, CASE WHEN row_number() OVER (ORDER BY {MD5.format('sample_id', 'sample_id')}) <= greatest(1, floor((SELECT count(*) FROM meta) * 0.02)) THEN 'eval' ELSE 'train' END AS split FROM meta")
def _(spark, d):
    return L.random_split(I.meta(spark, d).select("sample_id"), "sample_id")


# --- C: joins ---------------------------------------------------------------------------------------------------


@query("c01_pred_meta", "SELECT doc_id, d.n_chars AS n_chars, l.quality AS quality_pred FROM documents d JOIN labels l USING (doc_id)")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels").select("doc_id", F.col("quality").alias("quality_pred")), "doc_id")


@query("c02_match", "SELECT count(*) AS n_predictions, count(d.doc_id) AS n_matched FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id")
def _(spark, d):
    p = read(spark, d, "pages").select(F.col("page_id").alias("doc_id"))
    return p.join(read(spark, d, "documents").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left").agg(F.count(F.lit(1)).alias("n_predictions"), F.count("hit").alias("n_matched"))


@query("c03_prob_mask", "SELECT vec_id, coalesce(l.toxic, 0) AS tampered FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id")
def _(spark, d):
    masks = read(spark, d, "labels").select(F.regexp_replace(F.concat(F.col("doc_id").cast("string"), F.lit("_mask")), "_mask$", "").alias("stem"), "toxic")
    return read(spark, d, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("stem")).join(masks, "stem", "left").select("vec_id", F.coalesce("toxic", F.lit(0)).alias("tampered"))


@query("c04_prio_lookup", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('masks/', doc_id, '_mask.png') WHEN doc_id % 3 = 0 THEN concat('masks/', doc_id, '.png') END AS path FROM documents")
def _(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("stem"))
    names = docs.where("doc_id % 2 = 0").select(F.concat("stem", F.lit("_mask.png")).alias("name")).unionByName(docs.where("doc_id % 3 = 0").select(F.concat("stem", F.lit(".png")).alias("name")))
    hit = L.first_hit(docs, names.withColumn("path", F.concat(F.lit("masks/"), "name")), "doc_id", [F.concat("stem", F.lit("_mask.png")), F.concat("stem", F.lit(".png"))])
    return hit.select("doc_id", "path")


FRACTION = f"CASE WHEN {inter_sql('r.', 'w.')} > 0 THEN CAST({inter_sql('r.', 'w.')} AS DOUBLE) / greatest(1, (w.x2 - w.x1) * (w.y2 - w.y1)) ELSE 0.0 END"


@query("c05_region_ocr", f"WITH {BOX_SQL}, h AS (SELECT r.doc, r.item AS region, w.item AS id, {FRACTION} AS fr FROM bx r JOIN bx w ON r.doc = w.doc AND r.f = 'R' AND w.f = 'N') SELECT b.doc, b.item AS region, coalesce(n, 0) AS n_words, s AS ids FROM bx b LEFT JOIN (SELECT doc, region, count(*) AS n, string_agg(id, ',' ORDER BY fr DESC, id) AS s FROM h WHERE fr >= 0.4 GROUP BY 1, 2) g ON g.doc = b.doc AND g.region = b.item WHERE b.f = 'R'")
def _(spark, d):
    out = S.region_words(I.family(spark, d, "R", "region"), I.words(spark, d))
    return out.select("doc", "region", F.size("words").cast("bigint").alias("n_words"), F.when(F.size("words") > 0, F.array_join(F.transform("words", lambda w: w["id"].cast("string")), ",")).alias("ids"))


@query("c06_mask_hits", f"WITH {BOX_SQL} SELECT m.doc, m.item AS mask, string_agg(r.item, ',' ORDER BY r.item) AS hits FROM bx m LEFT JOIN bx r ON r.doc = m.doc AND r.f = 'R' AND {iou_sql('m.', 'r.')} > 0 WHERE m.f = 'A' GROUP BY 1, 2")
def _(spark, d):
    out = S.touching(I.family(spark, d, "A", "mask"), I.family(spark, d, "R", "region"), "region")
    return out.select("doc", "mask", F.when(F.size("hits") > 0, F.array_join(F.col("hits").cast("array<string>"), ",")).alias("hits"))


IOMIN = f"CASE WHEN {inter_sql('i.', 'c.')} > 0 THEN CAST({inter_sql('i.', 'c.')} AS DOUBLE) / least(greatest(1, (i.x2 - i.x1) * (i.y2 - i.y1)), greatest(1, (c.x2 - c.x1) * (c.y2 - c.y1))) ELSE 0.0 END"


@query("c07_tp_fp", f"WITH {BOX_SQL} SELECT i.doc, i.item AS region, EXISTS (SELECT 1 FROM bx c WHERE c.doc = i.doc AND c.f = 'A' AND {IOMIN} >= 0.05) AS tp FROM bx i WHERE i.f = 'R'")
def _(spark, d):
    return S.true_positives(I.family(spark, d, "R", "region"), I.family(spark, d, "A", "mask")).select("doc", "region", "tp")


@query("c08_refine", f"WITH {BOX_SQL}, m AS (SELECT i.doc, i.item, c.x1, c.y1, row_number() OVER (PARTITION BY i.doc, i.item ORDER BY {IOMIN} DESC, c.item) AS r FROM bx i JOIN bx c ON c.doc = i.doc AND i.f = 'R' AND c.f = 'A' WHERE {IOMIN} >= 0.1) SELECT b.doc, b.item, coalesce(m.x1, b.x1) AS x1, coalesce(m.y1, b.y1) AS y1, m.doc IS NOT NULL AS moved FROM bx b LEFT JOIN m ON m.doc = b.doc AND m.item = b.item AND r = 1 WHERE b.f = 'R'")
def _(spark, d):
    out = S.refine(I.family(spark, d, "R", "item"), I.family(spark, d, "A", "candidate"))
    return out.select("doc", "item", F.col("new.x1").alias("x1"), F.col("new.y1").alias("y1"), "moved")


PAIRS = f"""WITH {BOX_SQL}, k AS (SELECT i.doc, i.item, i.x1 AS ix1, i.y1 AS iy1, i.x2 AS ix2, i.y2 AS iy2, c.item AS cand, c.x1, c.y1, c.x2, c.y2, {iou_sql('i.', 'c.')} AS s FROM bx i JOIN bx c ON i.doc = c.doc AND i.f = 'A' AND c.f = '{{f}}' WHERE {iou_sql('i.', 'c.')} > 0.1),
 u AS (SELECT a.doc, a.item, a.ix1, a.iy1, a.ix2, a.iy2, least(a.x1, b.x1) AS ux1, least(a.y1, b.y1) AS uy1, greatest(a.x2, b.x2) AS ux2, greatest(a.y2, b.y2) AS uy2, a.cand AS p, b.cand AS q FROM k a JOIN k b ON a.doc = b.doc AND a.item = b.item AND a.cand < b.cand),
 al AS (SELECT doc, item, x1, y1, x2, y2, s, 1 AS n, cand AS p, 0 AS q FROM k UNION ALL SELECT doc, item, ux1, uy1, ux2, uy2, {iou_sql('i', 'u')}, 2, p, q FROM u)
 SELECT doc, item, x1, y1, x2, y2, round(s, 6) AS score, CAST(n AS INTEGER) AS n_parts FROM (SELECT *, row_number() OVER (PARTITION BY doc, item ORDER BY s DESC, n, p, q) AS r FROM al) WHERE r = 1"""


def _best(spark, d, f):
    out = S.best_single_or_pair(I.family(spark, d, "A", "item"), I.family(spark, d, f, "candidate"), 0.1)
    return out.select("doc", "item", "box.*", r6("score").alias("score"), F.size("parts").alias("n_parts"))


@query("c09_best_ocr", PAIRS.format(f="N"))
def _(spark, d):
    return _best(spark, d, "N")


@query("c10_best_dtd", PAIRS.format(f="R"))
def _(spark, d):
    return _best(spark, d, "R")


def _sources(spark, d):
    items = I.family(spark, d, "A", "item")
    best = lambda f: S.best_single_or_pair(items, I.family(spark, d, f, "candidate"), 0.1).select("doc", "item", F.col("box").alias(f"box_{f}"))
    return items.join(best("N"), ["doc", "item"], "left").join(best("R"), ["doc", "item"], "left").withColumn("own", F.struct(*Box.of().named()))


BEST_BOTH = f"{PAIRS.format(f='N')}"


@query("c11_r2")
def _(spark, d):
    return _sources(spark, d).select("doc", "item", F.coalesce("box_N", "own").alias("b"), F.col("box_N").isNotNull().alias("replaced")).select("doc", "item", "b.*", "replaced")


@query("c12_r3")
def _(spark, d):
    src = F.when(F.col("box_R").isNotNull(), "dtd").when(F.col("box_N").isNotNull(), "ocr").otherwise("original")
    return _sources(spark, d).select("doc", "item", F.coalesce("box_R", "box_N", "own").alias("b"), src.alias("source")).select("doc", "item", "b.*", "source")


def _only(spark, d, *names):
    kept = _sources(spark, d).select("doc", "item", F.coalesce(*[F.col(n) for n in names]).alias("b")).where("b IS NOT NULL")
    return K.numbered(kept, ["doc"], "item").select("doc", "item", F.lpad(F.col("number").cast("string"), 3, "0").alias("number"), "b.*")


@query("c13_r4")
def _(spark, d):
    return _only(spark, d, "box_R")


@query("c13_ocr_only")
def _(spark, d):
    return _only(spark, d, "box_N")


@query("c13_ocr_dtd_only")
def _(spark, d):
    return _only(spark, d, "box_R", "box_N")


@query("c14_viz_match", f"WITH {BOX_SQL} SELECT doc, item, candidate, round(s, 6) AS score FROM (SELECT i.doc, i.item, c.item AS candidate, {iou_sql('i.', 'c.')} AS s, row_number() OVER (PARTITION BY i.doc, i.item ORDER BY {iou_sql('i.', 'c.')} DESC, c.item) AS r FROM bx i JOIN bx c ON i.doc = c.doc AND i.f = 'R' AND c.f = 'A') WHERE r = 1 AND s > 0")
def _(spark, d):
    return S.best_match(I.family(spark, d, "R", "item"), I.family(spark, d, "A", "candidate"), G.iou_clamped, 0, strict=True).select("doc", "item", F.col("best.candidate").alias("candidate"), r6("score").alias("score"))


@query("c15_asof_header", "SELECT user_id, k AS at, (SELECT CAST(arg_max(h.event_id, h.event_id) AS VARCHAR) FROM events h WHERE h.user_id = m.user_id AND h.event_type = 'view' AND h.event_id < m.event_id AND h.event_id >= m.event_id - 2000) AS index FROM (SELECT user_id, event_id, event_id AS k FROM events WHERE event_type = 'purchase') m")
def _(spark, d):
    e = read(spark, d, "events").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("index"), "event_type")
    return L.asof_headers("user_id", e.where("event_type = 'purchase'"), e.where("event_type = 'view'"))


@query("c16_teacher_coords", f"WITH {BOX_SQL}, t AS (SELECT doc, item, x1 FROM (SELECT doc, item % 5 AS item, x1, row_number() OVER (PARTITION BY doc, item % 5 ORDER BY item DESC) AS r FROM bx WHERE f = 'N') WHERE r = 1) SELECT b.doc, b.item, coalesce(t.x1, b.x1) AS x1 FROM bx b LEFT JOIN t ON t.doc = b.doc AND t.item = b.item WHERE b.f = 'A'")
def _(spark, d):
    last = I.family(spark, d, "N", "item").groupBy("doc", (F.col("item") % 5).alias("item")).agg(F.max_by("x1", "item").alias("tx"))
    return I.family(spark, d, "A", "item").join(last, ["doc", "item"], "left").select("doc", "item", F.coalesce("tx", "x1").alias("x1"))


@query("c17_prompt_fallback", "SELECT d.doc_id, coalesce(b.item_id, l.doc_id) AS prompt FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(spark, d):
    one = read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("item_id").alias("a"))
    two = read(spark, d, "labels").select("doc_id", F.col("doc_id").alias("b"))
    return read(spark, d, "documents").select("doc_id").join(one, "doc_id", "left").join(two, "doc_id", "left").select("doc_id", F.coalesce("a", "b").alias("prompt"))


# --- D: aggregates ----------------------------------------------------------------------------------------------


@query("d01_by_type", f"WITH {META_SQL} SELECT type, count(*) AS n FROM meta GROUP BY 1")
def _(spark, d):
    return M.counts(I.meta(spark, d), "type")


@query("d01_by_language", f"WITH {META_SQL} SELECT language_code, count(*) AS n FROM meta GROUP BY 1")
def _(spark, d):
    return M.counts(I.meta(spark, d), "language_code")


CROSS = f"WITH {META_SQL} SELECT language_code, count(*) FILTER (type = 'black') AS black, count(*) FILTER (type = 'white') AS white FROM meta WHERE type IS NOT NULL GROUP BY 1"


@query("d02_crosstab", CROSS)
def _(spark, d):
    return M.crosstab(I.meta(spark, d), "language_code", "type", ["black", "white"])


@query("d03_totals", f"WITH {META_SQL} SELECT count(*) AS n, count(*) FILTER (has_mask) AS n_masks FROM meta")
def _(spark, d):
    return I.meta(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if("has_mask").alias("n_masks"))


SPLIT = f"""{META_SQL}, sz AS (SELECT concat_ws('|', coalesce(language_code, 'None'), coalesce(type, 'None')) AS j, count(*) AS n FROM meta GROUP BY 1 HAVING count(*) >= 4),
 tot AS (SELECT ceil(sum(n) * 0.1) AS t, sum(n) AS s FROM sz), sh AS (SELECT j, n * CAST(t AS DOUBLE) / CAST(s AS DOUBLE) AS q FROM sz, tot),
 qu AS (SELECT j, floor(q) + CASE WHEN row_number() OVER (ORDER BY q - floor(q) DESC, j) <= (SELECT t FROM tot) - (SELECT sum(floor(q)) FROM sh) THEN 1 ELSE 0 END AS quota FROM sh),
 sp AS (SELECT m.sample_id, m.language_code, m.type, CASE WHEN row_number() OVER (PARTITION BY concat_ws('|', coalesce(language_code, 'None'), coalesce(type, 'None')) ORDER BY {MD5.format('sample_id', 'sample_id')}) <= quota THEN 'val' ELSE 'train' END AS split
  FROM meta m LEFT JOIN qu ON qu.j = concat_ws('|', coalesce(language_code, 'None'), coalesce(type, 'None')))"""


@query("e08_strat_split", f"WITH {SPLIT} SELECT sample_id, split FROM sp")
def _(spark, d):
    return L.stratified_split(I.meta(spark, d), "sample_id", ["language_code", "type"]).select("sample_id", "split")


@query("d04_split_report", f"WITH {SPLIT} SELECT split, language_code, count(*) FILTER (type = 'black') AS black, count(*) FILTER (type = 'white') AS white FROM sp GROUP BY 1, 2")
def _(spark, d):
    s = L.stratified_split(I.meta(spark, d), "sample_id", ["language_code", "type"])
    return s.groupBy("split", "language_code").agg(F.count_if(F.col("type") == "black").alias("black"), F.count_if(F.col("type") == "white").alias("white"))


def _verdicts(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang", "n_chars").join(read(spark, d, "labels"), "doc_id")
    return docs.select("doc_id", "lang", F.when(F.col("quality") == 0, "FORGED").otherwise("PRISTINE").alias("truth"), F.when(F.col("n_chars") > 2500, "forgery").otherwise("real").alias("predicted"))


DETECT = "SELECT lang, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(same / n, 6) AS accuracy, n FROM (SELECT lang, count(*) FILTER (t AND p) * 1.0::DOUBLE AS tp, count(*) FILTER (NOT t AND p) * 1.0::DOUBLE AS fp, count(*) FILTER (t AND NOT p) * 1.0::DOUBLE AS fn, count(*) FILTER (t = p) * 1.0::DOUBLE AS same, count(*) AS n FROM (SELECT lang, quality = 0 AS t, n_chars > 2500 AS p FROM documents JOIN labels USING (doc_id)) GROUP BY 1)"


@query("d05_detection", DETECT)
def _(spark, d):
    out = M.detection_scores(_verdicts(spark, d), "truth", "predicted", ("lang",))
    return out.select("lang", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "accuracy")], "n")


CELLS = f"""{BOX_SQL}, bb AS (SELECT doc, x1, y1, x2, y2, f FROM bx WHERE f IN ('A', 'R')), xs AS (SELECT doc, x, lead(x) OVER (PARTITION BY doc ORDER BY x) AS xe FROM (SELECT DISTINCT doc, unnest([x1, x2]) AS x FROM bb)),
 ys AS (SELECT doc, y, lead(y) OVER (PARTITION BY doc ORDER BY y) AS ye FROM (SELECT DISTINCT doc, unnest([y1, y2]) AS y FROM bb)),
 ce AS (SELECT b.doc, x, xe, y, ye, bool_or(f = 'A') AS a, bool_or(f = 'R') AS r FROM bb b JOIN xs ON xs.doc = b.doc AND x1 <= x AND x2 >= xe JOIN ys ON ys.doc = b.doc AND y1 <= y AND y2 >= ye GROUP BY 1, 2, 3, 4, 5),
 px AS (SELECT doc, CAST(sum(CASE WHEN a AND r THEN (xe - x) * (ye - y) ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN NOT a AND r THEN (xe - x) * (ye - y) ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN a AND NOT r THEN (xe - x) * (ye - y) ELSE 0 END) AS BIGINT) AS fn FROM ce GROUP BY 1)"""


def _pixels(spark, d):
    return S.pixel_counts(I.family(spark, d, "A", "i"), I.family(spark, d, "R", "i"))


@query("g17_pixel_metrics", f"WITH {CELLS} SELECT doc, tp, fp, fn, round(tp / CAST(tp + fp + fn AS DOUBLE), 6) AS iou, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1, round(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / CAST(tp + fn AS DOUBLE) END, 6) AS iou_no_fp, round(CASE WHEN tp + fn = 0 THEN 1 ELSE 2 * tp / CAST(2 * tp + fn AS DOUBLE) END, 6) AS f1_no_fp FROM px")
def _(spark, d):
    m = M.pixel_metrics(F.col("tp"), F.col("fp"), F.col("fn"))
    return _pixels(spark, d).select("doc", "tp", "fp", "fn", *[r6(c).alias(n) for n, c in m.items()])


@query("g07_boxes_to_mask", f"WITH {CELLS} SELECT doc, tp + fn AS n_mask FROM px WHERE tp + fn > 0")
def _(spark, d):
    a = I.family(spark, d, "A", "i")
    clipped = a.select("doc", *G.clip_box(Box.of(), F.lit(1000), F.lit(1000)).named())
    return S.pixel_counts(clipped, clipped).select("doc", F.col("tp").alias("n_mask"))


GROUND = f"WITH {CELLS}, s AS (SELECT doc, tp / CAST(tp + fp + fn AS DOUBLE) AS iou, 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) AS f1, tp + fn > 0 AS forged FROM px) SELECT round(avg(iou), 6) AS miou, round(avg(f1), 6) AS mf1, round(coalesce(avg(iou) FILTER (forged), 0), 6) AS miou_forged, round(coalesce(avg(f1) FILTER (forged), 0), 6) AS mf1_forged, count(*) AS n, count(*) FILTER (forged) AS n_forged FROM s"


def _graded(spark, d):
    m = M.pixel_metrics(F.col("tp"), F.col("fp"), F.col("fn"))
    return _pixels(spark, d).select("doc", m["iou"].alias("iou"), m["f1"].alias("f1"), (F.col("tp") + F.col("fn") > 0).alias("forged"))


@query("d06_grounding", GROUND)
def _(spark, d):
    out = M.grounding_scores(_graded(spark, d), F.col("forged"))
    return out.select(*[r6(c).alias(c) for c in ("miou", "mf1", "miou_forged", "mf1_forged")], "n", "n_forged")


def _rubric(spark, d):
    return read(spark, d, "part").select((F.col("p_size") * 2.0).alias("factuality"), (F.col("p_partkey") % 101).cast("double").alias("reasoning"), (F.col("p_partkey") % 89).cast("double").alias("completeness"))


RUBRIC = "SELECT round(avg(p_size * 2.0) / 100, 6) AS factuality, round(avg(p_partkey % 101) / 100, 6) AS reasoning, round(avg(p_partkey % 89) / 100, 6) AS completeness, round(avg((p_size * 2.0 + p_partkey % 101 + p_partkey % 89) / 3) / 100, 6) AS average_norm FROM part"


@query("d07_rubric", RUBRIC)
def _(spark, d):
    out = M.rubric_scores(_rubric(spark, d))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("d08_final", "SELECT p_partkey, round((0.25 * p_size / 50.0 + 0.25 * (p_partkey % 7) / 7.0 + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 0.25 * (p_partkey % 11) / 11.0 END) / CASE WHEN p_partkey % 3 = 0 THEN 0.5 ELSE 0.75 END, 6) AS even, round((0.3 * p_size / 50.0 + 0.4 * (p_partkey % 7) / 7.0 + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 0.15 * (p_partkey % 11) / 11.0 END) / CASE WHEN p_partkey % 3 = 0 THEN 0.7 ELSE 0.85 END, 6) AS command_line FROM part")
def _(spark, d):
    k = F.col("p_partkey")
    parts = {"detection": F.col("p_size") / 50.0, "grounding": M.grounding_part((k % 7) / 7.0, (k % 7) / 7.0), "explanation": F.when(k % 3 != 0, (k % 11) / 11.0), "rubric": F.lit(None).cast("double")}
    return read(spark, d, "part").select("p_partkey", r6(M.final_score(parts, M.EVEN)).alias("even"), r6(M.final_score(parts, M.COMMAND_LINE)).alias("command_line"))


THRESHOLDS = (0.0, 0.05, 0.1, 0.15, 0.2)
SWEEP = """WITH c AS (SELECT e.vec_id, t.k, t.v AS threshold, u.x >= t.v AS p, (coalesce(l.toxic, 0) = 1 AND u.i <= 24) AS g FROM embeddings e CROSS JOIN (SELECT unnest(range(5)) AS k, unnest([0.0, 0.05, 0.1, 0.15, 0.2]) AS v) t LEFT JOIN labels l ON l.doc_id = e.vec_id, LATERAL (SELECT unnest(embedding) AS x, unnest(range(1, 65)) AS i) u),
 px AS (SELECT vec_id, threshold, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM c GROUP BY 1, 2),
 m AS (SELECT threshold, CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE tp / CAST(tp + fp + fn AS DOUBLE) END AS iou, CASE WHEN tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1, tp, fp, fn FROM px)"""


def _sweep(spark, d):
    """Counts per map and threshold inside the row; maps are never multiplied by thresholds."""
    m = I.maps(spark, d).join(read(spark, d, "labels").select(F.col("doc_id").alias("doc"), "toxic"), "doc", "left")
    truth = lambda i: (F.coalesce(F.col("toxic"), F.lit(0)) == 1) & (i < 24)

    def n(data, t, test):
        return F.size(F.filter(data, lambda x, i: test(x.cast("double") >= t, truth(i)))).cast("bigint")

    per = F.array(*[F.struct(F.lit(t).alias("threshold"), n(F.col("data"), t, lambda p, g: p & g).alias("tp"), n(F.col("data"), t, lambda p, g: p & ~g).alias("fp"), n(F.col("data"), t, lambda p, g: ~p & g).alias("fn")) for t in THRESHOLDS])
    rows = m.select(F.explode(per).alias("c")).select("c.*")
    x = M.pixel_metrics(F.col("tp"), F.col("fp"), F.col("fn"), empty_f1=0.0)
    return rows.select("threshold", "tp", "fp", "fn", x["iou"].alias("iou"), x["f1"].alias("f1"))


@query("d10_sweep", SWEEP + " SELECT CAST(threshold AS DOUBLE) AS threshold, round(avg(iou), 6) AS miou, round(avg(f1), 6) AS mf1, round(0.5 * (avg(iou) + avg(f1)), 6) AS fs, count(*) AS n FROM m GROUP BY 1")
def _(spark, d):
    return _sweep(spark, d).groupBy("threshold").agg(r6(F.avg("iou")).alias("miou"), r6(F.avg("f1")).alias("mf1"), r6(0.5 * (F.avg("iou") + F.avg("f1"))).alias("fs"), F.count(F.lit(1)).alias("n"))


@query("d11_best_thr", SWEEP + " , s AS (SELECT threshold, round(avg(iou), 6) AS miou, round(avg(f1), 6) AS mf1 FROM m GROUP BY 1) SELECT 'miou' AS metric, CAST((SELECT threshold FROM s ORDER BY miou DESC, threshold LIMIT 1) AS DOUBLE) AS threshold UNION ALL SELECT 'mf1', CAST((SELECT threshold FROM s ORDER BY mf1 DESC, threshold LIMIT 1) AS DOUBLE)")
def _(spark, d):
    s = _sweep(spark, d).groupBy("threshold").agg(r6(F.avg("iou")).alias("miou"), r6(F.avg("f1")).alias("mf1"))
    long = s.select("threshold", F.explode(F.map_from_arrays(F.array(F.lit("miou"), F.lit("mf1")), F.array("miou", "mf1"))).alias("metric", "value"))
    return long.groupBy("metric").agg(F.max_by("threshold", F.struct("value", -F.col("threshold"))).alias("threshold"))


@query("d12_pixel_totals", SWEEP + " SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(avg(tp), 6) AS mean_tp FROM m GROUP BY 1")
def _(spark, d):
    return _sweep(spark, d).groupBy("threshold").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), r6(F.avg("tp")).alias("mean_tp"))


@query("d13_stage1_summary", "SELECT round(avg(quality), 6) AS before, round(avg(1 - toxic), 6) AS after, round(avg(1 - toxic) - avg(quality), 6) AS gain FROM labels")
def _(spark, d):
    a, b = F.avg("quality"), F.avg(1 - F.col("toxic"))
    return read(spark, d, "labels").agg(r6(a).alias("before"), r6(b).alias("after"), r6(b - a).alias("gain"))


def _val(name, column, sql):
    @query(name, f"WITH {CELLS} SELECT count(*) AS n, count(*) FILTER (tp + fn > 0) AS n_masked, round(avg(tp / CAST(tp + fp + fn AS DOUBLE)) FILTER (tp + fn > 0), 6) AS miou, round(avg(CASE WHEN {sql} = (tp + fn > 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM px")
    def _(spark, d):
        x = M.pixel_metrics(F.col("tp"), F.col("fp"), F.col("fn"))["iou"]
        masked = F.col("tp") + F.col("fn") > 0
        return _pixels(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(masked).alias("n_masked"), r6(F.avg(F.when(masked, x))).alias("miou"), r6(F.avg((column() == masked).cast("double"))).alias("accuracy"))


_val("d14_val_eval", lambda: F.col("tp") + F.col("fp") > 300, "(tp + fp > 300)")
_val("d15_stage1_val", lambda: F.col("tp") + F.col("fp") > 0, "(tp + fp > 0)")


@query("d16_text_stats", "SELECT lang, CAST(sum(n_chars) AS BIGINT) AS total, round(avg(n_chars), 6) AS mean, median(n_chars) AS median, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY 1")
def _(spark, d):
    return M.text_stats(read(spark, d, "documents"), F.col("n_chars"), ("lang",)).withColumn("mean", r6("mean"))


@query("d17_percentiles", "WITH s AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT CAST(p AS DOUBLE) AS percent, n_chars AS value FROM s JOIN (SELECT unnest([5.0, 25.0, 50.0, 90.0, 99.0, 100.0]) AS p) ON i = CASE WHEN p >= 100 THEN n - 1 ELSE CAST(round_even(CAST(p AS DOUBLE) / 100 * (n - 1), 0) AS BIGINT) END")
def _(spark, d):
    return M.nearest_ranks(read(spark, d, "documents"), "n_chars", [5, 25, 50, 90, 99, 100])


@query("d18_histogram", "WITH e AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents), w AS (SELECT lo, greatest(1, (hi - lo + 11) // 12) AS w FROM e), c AS (SELECT least(11, (n_chars - lo) // w) AS b, count(*) AS n FROM documents, w GROUP BY 1) SELECT CAST(b.i AS INTEGER) AS bin, lo + b.i * w AS low, lo + b.i * w + w - 1 AS high, coalesce(n, 0) AS n, CAST(floor(coalesce(n, 0) * 50 / (SELECT max(n) FROM c)) AS INTEGER) AS bar FROM (SELECT unnest(range(12)) AS i) b CROSS JOIN w LEFT JOIN c ON c.b = b.i")
def _(spark, d):
    return M.histogram(read(spark, d, "documents"), "n_chars")


@query("d19_status", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return M.counts(read(spark, d, "events").withColumnRenamed("event_type", "status"), "status")


@query("d20_conf_weighted", "SELECT user_id, round(coalesce(sum(value * greatest(1, length(event_type))) / nullif(sum(greatest(1, length(event_type))), 0), 0), 6) AS confidence FROM events GROUP BY 1")
def _(spark, d):
    w = F.greatest(F.lit(1), F.length("event_type"))
    return read(spark, d, "events").groupBy("user_id").agg(r6(F.coalesce(F.try_divide(F.sum(F.col("value") * w), F.sum(w)), F.lit(0.0))).alias("confidence"))


@query("d21_lang_pick", "SELECT user_id, coalesce(min_by(event_type, event_type) FILTER (s >= 40), arg_max(event_type, row(s, n, event_type))) AS pick FROM (SELECT user_id, event_type, max(value) AS s, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    each = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("s"), F.count(F.lit(1)).alias("n"))
    return each.groupBy("user_id").agg(F.coalesce(F.min(F.when(F.col("s") >= 40, F.col("event_type"))), F.max_by("event_type", F.struct("s", "n", "event_type"))).alias("pick"))


@query("d22_explanation", "SELECT round(avg(m), 6) AS mean FROM (SELECT user_id, avg(value) AS m FROM events GROUP BY 1)")
def _(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("m")).agg(r6(F.avg("m")).alias("mean"))


@query("d23_skip_counts", f"WITH {META_SQL} SELECT CASE WHEN doc_id % 3 = 0 THEN 'png' WHEN type IS NULL THEN 'no_label' ELSE 'ok' END AS reason, count(*) AS n FROM meta GROUP BY 1")
def _(spark, d):
    rules = [("png", F.col("image_file").endswith(".png")), ("no_label", F.col("type").isNull())]
    return I.meta(spark, d).groupBy(F.coalesce(L.reject_reason(rules), F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("d24_step_rollup", "SELECT count(*) FILTER (value > 50) AS truncated, max(value) AS longest, round(avg(value), 6) AS mean FROM events")
def _(spark, d):
    return read(spark, d, "events").agg(F.count_if(F.col("value") > 50).alias("truncated"), F.max("value").alias("longest"), r6(F.avg("value")).alias("mean"))


@query("d25_has_replaced", f"WITH {BOX_SQL} SELECT doc, count(*) FILTER (f = 'R' AND item > 1) AS refined FROM bx GROUP BY 1")
def _(spark, d):
    logs = I.boxes(spark, d).groupBy("doc").agg(F.collect_list(F.struct(F.when((F.col("f") == "R") & (F.col("item") > 1), F.col("x1")).alias("replaced_with"))).alias("log"))
    return logs.select("doc", F.size(F.filter("log", lambda e: e["replaced_with"].isNotNull())).cast("bigint").alias("refined"))


@query("d26_mask_nonzero", "SELECT vec_id AS doc, list_max(embedding) > 0.35 AS tampered FROM embeddings")
def _(spark, d):
    return I.maps(spark, d).select("doc", F.exists("data", lambda x: x.cast("double") > 0.35).alias("tampered"))


@query("d27_running_avg", "SELECT user_id, event_id, round(m, 6) AS mean_so_far FROM (SELECT user_id, event_id, row_number() OVER w AS r, avg(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE r % 10 = 0")
def _(spark, d):
    return K.running_mean(read(spark, d, "events"), "value", 10, "event_id", by=("user_id",)).select("user_id", "event_id", r6("mean_so_far").alias("mean_so_far"))


# --- E: ranking -------------------------------------------------------------------------------------------------


@query("e01_number_regions", f"WITH {BOX_SQL} SELECT doc, item, CAST(row_number() OVER (PARTITION BY doc ORDER BY y1, x1, item) AS INTEGER) AS number FROM bx WHERE f = 'R'")
def _(spark, d):
    return K.numbered(I.family(spark, d, "R", "item"), ["doc"], "y1", "x1", "item").select("doc", "item", "number")


@query("e02_topk_overlap", f"WITH {BOX_SQL}, h AS (SELECT r.doc, r.item AS region, w.item AS id, {FRACTION} AS fr FROM bx r JOIN bx w ON r.doc = w.doc AND r.f = 'R' AND w.f = 'N') SELECT doc, region, id FROM (SELECT *, row_number() OVER (PARTITION BY doc, region ORDER BY fr DESC, id) AS k FROM h WHERE fr >= 0.1) WHERE k <= 6")
def _(spark, d):
    out = S.region_words(I.family(spark, d, "R", "region"), I.words(spark, d), 0.1, 6)
    return out.select("doc", "region", F.explode("words").alias("w")).select("doc", "region", "w.id")


@query("e03_renumber", f"WITH {BOX_SQL} SELECT doc, item, lpad(CAST(row_number() OVER (PARTITION BY doc ORDER BY item) AS VARCHAR), 3, '0') AS number FROM bx WHERE f = 'R' AND x1 % 2 = 0")
def _(spark, d):
    return K.numbered(I.family(spark, d, "R", "item").where("x1 % 2 = 0"), ["doc"], "item").select("doc", "item", F.lpad(F.col("number").cast("string"), 3, "0").alias("number"))


@query("e04_ocr_ids", "SELECT conv_id, turn, CAST(i AS INTEGER) AS id, w FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations)")
def _(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ", -1)).alias("p", "w")).select("conv_id", "turn", (F.col("p") + 1).alias("id"), "w")


@query("e05_blocks", f"WITH {BOX_SQL} SELECT doc, count(*) AS n_blocks FROM bx WHERE f = 'R' GROUP BY 1")
def _(spark, d):
    return I.reports(spark, d).select("doc", F.size(R.blocks(F.col("text"))).cast("bigint").alias("n_blocks"))


@query("e06_lines")
def _(spark, d):
    return raster.order_words(I.words(spark, d))


@query("e07_shard", "SELECT lang, doc_id, CAST(ntile(4) OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS INTEGER) AS shard FROM documents")
def _(spark, d):
    return K.shards(read(spark, d, "documents").select("lang", "doc_id"), 4, ["lang"], "doc_id")


@query("e09_last_anchor", "SELECT conv_id, turn, concat('# FORGERY ANALYSIS REPORT two ', turn) AS report FROM conversations")
def _(spark, d):
    two = F.concat(F.lit("x # FORGERY ANALYSIS REPORT one "), "text", F.lit(" # FORGERY ANALYSIS REPORT two "), F.col("turn").cast("string"))
    return read(spark, d, "conversations").select("conv_id", "turn", T.clean_report(two).alias("report"))


@query("e10_gap", "WITH g AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT user_id, event_id - b - 1 AS gap, (b + 1 + event_id) // 2 AS split FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id - b DESC, event_id) AS r FROM g WHERE event_id - b > 1) WHERE r = 1")
def _(spark, d):
    return K.widest_gap(read(spark, d, "events"), ["user_id"], "event_id")


@query("e11_runs", "SELECT user_id, min(i) AS begin, max(i) + 1 AS end, count(*) AS length FROM (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) WHERE event_type IN ('view', 'click')) GROUP BY user_id, k")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    placed = read(spark, d, "events").withColumn("i", F.row_number().over(w).cast("bigint"))
    return K.runs(placed, ["user_id"], "i", F.col("event_type").isin("view", "click"))


@query("e12_gap_cut")
def _(spark, d):
    return K.separator_gaps(I.family(spark, d, "N", "item").select("doc", "item", "x1", "x2"), ["doc"], "x1", "x2", 2)


@query("e13_dedupe_boxes", f"WITH {BOX_SQL} SELECT doc, count(DISTINCT (x1 % 9, y1 % 9)) AS n FROM bx GROUP BY 1")
def _(spark, d):
    return I.boxes(spark, d).groupBy("doc").agg(F.collect_list(F.array(F.col("x1") % 9, F.col("y1") % 9)).alias("b")).select("doc", F.size(F.array_distinct("b")).cast("bigint").alias("n"))


@query("e14_latest_ckpt", "SELECT concat('out/checkpoint-', max(doc_id)) AS path FROM documents")
def _(spark, d):
    return K.latest_checkpoint(read(spark, d, "documents").select(F.concat(F.lit("out/checkpoint-"), F.col("doc_id").cast("string")).alias("path")))


# --- F: sets ----------------------------------------------------------------------------------------------------


@query("f01_parts", "SELECT DISTINCT source FROM documents WHERE lang = 'en' INTERSECT SELECT DISTINCT source FROM documents WHERE lang = 'de'")
def _(spark, d):
    docs = read(spark, d, "documents")
    return docs.where("lang = 'en'").select("source").intersect(docs.where("lang = 'de'").select("source"))


@query("f02_union", f"WITH {META_SQL} SELECT sample_id, type FROM meta WHERE type IN ('black', 'white')")
def _(spark, d):
    m = I.meta(spark, d).select("sample_id", "type")
    return m.where("type = 'black'").unionByName(m.where("type = 'white'"))


@query("f03_diff", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id").exceptAll(read(spark, d, "labels").select("doc_id"))


@query("f04_distinct", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events GROUP BY 1")
def _(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))
