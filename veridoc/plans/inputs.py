"""Inputs that the queries derive from the driver's tables, for Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

BOX_SQL = """bx AS (SELECT l_orderkey // 4 AS doc, l_returnflag AS f,
  CAST(row_number() OVER (PARTITION BY l_orderkey // 4, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS item,
  CAST(l_partkey % 97 AS INTEGER) AS x1, CAST(l_suppkey % 89 AS INTEGER) AS y1, CAST(l_partkey % 97 + 5 + CAST(l_quantity AS INTEGER) % 23 AS INTEGER) AS x2, CAST(l_suppkey % 89 + 5 + 4 * l_linenumber AS INTEGER) AS y2 FROM lineitem)"""
META_SQL = """meta AS (SELECT CAST(d.doc_id AS VARCHAR) AS sample_id, lang AS language_code, source, CASE toxic WHEN 1 THEN 'black' WHEN 0 THEN 'white' END AS type, toxic = 1 AS has_mask,
  concat(d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN '.png' ELSE '.jpg' END) AS image_file, n_chars, d.doc_id, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))"""


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def boxes(spark: SparkSession, d: str, family: str | None = None) -> DataFrame:
    """doc, f, item, x1, y1, x2, y2: families R (detector regions), N (words), A (mask regions) of four orders a document."""
    rows = read(spark, d, "lineitem")
    rows = rows.where(F.col("l_returnflag") == family) if family else rows
    doc = F.expr("l_orderkey div 4")
    n = F.row_number().over(Window.partitionBy(doc, "l_returnflag").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    x, y = (F.col("l_partkey") % 97).cast("int"), (F.col("l_suppkey") % 89).cast("int")
    return rows.select(doc.alias("doc"), F.col("l_returnflag").alias("f"), n.alias("item"), x.alias("x1"), y.alias("y1"), (x + 5 + F.col("l_quantity").cast("int") % 23).alias("x2"), (y + 5 + 4 * F.col("l_linenumber")).alias("y2"))


def family(spark: SparkSession, d: str, f: str, key: str) -> DataFrame:
    return boxes(spark, d, f).select("doc", F.col("item").alias(key), "x1", "y1", "x2", "y2")


def words(spark: SparkSession, d: str) -> DataFrame:
    return family(spark, d, "N", "id").withColumn("text", F.concat(F.lit("w"), F.col("x1").cast("string")))


def meta(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(read(spark, d, "labels"), "doc_id", "left")
    kind = F.when(F.col("toxic") == 1, "black").when(F.col("toxic") == 0, "white")
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".png").otherwise(".jpg"))
    return docs.select(F.col("doc_id").cast("string").alias("sample_id"), F.col("lang").alias("language_code"), "source", kind.alias("type"), (F.col("toxic") == 1).alias("has_mask"), name.alias("image_file"), "n_chars", "doc_id", "quality", "toxic")


def maps(spark: SparkSession, d: str) -> DataFrame:
    """8 x 8 maps from embeddings."""
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").alias("data"))


def map_pairs(spark: SparkSession, d: str) -> DataFrame:
    """doc, h, w, data, mask_h, mask_w, mask: 16 embeddings make a map 32 wide; its mask is one box, none for every seventh."""
    m = read(spark, d, "embeddings").groupBy(F.expr("vec_id div 16").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("parts"))
    m = m.select("doc", (F.size("parts") * 2).alias("h"), F.lit(32).alias("w"), F.flatten("parts.embedding").alias("data"))
    x, y, left, top = (lambda i: i % 32), (lambda i: F.floor(i / 32)), F.col("doc") % 8, F.col("doc") % 5
    inside = lambda i: ((x(i) >= left) & (x(i) < left + 12) & (y(i) >= top) & (y(i) < top + 9)).cast("int")
    return m.withColumns({"mask_h": F.col("h"), "mask_w": F.col("w"), "mask": F.when(F.col("doc") % 7 != 0, F.transform(F.sequence(F.lit(0), F.size("data") - 1), inside))})


def reports(spark: SparkSession, d: str) -> DataFrame:
    """doc, text: reports written from orders and their lines, so that every field is known beforehand."""
    lines = boxes(spark, d, "R").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("item", "x1", "y1", "x2", "y2"))).alias("lines"))
    one = lambda r: F.concat(F.lit("### ANOMALY_"), F.lpad(r["item"].cast("string"), 3, "0"), F.lit(": Visual Clumsy (row "), r["y1"].cast("string"), F.lit(")\n[GROUNDING]: ["), F.concat_ws(", ", *[r[c].cast("string") for c in ("x1", "y1", "x2", "y2")]), F.lit("]\n[FORGED_CONTENT]: total "), r["x1"].cast("string"), F.lit("\n[REASON]: strokes differ\nat "), r["x2"].cast("string"), F.lit("\n\n"))
    verdict = F.when(F.col("doc") % 2 == 0, "FORGED").otherwise("AUTHENTIC")
    text = F.concat(F.lit("# FORGERY ANALYSIS REPORT\n\n**[Conclusion]:** "), verdict, F.lit("\n**[RISK_SCORE]:** "), (F.col("doc") % 101).cast("string"), F.lit("\n\n"), F.array_join(F.transform("lines", one), ""), F.lit("## SUMMARY\nseen "), F.size("lines").cast("string"), F.lit(" times\n"))
    return lines.select("doc", text.alias("text"))


def traces(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, raw: model outputs wrapped around whole conversation turns."""
    said = F.regexp_replace("text", r"[^A-Za-z ]", "")
    n = F.col("turn").cast("string")
    think = F.concat(F.lit("--- STAGE 1: Knowledge Preparation ---\n"), said, F.lit("\n--- STAGE 2: Filter ---\nREGION_001 [1, 2, "), n, F.lit(", 9]: soft edge. → KEEP as Visual Clumsy.\nREGION_002 [3, 3, 5, 5]: noise. → DROP.\n--- STAGE 3: Semantics ---\nnone\n--- STAGE 4: Verdict ---\ndone"))
    raw = F.concat(F.lit("```markdown\n<think>"), think, F.lit("</think>\n<report># FORGERY ANALYSIS REPORT\nbody "), n, F.lit("\n**END OF REPORT**\ntail</report>\n```"))
    return read(spark, d, "conversations").select("conv_id", "turn", "role", "text", said.alias("said"), think.alias("think"), raw.alias("raw"))


ANSWERS_SQL = """a AS (SELECT conv_id, turn, turn % 4 AS shape, trim(regexp_replace(text, '[^A-Za-z ]', '', 'g')) AS said FROM conversations)"""


def answers(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, raw: whole turns inside model outputs of four shapes (fences with newlines, inner fences, two titles, no title)."""
    said, n = F.trim(F.regexp_replace("text", r"[^A-Za-z ]", "")), F.col("turn").cast("string")
    first = F.concat(F.lit("```markdown\n<think> "), said, F.lit(" </think>\n<report># FORGERY ANALYSIS REPORT\nbody "), n, F.lit("\n**END OF REPORT**\ntail</report>\n```\n"))
    second = F.concat(F.lit("<report>\n```md\n#  Forgery Analysis  Report\nbody "), n, F.lit("\n```\n</report> after"))
    third = F.concat(F.lit("stage1 "), said, F.lit("\n# FORGERY ANALYSIS REPORT\ndraft\n# FORGERY ANALYSIS REPORT\nfinal "), n, F.lit("\n```\n"))
    shape = F.col("turn") % 4
    return read(spark, d, "conversations").select("conv_id", "turn", F.when(shape == 0, first).when(shape == 1, second).when(shape == 2, third).otherwise(F.concat(F.lit("  stage 1 "), said, F.lit(" \n"))).alias("raw"))
