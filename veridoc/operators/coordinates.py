"""Boxes that a teacher's raw output names, put into the report by the number of the anomaly."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.matches import matches, rebuilt, whole_number
from .relational import asof_headers

# The formats of reports and of raw outputs.
BOX = r"\[\s*(-?[0-9]+)\s*,\s*(-?[0-9]+)\s*,\s*(-?[0-9]+)\s*,\s*(-?[0-9]+)\s*\]"
IN_REPORT = r"\[GROUNDING\]:\s*" + BOX
IN_RAW = r"(?id)ANOMALY_([0-9]+)\s*:.*\n\[GROUNDING\]\s*:\s*" + BOX
HEADER = r"(?i)###\s*ANOMALY_([0-9]+)"
WRITTEN = "[GROUNDING]: [%s, %s, %s, %s]"


def grounding_headers(reports: DataFrame, reach: int = 2000) -> DataFrame:
    """doc, at, index: for each box of a report (doc, text) the number of the last header in the `reach` characters before it.

    Headers and boxes are found with their offsets and meet in one window by document.
    """
    marks = reports.select("doc", F.explode(matches(F.col("text"), IN_REPORT)).alias("m")).select("doc", F.col("m.at").alias("at"))
    headers = reports.select("doc", F.explode(matches(F.col("text"), HEADER)).alias("m")).select("doc", F.col("m.at").alias("at"), F.regexp_extract("m.found", HEADER, 1).alias("index"))
    return asof_headers("doc", marks, headers, reach)


def teacher_boxes(raws: DataFrame) -> DataFrame:
    """doc, index, box: what a raw output (doc, raw) says of each anomaly; of a number named again the last box counts."""
    each = raws.select("doc", F.explode(matches(F.col("raw"), IN_RAW)).alias("m"))
    box = F.array(*[whole_number(F.regexp_extract("m.found", IN_RAW, k)) for k in (2, 3, 4, 5)])
    return each.groupBy("doc", F.regexp_extract("m.found", IN_RAW, 1).alias("index")).agg(F.max_by(box, F.col("m.at")).alias("box"))


def with_teacher_boxes(reports: DataFrame, raws: DataFrame, reach: int = 2000) -> DataFrame:
    """reports (doc, text, more) with `text` rewritten and replacements: array of original, replaced (null: box stays).

    Numbers are compared as strings ('001' is not '1').  A box without a header in reach, or whose number the teacher doesn't
    name, stays as it was written; so does the text of a null doc.  doc must be unique in both tables; null texts stay null.
    """
    named = grounding_headers(reports.where("doc IS NOT NULL"), reach).join(teacher_boxes(raws), ["doc", "index"], "left")
    lists = named.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", "box"))).alias("new_boxes"))
    out = reports.join(lists, "doc", "left").withColumn("new_boxes", F.coalesce("new_boxes", F.array().cast(dict(lists.dtypes)["new_boxes"])))
    written = F.transform("new_boxes", lambda b: F.when(b["box"].isNotNull(), F.format_string(WRITTEN, *[F.get(b["box"], F.lit(k)) for k in range(4)])))
    hits = F.regexp_extract_all("text", F.lit(IN_REPORT), F.lit(0))
    original = F.transform(hits, lambda h: F.array(*[whole_number(F.regexp_extract(h, IN_REPORT, k)) for k in (1, 2, 3, 4)]))
    pairs = F.zip_with(original, "new_boxes", lambda o, b: F.struct(o.alias("original"), b["box"].alias("replaced")))
    return out.withColumns({"replacements": pairs, "text": rebuilt(F.col("text"), IN_REPORT, written)}).drop("new_boxes")
