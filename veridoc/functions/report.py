"""The forensic report grammar: parsing into structs and writing back.

Patterns are Java's, in Unicode mode where blanks are meant in any script; `(?d)` makes the newline the only line end.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The report grammar's patterns.
CONCLUSION = r"(?i)\[Conclusion\]\**\s*:?\**\s*([A-Za-z_\-/ ]+)"
RISK = r"(?i)\[RISK[_ ]SCORE\]\**\s*:?\**\s*(\d+)"
HEADER_AHEAD = r"(?dm)(?=^#{2,4}\s*ANOMALY_?\d)"
HEADER = r"(?d)^#{2,4}\s*ANOMALY_?(\d+)\s*:?\s*([^\n]*)"
GROUNDING = r"(?id)\[GROUNDING\]\s*:?\s*\[?\s*([0-9.,\s\-]+?)\s*\]?\s*(?:$|\n)"
REASON = r"(?isd)\[REASON\]\s*:?\s*(.+?)(?=\n\s*\[[A-Z_]+\]|\n\s*#{2,}|\z)"
CONTENT = r"(?isd)\[(?:FORGED_CONTENT|CONTENT|TEXT)\]\s*:?\s*(.+?)(?=\n\s*\[[A-Z_]+\]|\n\s*#{2,}|\z)"
SUMMARY = r"(?ismd)^#{1,3}\s*SUMMARY\s*\n(.*?)(?=\n#{1,3}\s|\z)"
SUMMARY_AHEAD = r"(?imd)(?=^#{1,3}\s*SUMMARY\s*\n)"
LOCATION = r"\(([^\n]*?)\)\s*$"
ANOMALY_TYPE = "struct<index:int,type:string,location:string,grounding:array<int>,reason:string,forged_content:string>"


def strip(c: Column) -> Column:
    """Without blanks of any script at either end."""
    return F.regexp_replace(c, r"(?U)\A\s++|(?<!\s)\s++\z", "")


def conclusion(text: Column) -> Column:
    """FORGED, PRISTINE, or what else stands there in capitals; PRISTINE if nothing does."""
    raw = F.regexp_replace(F.upper(strip(F.regexp_extract(text, CONCLUSION, 1))), " ", "_")
    return F.when(~text.rlike(CONCLUSION), "PRISTINE").when(raw.contains("FORG"), "FORGED").when(raw.rlike("PRIST|AUTH|REAL"), "PRISTINE").otherwise(raw)


def conclusion_strict(text: Column) -> Column:
    """FORGED or AUTHENTIC directly after the tag, else null."""
    return F.nullif(F.upper(F.regexp_extract(text, r"(?i)\[Conclusion\]:\s*(FORGED|AUTHENTIC)", 1)), F.lit(""))


def risk_score(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, RISK, 1), F.lit("")).try_cast("int")


def summary(text: Column) -> Column:
    return strip(F.regexp_extract(text, SUMMARY, 1))


def four_numbers(text: Column) -> Column:
    """The first four comma-separated numbers as integers, half to even; null unless there are four and all are numbers."""
    parts = F.slice(F.filter(F.transform(F.split(text, ","), lambda p: strip(p)), lambda p: p != ""), 1, 4)
    numbers = F.transform(parts, lambda p: F.rint(p.try_cast("double")).cast("int"))
    return F.when((F.size(numbers) == 4) & ~F.exists(numbers, lambda n: n.isNull()), numbers)


def blocks(text: Column) -> Column:
    """Text from each anomaly header to the next header or the summary."""
    parts = F.filter(F.split(text, HEADER_AHEAD, -1), lambda p: p.rlike(HEADER))
    return F.transform(parts, lambda p: F.get(F.split(p, SUMMARY_AHEAD, 2), F.lit(0)))


def anomaly(block: Column) -> Column:
    tail = strip(F.regexp_extract(block, HEADER, 2))
    body = F.regexp_replace(block, HEADER, "")
    located = tail.rlike(LOCATION)
    kind = F.when(located, F.regexp_replace(F.regexp_replace(tail, LOCATION, ""), r"^[ :\t]+|[ :\t]+$", "")).otherwise(tail)
    return F.struct(
        F.regexp_extract(block, HEADER, 1).try_cast("int").alias("index"),
        kind.alias("type"),
        F.when(located, strip(F.regexp_extract(tail, LOCATION, 1))).otherwise("").alias("location"),
        four_numbers(F.regexp_extract(body, GROUNDING, 1)).alias("grounding"),
        strip(F.regexp_extract(body, REASON, 1)).alias("reason"),
        strip(F.regexp_extract(body, CONTENT, 1)).alias("forged_content"),
    )


def parse_report(text: Column) -> Column:
    """struct(conclusion, risk_score, anomalies, summary, raw) of a report; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(conclusion(t).alias("conclusion"), risk_score(t).alias("risk_score"), F.transform(blocks(t), anomaly).alias("anomalies"), summary(t).alias("summary"), text.alias("raw"))


def _joined(*lines: Column) -> Column:
    """Lines that aren't null, each ended."""
    return F.concat_ws("\n", *lines)


def serialize_dataset(report: Column) -> Column:
    """The Markdown layout of the data; empty fields are left out and a missing risk is 0."""

    def one(a: Column) -> Column:
        place = F.when(F.length(a["location"]) > 0, F.concat(F.lit(" ("), a["location"], F.lit(")"))).otherwise("")
        kind = F.when(F.length(a["type"]) > 0, a["type"]).otherwise("unknown")
        tagged = lambda tag, c: F.when(F.length(c) > 0, F.concat(F.lit(f"[{tag}]: "), c))
        box = F.when(F.size(a["grounding"]) > 0, F.concat(F.lit("[GROUNDING]: ["), F.array_join(a["grounding"].cast("array<string>"), ", "), F.lit("]")))
        number = F.when(a["index"] < 1000, F.lpad(a["index"].cast("string"), 3, "0")).otherwise(a["index"].cast("string"))
        return _joined(F.concat(F.lit("### ANOMALY_"), number, F.lit(": "), kind, place), box, tagged("FORGED_CONTENT", a["forged_content"]), tagged("REASON", a["reason"]), F.lit(""))

    head = _joined(F.lit("# FORGERY ANALYSIS REPORT"), F.lit(""), F.concat(F.lit("**[Conclusion]:** "), report["conclusion"]), F.concat(F.lit("**[RISK_SCORE]:** "), F.coalesce(report["risk_score"], F.lit(0)).cast("string")), F.lit(""))
    parts = F.concat(F.array(head), F.transform(report["anomalies"], one), F.array(F.lit("## SUMMARY"), F.coalesce(report["summary"], F.lit(""))))
    return F.concat(F.regexp_replace(F.array_join(parts, "\n"), r"(?U)\s+\z", ""), F.lit("\n"))


def serialize_submission(report: Column) -> Column:
    """The flat layout: verdict, score, numbered regions (a missing box is four zeros), summary."""

    def region(a: Column, i: Column) -> Column:
        box = F.when(F.size(a["grounding"]) > 0, a["grounding"]).otherwise(F.array(*[F.lit(0)] * 4))
        said = F.when(F.length(a["forged_content"]) > 0, a["forged_content"]).otherwise(F.coalesce(a["reason"], F.lit("")))
        return F.concat(F.lit("Region "), (i + 1).cast("string"), F.lit(": ["), F.array_join(box.cast("array<string>"), ", "), F.lit("], "), F.replace(said, F.lit("\n"), F.lit(" ")))

    none = F.when(F.size(report["anomalies"]) == 0, F.array(F.lit("(none)"))).otherwise(F.transform(report["anomalies"], region))
    head = F.array(F.concat(F.lit("Conclusion: "), F.when(report["conclusion"] == "FORGED", "Forged").otherwise("Authentic")), F.concat(F.lit("Score: "), F.coalesce(report["risk_score"], F.lit(0)).cast("string")), F.lit(""), F.lit("Tamper Regions:"))
    tail = F.when(F.length(report["summary"]) > 0, F.array(F.lit(""), F.lit("Summary:"), report["summary"])).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_join(F.concat(head, none, tail), "\n"), F.lit("\n"))


def explanation(report: Column) -> Column:
    """Reasons that aren't empty and the summary, one a line."""
    parts = F.concat(F.transform(report["anomalies"], lambda a: a["reason"]), F.array(report["summary"]))
    return F.array_join(F.filter(parts, lambda p: F.length(p) > 0), "\n")


def boxes(report: Column) -> Column:
    """Groundings with four numbers."""
    return F.filter(F.transform(report["anomalies"], lambda a: a["grounding"]), lambda g: F.size(g) == 4)


#: The viewer's own, more lenient grammar.
VIEW_HEADER = r"(?iU)###\s*ANOMALY_?(\d+)\s*:?\s*([^\n]*)"
VIEW_BOX = r"(?iU)\[GROUNDING\]\s*:\s*\[\s*(-?\d+\s*,\s*-?\d+\s*,\s*-?\d+\s*,\s*-?\d+)\s*\]"
VIEW_REASON = r"(?isU)\[REASON\]\s*:\s*(.+?)(?=\n\s*###\s*ANOMALY|\n\s*---|\n\s*##\s|\n\s*\*\*END\s+OF\s+REPORT\*\*|\z)"


def visual_anomalies(text: Column) -> Column:
    """array of struct(index, type, grounding, reason) as the viewer reads a report: headers anywhere and in any case (but not in the
    rest of another header's line), only anomalies with a box of integers, blanks in reasons collapsed."""
    chunks = F.slice(F.split(F.regexp_replace(text, VIEW_HEADER, "\x01$0"), r"\x01(?=###)", -1), F.lit(2), F.greatest(F.lit(0), F.length(text)))

    def one(c: Column) -> Column:
        box = F.regexp_extract(c, VIEW_BOX, 1)
        numbers = F.transform(F.split(box, ","), lambda n: strip(n).try_cast("int"))
        reason = strip(F.regexp_replace(F.regexp_extract(c, VIEW_REASON, 1), r"(?U)\s++", " "))
        kind = F.regexp_replace(strip(F.regexp_extract(c, VIEW_HEADER, 2)), r":++\z", "")
        return F.struct(F.regexp_extract(c, VIEW_HEADER, 1).alias("index"), kind.alias("type"), F.when(box != "", numbers).alias("grounding"), reason.alias("reason"))

    return F.filter(F.transform(chunks, one), lambda a: a["grounding"].isNotNull())
