"""Text of language models and prompts: unwrapping, stages, verdicts, hints, budgets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .geometry import Box
from .report import four_numbers, strip

#: Markers, anchors and phrases of the reports and reasoning traces.
ANCHOR = "# FORGERY ANALYSIS REPORT"
END = "**END OF REPORT**"
STAGE = r"(?is)---\s*STAGE\s*{}\s*[:.\-].*?---"
STAGE_1 = r"(?i)---\s*STAGE\s*1\s*[:.\-]\s*Knowledge\s*Preparation\s*---"
REGION = r"(?is)(REGION_\d+\b.*?→\s*(?:KEEP|DROP)\b[^\n.]*\.)"
KEEP = r"(?i)→\s*KEEP\s+as\s+(?:Semantic\s+Subtle|Visual\s+Clumsy|Logical\s+Fraud)\s*\.\s*\z"
#: What may stand behind a trace or report, read backwards (so that one anchored pass finds it all), 20 times at most.
TAIL_BACKWARDS = r"(?iU)\A\s*+(?:(?:>\s*+kniht\s*+/<|>\s*+llac_loot\s*+/<|>\s*+kniht\s*+<|>\s*+llac_loot\s*+<|\w*+```|\*\*\s*+TROPER\s++FO\s++DNE\s*+\*\*)\s*+){0,20}+"
TITLE = r"#\s*+FORGERY\s++ANALYSIS\s++REPORT"
THINK = r"(?is)<think>(.*?)</think>"
REGION_START = r"(?U)(?=REGION\s+\d)"
KEPT = r"(?iU)KEEP\s+as\s+(?:Semantic\s+Subtle|Visual\s+Clumsy|Logical\s+Fraud)"
FOUR_INTEGERS = r"\[\s*(-?\d+\s*,\s*-?\d+\s*,\s*-?\d+\s*,\s*-?\d+)\s*\]"
FORBIDDEN = ("given the answer", "since we know", "the gt says", "according to the ground truth", "the mask shows", "we already know", "as revealed", "it is given that", "the ground-truth", "ground truth report")
RTL, CONTINUOUS = ("ar", "fa", "ur", "he"), ("zh", "ch", "ja", "th", "lo", "km", "my")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A match's group, or null without a match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _from(text: Column, pattern: str) -> Column:
    """Text from the first match on, or null."""
    whole = F.regexp_extract(text, pattern, 0)
    return F.when(text.rlike(pattern), F.substring(text, F.position(whole, text), F.length(text)))


def _before(text: Column, pattern: str) -> Column:
    """Text up to the first match of pattern (all of it without one)."""
    at = F.position(F.regexp_extract(text, pattern, 0), text)
    return F.when(text.rlike(pattern), F.substring(text, F.lit(1), at - 1)).otherwise(text)


def block(text: Column, tag: str) -> Column:
    """Contents of the first <tag>, stripped, or null."""
    return strip(_found(text, rf"(?is)<{tag}>(.*?)</{tag}>"))


def without_fences(text: Column) -> Column:
    """Without a code fence at the beginning and one at the end (or before a last newline), stripped."""
    opened = F.regexp_replace(text, r"\A```(?:markdown|md)?(?U:\s*+)", "")
    return strip(F.regexp_replace(opened, r"```(?=\n?\z)", ""))


def _from_last_title(text: Column) -> Column:
    """From the last report title to the first end mark behind it."""
    t = F.regexp_replace(text, rf"(?isU)\A.*(?={TITLE})", "")
    at = F.position(F.lit(END), t)
    return strip(F.when(at > 0, F.substring(t, F.lit(1), at + len(END) - 1)).otherwise(t))


def clean_report(text: Column) -> Column:
    """A model's answer down to the report: outer fences, thoughts, wrapper, last title, end mark, in this order."""
    t = strip(F.regexp_replace(without_fences(text), THINK, ""))
    return _from_last_title(F.coalesce(block(t, "report"), t))


def clean_report_v0(text: Column) -> Column:
    """The older order: the wrapper first, then fences inside of it; thoughts aren't looked for."""
    return _from_last_title(without_fences(F.coalesce(block(text, "report"), text)))


def strip_thinking(text: Column) -> Column:
    """struct(thinking, answer): <think> parts, or without any what stands before the first report title; the rest, fences off."""
    parts = F.regexp_extract_all(text, F.lit(THINK), F.lit(1))
    rest = strip(F.regexp_replace(text, THINK, ""))
    at = F.regexp_instr(rest, F.lit(f"(?iU){TITLE}"))
    stray = (F.size(parts) == 0) & (at > 1)
    said = F.array_join(F.filter(F.transform(parts, strip), lambda p: p != ""), "\n\n")
    thinking = F.when(stray, strip(F.substring(rest, F.lit(1), at - 1))).otherwise(said)
    answer = F.when(stray, strip(F.substring(rest, at, F.length(rest)))).otherwise(rest)
    return F.struct(thinking.alias("thinking"), without_fences(answer).alias("answer"))


def think_or_stages(text: Column) -> Column:
    """<think> body, or all of a text that names STAGE 1 or STAGE 2 (one blank between), or null."""
    upper = F.upper(text)
    return F.coalesce(block(text, "think"), F.when(upper.contains("STAGE 1") | upper.contains("STAGE 2"), strip(text)))


def trim_tail(text: Column) -> Column:
    """Without blanks, fences, tags and end marks at the end.  Runs of any length are passed once."""
    return F.reverse(F.regexp_replace(F.reverse(text), TAIL_BACKWARDS, ""))


def stages(text: Column, first: int, before: int | None) -> Column:
    """From a stage's title to (excluding) a later stage's, or to the end; null without the first."""
    start = STAGE_1 if first == 1 else STAGE.format(first)
    body = _from(text, start)
    if before:
        body = _before(body, STAGE.format(before))
    return F.nullif(trim_tail(body), F.lit(""))


def stage_one(text: Column) -> Column:
    """Stage 1 up to stage 2, or without one up to stage 3."""
    body = _from(text, STAGE_1)
    cut = F.when(body.rlike(STAGE.format(2)), _before(body, STAGE.format(2))).otherwise(_before(body, STAGE.format(3)))
    return F.nullif(trim_tail(cut), F.lit(""))


def kept_blocks(text: Column) -> Column:
    """REGION blocks of stage 2 whose verdict keeps them."""
    body = _before(_from(text, STAGE.format(2)), STAGE.format(3))
    found = F.transform(F.regexp_extract_all(body, F.lit(REGION), F.lit(1)), lambda b: strip(b))
    return F.coalesce(F.filter(found, lambda b: b.rlike(KEEP)), F.array().cast("array<string>"))


def filtered_regions(text: Column) -> Column:
    """Stage 1 and the kept blocks under their title, or notes in their place."""
    one, kept = stage_one(text), kept_blocks(text)
    said = F.when(F.size(kept) > 0, F.array_join(kept, "\n\n")).otherwise("No confirmed tampering regions.")
    note = F.when(one.isNull() & (F.size(kept) == 0), "(STAGE 1 unavailable)")
    return F.concat_ws("\n\n", note, one, F.lit("--- STAGE 2 KEEP regions (filtered) ---"), said)


def kept_boxes(text: Column) -> Column:
    """All boxes (integers in brackets, each once a block) of the blocks that begin with REGION (cut where REGION, blanks and a number stand) and say KEEP anywhere."""

    def boxes(b: Column) -> Column:
        found = F.transform(F.regexp_extract_all(b, F.lit(FOUR_INTEGERS), F.lit(1)), lambda f: F.transform(F.split(f, ","), lambda n: strip(n).try_cast("bigint")))
        return F.array_distinct(found)

    kept = F.filter(F.split(text, REGION_START, -1), lambda b: strip(b).startswith("REGION") & b.rlike(KEPT))
    return F.coalesce(F.flatten(F.transform(kept, boxes)), F.array().cast("array<array<bigint>>"))


def groundings(text: Column) -> Column:
    """All integer [GROUNDING] boxes."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\[GROUNDING\]\s*:?\s*\[?\s*(\d+\s*,\s*\d+\s*,\s*\d+\s*,\s*\d+)"), F.lit(1))
    return F.transform(found, lambda f: four_numbers(f))


def replace_first_grounding(text: Column, box: Column) -> Column:
    made = F.concat(F.lit("$1[GROUNDING]: ["), F.array_join(box.cast("array<string>"), ", "), F.lit("]"))
    return F.regexp_replace(text, F.lit(r"(?is)\A(.*?)\[GROUNDING\]\s*:?\s*\[?\s*\d+\s*,\s*\d+\s*,\s*\d+\s*,\s*\d+\s*\]?"), made)


def validation(raw: Column, expected: Column) -> Column:
    """Checks of a teacher's output against the report that it should give."""
    think, report = block(raw, "think"), block(raw, "report")
    both = think.isNotNull() & report.isNotNull()
    flat = lambda c: strip(F.regexp_replace(c, r"(?U)\s+", " "))
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(think, F.lit(r"(?i)STAGE\s*(\d+)"), F.lit(1)), lambda n: n.cast("int"))))
    found = F.when(both, found).otherwise(F.array().cast("array<int>"))
    match = F.when(both & (F.length(expected) > 0), flat(report) == flat(expected)).when(~both, F.lit(False))
    phrase = F.when(both, F.coalesce(*[F.when(F.lower(think).contains(p), F.lit(p)) for p in FORBIDDEN]))
    ok = both & (F.size(found) >= 4) & F.coalesce(match, F.lit(True)) & phrase.isNull()
    return F.struct(both.alias("has_think"), both.alias("has_report"), found.alias("stages_found"), match.alias("report_match"), phrase.alias("forbidden_phrase"), ok.alias("ok"))


AXES = ("factuality", "reasoning", "completeness")


def judge_scores(text: Column) -> Column:
    """factuality, reasoning, completeness (0 to 100) from JSON, else from a {...} inside, else from single fields, else 0."""
    objects = F.concat(F.array(strip(text)), F.regexp_extract_all(text, F.lit(r"(?s)(\{.*?\})"), F.lit(1)))
    maps = F.transform(objects, lambda o: F.from_json(F.lower(o), "map<string,string>", {"mode": "PERMISSIVE"}))
    good = F.filter(maps, lambda m: F.exists(F.map_keys(m), lambda k: k.isin(*AXES)))
    first = F.get(good, F.lit(0))
    put = lambda c: F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(c.try_cast("double"), F.lit(0.0))))
    field = lambda a: F.nullif(F.regexp_extract(text, rf'(?i)"?{a}"?\s*[:=]\s*(\d{{1,3}})', 1), F.lit(""))
    return F.struct(*[F.when(first.isNotNull(), put(F.try_element_at(first, F.lit(a)))).otherwise(put(F.coalesce(field(a), F.lit("0")))).alias(a) for a in AXES])


def judge_scores_simple(text: Column) -> Column:
    """The same from the first {...} without nesting only."""
    parsed = F.from_json(F.regexp_extract(text, r"(?s)(\{[^{}]*\})", 1), "map<string,string>")
    return F.struct(*[F.coalesce(F.try_element_at(parsed, F.lit(a)).try_cast("double"), F.lit(0.0)).alias(a) for a in AXES])


def _box_text(b: Box) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", *(c.cast("string") for c in b)), F.lit("]"))


NO_REGIONS = "No suspicious regions detected by DTD."


def region_lines(regions: Column, line) -> Column:
    """Numbered lines of an array of region structs under their title; a fixed sentence without regions."""
    title = F.concat(F.lit("DTD flagged "), F.size(regions).cast("string"), F.lit(" suspicious region(s):"))
    return F.when(F.coalesce(F.size(regions), F.lit(0)) <= 0, NO_REGIONS).otherwise(F.array_join(F.concat(F.array(title), F.transform(regions, line)), "\n"))


def hints_plain(regions: Column) -> Column:
    return region_lines(regions, lambda r, i: F.concat(F.lit("  Region "), (i + 1).cast("string"), F.lit(": "), _box_text(Box.in_struct(r))))


def hints_confidence(regions: Column) -> Column:
    """regions with a mean confidence."""
    return region_lines(regions, lambda r, i: F.concat(F.lit("  Region "), (i + 1).cast("string"), F.lit(": "), _box_text(Box.in_struct(r)), F.format_string(" (mean confidence %.3f)", r["confidence"])))


def hints_words(regions: Column, shown: int = 40) -> Column:
    """regions with words (id, text), already chosen and ordered."""

    def word(w: Column) -> Column:
        t = F.replace(F.coalesce(w["text"], F.lit("")), F.lit('"'), F.lit("'"))
        return F.concat(F.lit("#"), w["id"].cast("string"), F.lit(' "'), F.when(F.length(t) > shown, F.concat(F.substring(t, 1, shown - 3), F.lit("..."))).otherwise(t), F.lit('"'))

    def line(r: Column, i: Column) -> Column:
        said = F.when(F.size(r["words"]) > 0, F.concat(F.lit(" | overlaps OCR: "), F.array_join(F.transform(r["words"], word), ", "))).otherwise(" | no OCR overlap")
        return F.concat(F.lit("  Region "), (i + 1).cast("string"), F.lit(": "), _box_text(Box.in_struct(r)), said)

    return region_lines(regions, line)


def hints_tp_fp(regions: Column) -> Column:
    """regions with a flag tp."""
    line = lambda r, i: F.concat(F.lit("  DTD Region "), (i + 1).cast("string"), F.lit(" "), _box_text(Box.in_struct(r)), F.lit(": "), F.when(r["tp"], "TP (real tampering — KEEP)").otherwise("FP (false alarm — DROP)"))
    return F.when(F.coalesce(F.size(regions), F.lit(0)) <= 0, "(no DTD regions on this image)").otherwise(F.array_join(F.transform(regions, line), "\n"))


def ocr_compact(items: Column, reading_order: Column) -> Column:
    """Word triplets, then the text in reading order; a fixed sentence without either."""
    one = lambda w: F.concat(F.lit('("'), w["text"], F.lit('", '), _box_text(Box.in_struct(w)), F.lit(", "), w["confidence"].cast("string"), F.lit(")"))
    words = F.when(F.size(items) > 0, F.concat(F.lit("Detected words as (text, [bbox], confidence) triplets:\n\n"), F.array_join(F.transform(items, one), ", ")))
    order = strip(F.coalesce(reading_order, F.lit("")))
    both = F.concat_ws("\n\n", words, F.when(order != "", F.concat(F.lit("Reading-order text:\n\n"), order)))
    return F.when(both == "", "No OCR text detected.").otherwise(both)


def ocr_listing(lang: Column, items: Column, reading_order: Column) -> Column:
    """The fixed-width listing for prompts."""
    one = lambda w: F.format_string('  [%3d]  [%4d,%4d,%4d,%4d]  (conf=%.2f)  "%s"', w["id"], *Box.in_struct(w), w["confidence"], w["text"])
    head = F.array(F.lit("--- OCR EXTRACTION ---"), F.concat(F.lit("(detected language: "), F.coalesce(lang, F.lit("unknown")), F.lit(")")), F.lit(""), F.lit("Reading-order text:"), F.lit(""), reading_order, F.lit(""), F.lit("Individual word/text blocks with coordinates:"))
    return F.array_join(F.concat(head, F.transform(items, one), F.array(F.lit("--- END OCR ---"))), "\n")


def substitute(template: Column, slots: dict[str, Column], scrub: tuple[str, ...] = ()) -> Column:
    """Fills {{SLOT}}s; those in scrub are emptied."""
    for name, value in slots.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), value)
    for name in scrub:
        template = F.replace(template, F.lit("{{" + name + "}}"), F.lit(""))
    return template


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def is_sentence(text: Column) -> Column:
    tokens = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != ""))
    return (tokens >= 3) | (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) >= 2)


def script_class(lang: Column) -> Column:
    return F.when(lang.isin(*RTL), "rtl").when(lang.isin(*CONTINUOUS), "continuous").otherwise("spaced")


def head_budget(longest: int, reserve: int, image_tokens: Column, margin: int) -> Column:
    left = F.lit(longest - reserve - margin) - image_tokens
    return F.when(left < 64, F.greatest(F.lit(64), F.lit(longest // 4))).otherwise(left)


def keep_head(tokens: Column, budget: Column) -> Column:
    return F.slice(tokens, F.lit(1), F.greatest(budget, F.lit(0)))


def padded_length(longest: Column, multiple: int = 8) -> Column:
    return (F.ceil(longest / multiple) * multiple).cast("bigint")
