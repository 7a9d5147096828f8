"""Composed pipelines: evaluation, augmentation, prompts, extraction, training rows, two stages, sweeps, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import report as R, text as T
from ..functions.geometry import Box, clip_box
from ..operators import contracts, metrics as M, spatial as S
from ..operators.similarity import text_similarity
from ..tables import stored


def exploded_boxes(df: DataFrame, key: str, boxes: Column, width: Column = None, height: Column = None) -> DataFrame:
    """doc, x1, y1, x2, y2 from an array of four-number arrays, clipped to the canvas if there is one."""
    rows = df.select(F.col(key).alias("doc"), *([width.alias("w"), height.alias("h")] if width is not None else []), F.explode(boxes).alias("b"))
    b = Box(*(F.get("b", i) for i in range(4)))
    return rows.select("doc", *(clip_box(b, F.col("w"), F.col("h")) if width is not None else b).named())


def explained(pairs: DataFrame) -> DataFrame:
    """id, f1 of explanations (id, truth, predicted) by their words' best matches."""
    return text_similarity(pairs, ["id"], "truth", "predicted").select("id", "f1")


def evaluate(pairs: DataFrame, *, judge=contracts.mock_judge, weights: dict[str, float] = M.COMMAND_LINE, similarity: Callable[[DataFrame], DataFrame] | None = explained) -> DataFrame:
    """One row of scores of predicted against true reports.

    pairs: id, truth, predicted (report texts), width, height.  similarity: from (id, truth, predicted) explanations to
    (id, f1); with None the explanation part drops out and its weight goes to the others.  Reports are parsed once, into a table.
    """
    parsed = stored(pairs.select("id", "width", "height", R.parse_report(F.col("truth")).alias("t"), R.parse_report(F.col("predicted")).alias("p")).withColumns({"t": F.col("t").dropFields("raw"), "p": F.col("p").dropFields("raw")}), "parsed")
    detection = M.detection_scores(parsed.select(F.col("t.conclusion").alias("a"), F.col("p.conclusion").alias("b")), "a", "b")
    a = exploded_boxes(parsed, "id", R.boxes(F.col("t")), F.col("width"), F.col("height"))
    b = exploded_boxes(parsed, "id", R.boxes(F.col("p")), F.col("width"), F.col("height"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    pixels = parsed.select(F.col("id").alias("doc"), M.is_forged(F.col("t.conclusion")).alias("forged")).join(S.pixel_counts(a, b), "doc", "left")
    x = M.pixel_metrics(zero(F.col("tp")), zero(F.col("fp")), zero(F.col("fn")))
    grounding = M.grounding_scores(pixels.select("forged", x["iou"].alias("iou"), x["f1"].alias("f1")), F.col("forged"))
    prompt = F.concat(F.lit("TRUTH:\n"), R.explanation(F.col("t")), F.lit("\nPREDICTION:\n"), R.explanation(F.col("p")))
    asked = parsed.select(T.judge_scores(contracts.judge(prompt, judge)).alias("s")).select("s.*")
    rubric = M.rubric_scores(asked).select(F.col("average_norm").alias("rubric"))
    meant = similarity(parsed.select("id", R.explanation(F.col("t")).alias("truth"), R.explanation(F.col("p")).alias("predicted"))).agg(F.avg("f1").alias("explanation")) if similarity else None
    one = detection.join(F.broadcast(grounding.withColumnRenamed("n", "n_grounding"))).join(F.broadcast(rubric))
    one = one.join(F.broadcast(meant)) if meant is not None else one.withColumn("explanation", F.lit(None).cast("double"))
    parts = {"detection": F.col("f1"), "grounding": M.grounding_part(F.col("miou"), F.col("mf1")), "explanation": F.col("explanation"), "rubric": F.col("rubric")}
    return one.withColumn("final_score", M.final_score(parts, weights))


def augment(items: DataFrame, regions: DataFrame, words: DataFrame, masks: DataFrame, *, least_word: float = 0.1, least_region: float = 0.1) -> DataFrame:
    """doc, item, refined, word_box, region_box, source: each grounding moved to its mask box, then matched.

    items, regions, words, masks: doc, a key (item or candidate) and a box.
    """
    refined = S.refine(items, masks)
    moved = refined.select("doc", "item", "moved", "new.*")
    by = ["doc", "item"]
    word = S.best_single_or_pair(moved, words, least_word).select(*by, F.col("box").alias("word_box"))
    region = S.best_single_or_pair(moved, regions, least_region).select(*by, F.col("box").alias("region_box"))
    out = moved.join(word, by, "left").join(region, by, "left")
    source = F.when(F.col("region_box").isNotNull(), "dtd").when(F.col("word_box").isNotNull(), "ocr").otherwise("original")
    return out.select(*by, "moved", F.struct(*Box.of().named()).alias("refined"), "word_box", "region_box", source.alias("source"))


def render_prompts(records: DataFrame, templates: DataFrame) -> DataFrame:
    """key columns of records, template, prompt for every record and template.

    records: id, part, items, reading_order, regions (with words), raw; templates: name, text (a handful, broadcast).
    """
    slots = {"OCR_JSON": T.ocr_compact(F.col("items"), F.col("reading_order")), "DTD_HINTS": T.hints_words(F.col("regions")), "FILTERED_DTD": T.filtered_regions(F.col("raw"))}
    filled = records.select("id", "part", *[c.alias(n) for n, c in slots.items()])
    prompt = T.substitute(F.col("text"), {n: F.col(n) for n in slots})
    return filled.join(F.broadcast(templates.select(F.col("name").alias("template"), "text"))).select("id", "part", "template", prompt.alias("prompt"))


def training_rows(traces: DataFrame, excluded: DataFrame, mode: str = "reasoning") -> DataFrame:
    """traces with `target` by reasoning mode and `reject_reason` (null for rows to train on)."""
    raw, report = F.coalesce("raw", F.lit("")), F.coalesce("report", F.lit(""))
    body = {"report": F.lit(""), "reasoning": T.stages(raw, 1, None), "first_two": T.stages(raw, 1, 3), "stages_34": T.stages(raw, 3, None)}[mode]
    target = report if mode == "report" else F.when(body.isNotNull(), F.concat(F.lit("<think>\n"), body, F.lit("\n</think>\n"), report))
    marked = traces.join(excluded.select("stem", F.lit(True).alias("_excluded")), "stem", "left").withColumn("target", target)
    from ..operators.relational import reject_reason

    rules = [("excluded", F.coalesce("_excluded", F.lit(False))), ("not_valid", ~F.coalesce("ok", F.lit(False))), ("no_target", F.col("target").isNull()), ("no_image", F.col("image").isNull()), ("png", F.lower("image").endswith(".png"))]
    return marked.withColumn("reject_reason", reject_reason(rules)).drop("_excluded")


def two_stages(items: DataFrame, first, second, template: Column, *, name: str = "vlm") -> DataFrame:
    """Prompt of stage 1, its answer's kept regions into the second prompt, and the second answer's clean report."""
    one = contracts.generate(items, "prompt", first, f"{name}-1").withColumnRenamed("output", "stage_1").withColumnRenamed("error", "error_1")
    two = one.withColumn("prompt_2", T.substitute(template, {"FILTERED_DTD": T.filtered_regions(F.coalesce("stage_1", F.lit("")))}))
    out = contracts.generate(two, "prompt_2", second, f"{name}-2").withColumnRenamed("output", "stage_2")
    return out.withColumn("report", T.clean_report(F.coalesce("stage_2", F.lit(""))))


def chat_record(df: DataFrame, prompt: str, *, placeholder: str | None = None, style: str = "dataset") -> DataFrame:
    """df (id, image, language, type, report_text, mask) with `record`; the contents are text with a placeholder, else
    lists of typed blocks."""
    said = F.coalesce("report_text", F.lit(""))
    if style == "submission":
        said = F.when(said == "", said).otherwise(R.serialize_submission(R.parse_report(said)))
    if placeholder:
        user, answer = F.lit(f"{placeholder}\n{prompt}"), said
    else:
        block = lambda kind, image, text: F.struct(F.lit(kind).alias("type"), image.cast("string").alias("image"), text.cast("string").alias("text"))
        null = F.lit(None)
        user, answer = F.array(block("image", F.col("image"), null), block("text", null, F.lit(prompt))), F.array(block("text", null, said))
    messages = F.array(F.struct(F.lit("user").alias("role"), user.alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content")))
    return df.withColumn("record", F.struct("id", "image", "language", "type", messages.alias("messages"), "mask"))


def prompt_statistics(df: DataFrame, key: str, text: str, cutoff: int, count=None) -> dict[str, DataFrame]:
    counted = df.select(key, F.length(text).alias("chars"), contracts.token_count(F.col(text), *([count] if count else [])).alias("tokens"))
    return {"stats": M.text_stats(counted, F.col("tokens")), "percentiles": M.nearest_ranks(counted, "tokens", [50, 90, 95, 99, 100]), "histogram": M.histogram(counted, "tokens"), "over": M.over_cutoff(counted, "tokens", cutoff, 20, key)}


def bundle(df: DataFrame) -> DataFrame:
    """name, content: a document's files (stem, image_name, prompt, raw): prompt, raw output, reasoning if any, report as text and as JSON."""
    report, think = T.clean_report(F.col("raw")), T.think_or_stages(F.col("raw"))
    ended = F.when(F.col("report").endswith("\n"), F.col("report")).otherwise(F.concat("report", F.lit("\n")))
    files = {"prompt.txt": F.col("prompt"), "report.raw.txt": F.col("raw"), "think.txt": F.when(F.col("think") != "", F.col("think")), "report.md": ended, "report.json": F.to_json(F.struct("image_name", "report"))}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("file"), c.alias("content")) for n, c in files.items()]))
    return df.withColumns({"report": report, "think": think}).select("stem", each.alias("f")).where("f.content IS NOT NULL").select(F.concat_ws("/", "stem", "f.file").alias("name"), "f.content")
