"""Reports, model text and budgets on hand-written texts."""

import pytest
from pyspark.sql import functions as F

from veridoc.functions import report as R, text as T
from veridoc.operators import budget

FULL = """# FORGERY ANALYSIS REPORT

**[Conclusion]:** FORGED
**[RISK_SCORE]:** 87

### ANOMALY_001: Visual Clumsy (total row)
[GROUNDING]: [10, 20, 30.5, 41.5]
[FORGED_CONTENT]: 1,200
[REASON]: edges differ
and the font too

### ANOMALY_002: Logical Fraud
[GROUNDING]: [1, 2, 3]
[REASON]: sums are wrong

## SUMMARY
Two places.
"""


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).first()["v"]


def test_full_report(spark):
    r = one(spark, FULL, R.parse_report(F.col("text")))
    assert (r.conclusion, r.risk_score, r.summary) == ("FORGED", 87, "Two places.")
    a, b = r.anomalies
    assert (a["index"], a.type, a.location, a.grounding) == (1, "Visual Clumsy", "total row", [10, 20, 30, 42])
    assert a.reason == "edges differ\nand the font too" and a.forged_content == "1,200"
    assert (b.type, b.location, b.grounding, b.reason) == ("Logical Fraud", "", None, "sums are wrong")


@pytest.mark.parametrize("said,verdict", [("AUTHENTIC", "PRISTINE"), ("NOT FORGED", "FORGED"), ("REAL", "PRISTINE"), ("SUSPICIOUS ONE", "SUSPICIOUS_ONE"), ("", "PRISTINE")])
def test_verdicts(spark, said, verdict):
    assert one(spark, f"**[Conclusion]:** {said}\n" if said else "nothing", R.conclusion(F.col("text"))) == verdict


def test_parse_is_a_fixpoint_of_serialize(spark):
    once = one(spark, FULL, R.serialize_dataset(R.parse_report(F.col("text"))))
    assert one(spark, once, R.serialize_dataset(R.parse_report(F.col("text")))) == once


def test_empty_and_null(spark):
    for text in ("", None):
        r = one(spark, text, R.parse_report(F.col("text")))
        assert (r.conclusion, r.risk_score, r.anomalies, r.summary) == ("PRISTINE", None, [], "")


def test_summary_keeps_the_end_mark(spark):
    assert one(spark, "## SUMMARY\nfine\n**END OF REPORT**\n", R.summary(F.col("text"))) == "fine\n**END OF REPORT**"


def test_unicode_blanks_are_stripped(spark):
    assert one(spark, "## SUMMARY\n　ok　\n", R.summary(F.col("text"))) == "ok"


def test_kept_blocks_need_a_verdict(spark):
    text = "--- STAGE 2: x ---\nREGION_001 [1, 2, 3, 4]: a. → KEEP as Logical Fraud.\nREGION_002 [1, 2, 3, 4]: b. → DROP.\n--- STAGE 3: y ---"
    assert one(spark, text, T.kept_blocks(F.col("text"))) == ["REGION_001 [1, 2, 3, 4]: a. → KEEP as Logical Fraud."]
    assert one(spark, "no stages", T.filtered_regions(F.col("text"))).startswith("(STAGE 1 unavailable)")


@pytest.mark.parametrize("said,expected", [('{"factuality": 120, "reasoning": 5, "completeness": -1}', (100, 5, 0)), ('hm {"Reasoning": 7} {"x": 1}', (0, 7, 0)), ("reasoning: 9", (0, 9, 0)), ("", (0, 0, 0))])
def test_judge(spark, said, expected):
    assert tuple(one(spark, said, T.judge_scores(F.col("text")))) == expected


def test_chunks():
    text = "## A\n" + "One two. " * 150 + "\n## B\n" + "x" * 2500
    got = budget.chunks(text)
    assert max(map(len, got)) <= 1000 and budget.chunks("") == [""] and len(got) >= 5


def test_fit():
    words = lambda t: len(t.split())
    assert budget.fit_pair("a b", "c", words, 10)[2] == "none"
    p, t, status = budget.fit_pair("w " * 500, "t " * 20, words, 100)
    assert status == "prompt_truncated" and words(p) + words(t) <= 100
    assert budget.fit_pair("w " * 500, "t " * 500, words, 1) is None
