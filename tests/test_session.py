"""SQL functions, text similarity and the text rules on inputs that their author didn't shape."""

import difflib
import re

import pytest
from pyspark.sql import functions as F

from veridoc.functions import report as R, session, text as T
from veridoc.operators import similarity


def one(spark, expression, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expression.alias("x")).first().x


def test_registered_functions(spark):
    names = session.register(spark, "vt_")
    assert {"vt_box_iou", "vt_parse_report", "vt_clean_report", "vt_mask_to_boxes"} <= set(names)
    boxes = "named_struct('x1', {0}, 'y1', 0, 'x2', {1}, 'y2', 10)"
    df = spark.sql(f"SELECT vt_box_iou({boxes.format(0, 10)}, {boxes.format(5, 15)}) AS a, vt_box_union({boxes.format(0, 10)}, {boxes.format(5, 15)}).x2 AS b, vt_report_conclusion('**[Conclusion]:** forged') AS c, vt_report_conclusion(NULL) AS d, vt_parse_report('### ANOMALY_2: K (top)').anomalies[0].location AS e")
    assert tuple(df.first()) == (pytest.approx(1 / 3), 15, "FORGED", "PRISTINE", "top")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BatchEval" not in plan
    spark.createDataFrame([("a", 2, 3, [0.9, 0.9, 0.0, 0.0, 0.0, 0.9]), ("b", 1, 2, [0.0, 0.0]), ("c", 1, 1, None)], "doc string, h int, w int, data array<float>").createOrReplaceTempView("vt_maps")
    got = spark.sql("SELECT * FROM vt_mask_to_boxes(TABLE(vt_maps) PARTITION BY (doc), 0.5D, 1, 4)")
    assert [tuple(r) for r in got.orderBy("number").collect()] == [("a", 1, 0, 0, 2, 1), ("a", 2, 2, 1, 3, 2)]
    assert got.schema["doc"].dataType.simpleString() == "string"
    with pytest.raises(Exception, match="doc, h, w and data"):
        spark.sql("SELECT * FROM vt_mask_to_boxes(TABLE(SELECT 1 AS doc), 0.5D, 1, 4)").collect()


def test_long_runs_are_passed_once(spark):
    """A million blanks inside and at the ends; a hundred thousand marks."""
    blanks = " " * 1_000_000
    text = f"{blanks}a{blanks}b{blanks}"
    assert one(spark, R.strip(F.col("t")), t=text) == f"a{blanks}b"
    assert one(spark, T.trim_tail(F.col("t")), t=text) == f"{blanks}a{blanks}b"
    assert one(spark, T.trim_tail(F.col("t")), t="a" + "`" * 100_000 + "- </think>\n```json\n**END  OF REPORT** ") == "a" + "`" * 100_000 + "-"
    assert one(spark, T.trim_tail(F.col("t")), t="x" + "```" * 25) == "x" + "```" * 5  # twenty marks at most
    assert one(spark, T.clean_report(F.col("t")), t="```\n" + blanks + "y" + blanks + "\n```\n") == "y"


def test_answers(spark):
    think = T.strip_thinking(F.col("t"))
    ask = lambda e, t: one(spark, e, t=t)
    assert tuple(ask(think, "a <think> x </think> b <THINK></THINK> c")) == ("x", "a  b  c")
    assert tuple(ask(think, "so\n#Forgery analysis\n report 1")) == ("so", "#Forgery analysis\n report 1")
    assert tuple(ask(think, "# FORGERY ANALYSIS REPORT")) == ("", "# FORGERY ANALYSIS REPORT")
    assert ask(T.clean_report_v0(F.col("t")), "x <report>```\nq\n```\n</report>") == "q"
    assert ask(T.think_or_stages(F.col("t")), "stage1") is None and ask(T.think_or_stages(F.col("t")), " Stage 2 ") == "Stage 2"
    assert ask(T.kept_boxes(F.col("t")), " REGION_1 [1,2,3,4] KEEP as Visual Clumsy") == [[1, 2, 3, 4]] and ask(T.kept_boxes(F.col("t")), "x REGION_1 [1,2,3,4] KEEP as Visual Clumsy") == []
    views = ask(R.visual_anomalies(F.col("t")), "a ### ANOMALY_1: T1: ### ANOMALY_2: x\n[GROUNDING]: [1,2,3,4]\n[REASON]: a\n\n## S\n###anomaly7 Q\n[GROUNDING]: [1.5,2,3,4]\n### Anomaly_08:\n[GROUNDING]:[-1, 2,3,4 ]")
    assert [(v["index"], v.type, v.grounding, v.reason) for v in views] == [("1", "T1: ### ANOMALY_2: x", [1, 2, 3, 4], "a"), ("08", "[GROUNDING]:[-1, 2,3,4 ]", [-1, 2, 3, 4], "")]


def brute(reference, candidate, least=0.5):
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    grams = lambda w: {f"^{w}$"[i : i + 3] for i in range(len(w))}

    def alike(a, b):
        x, y = grams(a), grams(b)
        s = 1.0 if a == b else 2 * len(x & y) / (len(x) + len(y))
        return s if s >= least else 0.0

    n = max(len(reference), len(candidate))
    out = [0.0, 0.0, 0.0]
    for i in range(n):
        r, c = (words(x[i]) if i < len(x) else [] for x in (reference, candidate))
        p = sum(max((alike(a, b) for b in r), default=0) for a in c) / len(c) if c else 0.0
        q = sum(max((alike(a, b) for b in c), default=0) for a in r) / len(r) if r else 0.0
        out = [x + y for x, y in zip(out, (p, q, 2 * p * q / (p + q) if p + q else 0.0), strict=True)]
    return [x / n if n else 0.0 for x in out]


@pytest.mark.parametrize("least", [0.3, 0.5, 0.9])
def test_similarity(spark, least):
    rows = [(1, ["The cat sat", "on mats mats"], ["the cats sit", "on a mat"]), (2, [], []), (3, None, ["a"]), (4, ["x"], ["x", "y z"]), (5, [None, "é éa"], ["q", "Éa éa"]), (6, ["aaaa aaaaaaab " * 30], ["aaaaa aaaaaab baaaa"]), (7, ["forged total 1240 in row", "signature stroke"], ["forgery totals 1250 in rows", "signatures strokes stroke"])]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>")
    got = {r.id: [r.precision, r.recall, r.f1] for r in similarity.chunk_similarity(df, ["id"], "a", "b", least).collect()}
    for i, a, b in rows:
        assert got[i] == pytest.approx(brute(a or [], b or [], least)), i
    assert similarity.chunk_similarity(df.limit(0), ["id"], "a", "b").count() == 0


def test_text_similarity(spark):
    long = "The total was changed. " * 100
    df = spark.createDataFrame([(1, long, long), (2, long, ""), (3, None, None), (4, "same words", "words same")], "id int, a string, b string")
    got = {r.id: r for r in similarity.text_similarity(df, ["id"], "a", "b").collect()}
    assert got[1].f1 == pytest.approx(1) and got[1].n_chunks == 3 and got[2].f1 == got[3].f1 == 0 and got[4].f1 == 1
    assert difflib.SequenceMatcher(None, "same words", "words same").ratio() < 1  # order doesn't count


def test_similarity_shuffles_nothing(spark):
    """F4, F5, F8: pairs stand in one row each; words and their trigrams aren't dealt out."""
    df = spark.range(3).select("id", F.array(F.lit("the cats sit")).alias("a"), F.array(F.lit("the cat sat")).alias("b"))
    plan = similarity.chunk_similarity(df, ["id"], "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Generate" not in plan
