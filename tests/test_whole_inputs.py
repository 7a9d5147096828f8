"""Queries over derived inputs see whole texts."""

import hashlib

from veridoc.operators import budget
from veridoc.plans import inputs


def test_traces(spark, tmp_path):
    from veridoc.plans import all_queries

    text = "word " * 50 + "as revealed here"
    spark.createDataFrame([(1, 2, "user", text), (2, 2, "user", "short")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = {r.conv_id: r for r in inputs.traces(spark, str(tmp_path)).collect()}
    assert rows[1].said == text and text in rows[1].think and text in rows[1].raw
    run = lambda name: {r.conv_id: r for r in all_queries()[name](spark, str(tmp_path)).collect()}
    assert [run("h25_validate")[k].forbidden_phrase for k in (1, 2)] == ["as revealed", None]
    assert run("h15_strip_thinking")[1].thinking == f"stage1 {text}"
    assert run("h19_reasoning")[1].value == hashlib.md5(rows[1].think.encode()).hexdigest()
    assert run("h18_stage1")[1].value.endswith("as revealed here")


def test_fit_sample(spark, tmp_path):
    from veridoc.plans import all_queries

    texts = ["word " * n for n in (5, 90, 150, 260, 600)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.status, r.prompt_chars) for r in all_queries()["i03_fit_sample"](spark, str(tmp_path)).collect()}
    fit = [budget.fit_pair(t, t, lambda x: len(x.split()), 200) or (None, None, "too_long") for t in texts]
    assert got == {i: (s, None if p is None else len(p)) for i, (p, _, s) in enumerate(fit)}


def test_all_parts(spark, tmp_path):
    from veridoc.plans import all_queries

    spark.createDataFrame([(i,) for i in (0, 50, 2500, 100_001, 123_456, 123_457)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.part: r.n for r in all_queries()["a10_cot_scan"](spark, str(tmp_path)).collect()}
    assert got == {"part000": 2, "part025": 1, "part1000": 1, "part1234": 2}
