"""The registered queries, their SQL and the pipeline on the small tables."""

import hashlib
import re

import duckdb
import pytest

import corpus_pipeline
from veridoc.llm.common import table
from veridoc.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    got = sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in ORACLE_SQL:
        c = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "labels"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
        o = c.sql(ORACLE_SQL[name])
        at = [o.columns.index(k) for k in sorted(df.columns)]
        assert got == sorted(tuple(str(r[i]) for i in at) for r in o.fetchall())
    if name != "op12_collocations":  # a report by language
        assert len(got) == table(spark, small, "pages" if "url" in name else "documents").count()


def test_pipeline(spark, small):
    """Each stage against its predecessor's rows."""
    docs = before = table(spark, small, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, small)
        rows = {r.doc_id: r for r in out.collect()}
        old = {r.doc_id: r for r in before.collect()}
        assert set(rows) <= set(old) and len(rows) > 0.5 * len(old), name
        if name == corpus_pipeline.STAGES[-1][0]:
            assert all(r.decoded_sha256 == hashlib.sha256((old[k].text or "").encode()).hexdigest() for k, r in rows.items())
            assert set(rows) == set(old)
            break
        assert out.columns == docs.columns
        if name == "line dedup":
            for k, r in rows.items():
                assert set(r.text.split("\n")) <= set(old[k].text.split("\n")) and r.n_chars == len(r.text)
        else:
            assert all(rows[k] == old[k] for k in rows)
        before = spark.createDataFrame(list(rows.values()), docs.schema)
    bench = [re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", r.text.lower())[:10] for r in table(spark, small, "benchmark").collect()]
    texts = [" ".join(re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", r.text.lower())) for r in before.collect()]
    assert not any(" ".join(b) in t for b in bench if len(b) == 10 for t in texts)
