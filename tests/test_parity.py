"""Every query that has SQL returns the SQL's rows."""

import os

import duckdb
import pytest

from veridoc.plans import all_oracles, all_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{small}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return "~"
    return f"{float(v):.6g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, small, duck, name):
    df = all_queries()[name](spark, small)
    got = [tuple(r) for r in df.collect()]
    if sql := all_oracles().get(name):
        o = duck.sql(sql)
        assert sorted(df.columns) == sorted(o.columns)
        assert rows_of(df.columns, got) == rows_of(o.columns, o.fetchall())
