"""Each registered catalogue query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from tidemark.plans.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf="/root/testdata/sf0.001"):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    rel = con.execute(SQL[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    theirs = sorted(tuple(norm(row[cols.index(c)]) for c in order) for row in rel.fetchall())
    ours = sorted(tuple(norm(row[c]) for c in order) for row in df.collect())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"h05_nested_selection"}))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
