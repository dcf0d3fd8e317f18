from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import DOC, ODD, brute_components, brute_hits
from tidemark.llm.common import table
from tidemark.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rel = con.execute(SQL[name])
    cols = [d[0] for d in rel.description]
    df = QUERIES[name](spark, sf)
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(str(r[c]) for c in sorted(cols)) for r in df.collect()) == sorted(tuple(str(r[cols.index(c)]) for c in sorted(cols)) for r in rel.fetchall())


def test_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    items = [tuple(r) for r in table(spark, sf, "benchmark").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id for r in out.collect()}
        if name != "packing":
            assert out.columns == docs.columns
        if name == "language_id":
            assert len(after) >= 0.99 * len(before)
        if name == "line_dedup":
            assert after == set(before)
        if name == "jaccard_join":
            assert after == {i for i, (_, c) in brute_components(list(before.items()), 5, 80).items() if i == c}
        if name == "decontamination":
            assert after == {i for i, t in before.items() if not ((h := brute_hits(t, items))[1] > 0 and 20 * h[1] >= h[0])}
        if name == "packing":
            assert after == set(before)
        docs = out


def test_stages_on_odd_rows(spark, sf, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, extra columns with clashing names; and an empty table."""
    clash = {"cls": F.lit(1), "key": F.lit(2), "th": F.lit(3), "hits": F.lit("x"), "lines": F.lit(4), "ids": F.lit(5), "__label": F.lit("l")}
    odd = spark.createDataFrame([*ODD, (7, "the cat sat on the mat", "en", "b", 22), (8, "the cat sat on the mat", "en", "b", 22), (None, None, None, None, None)], DOC).withColumns(clash)
    for name, docs in (("odd", odd), ("empty", odd.limit(0))):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
            assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        if name == "odd":
            kept = {r.doc_id for r in docs.collect()}
            assert {4, 5, 6, 7} <= kept and not kept & {1, 2, 3, 8}
        else:
            assert docs.count() == 0
