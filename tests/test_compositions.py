"""Properties of queries that have no SQL, and contracts on results and published numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import contracts, inference, stats
from tidemark.plans import pipelines
from tidemark.plans.catalog import QUERIES


def test_nested_models_ladder(spark, sf):
    rows = QUERIES["e02_nested_models"](spark, sf).collect()
    by = {}
    for r in rows:
        by.setdefault(r.model, {})[r.term] = r
    assert list(sorted(by)) == [f"M{i}" for i in range(7)]
    assert len({r.n for m, terms in by.items() if m != "M6" for r in terms.values()}) == 1
    assert all(terms.keys() >= {"l_discount", "intercept"} for terms in by.values())
    assert [len(by[f"M{i}"]) for i in range(4)] == [2, 3, 4, 5] and len(by["M4"]) == 6 < len(by["M5"])
    assert all(r.low <= r.odds_ratio <= r.high and 0 <= r.p <= 1 and math.isclose(r.odds_ratio, math.exp(r.beta)) for r in rows if not math.isinf(r.high))


def test_group_comparison_query(spark, sf):
    r = QUERIES["q06_group_comparison"](spark, sf).first()
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    mean, sd, n = line.where("l_returnflag = 'R'").agg(F.avg("l_quantity"), F.stddev("l_quantity"), F.count(F.lit(1))).first()
    assert r["low"] < mean < r["high"] and abs(r["mean"] - mean) < sd / math.sqrt(n) and r["replicates"] == 500
    assert r["n1"] == line.where("l_returnflag = 'A'").count() and r["n2"] == n and -1 <= r["cliffs_delta"] <= 1 and r["odds_ratio"] > 0


def test_composition_regression_query(spark, sf):
    got = {r.term: r for r in QUERIES["q09_composition_regression"](spark, sf).collect()}
    line = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_suppkey", "l_returnflag").count().toPandas().pivot(index="l_suppkey", columns="l_returnflag", values="count").fillna(0)
    p = line.div(line.sum(1), axis=0).to_numpy()
    y = -np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0).sum(1)
    slope, intercept = np.polyfit(line.sum(1), y, 1)
    assert got["n"].beta == pytest.approx(slope, rel=1e-6) and got["intercept"].beta == pytest.approx(intercept, rel=1e-6) and got["n"].low < slope < got["n"].high


def test_table_digest_tells_tables_apart(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    digest = lambda df: tuple(contracts.table_digest(df).first())
    whole = digest(line)
    assert whole == digest(line.repartition(7)) and str(whole[1]) == QUERIES["v16_table_digest"](spark, sf).first()["digest"]
    changed = line.withColumn("l_tax", F.when(F.col("l_orderkey") == line.agg(F.min("l_orderkey")).first()[0], 0.99).otherwise(F.col("l_tax")))
    assert digest(changed)[1] != whole[1] and digest(line.unionByName(line.limit(1)))[0] == whole[0] + 1


def test_mock_embeddings(spark, sf):
    rows = {r.doc_id: r.embedding for r in QUERIES["i02_mock_embedding"](spark, sf).collect()}
    again = {r.doc_id: r.embedding for r in QUERIES["i02_mock_embedding"](spark, sf).orderBy(F.desc("doc_id")).collect()}
    x = np.array(list(rows.values()))
    assert rows == again and x.shape == (len(rows), 16) and len({tuple(v) for v in rows.values()}) == len(rows)
    assert x.min() >= -1 and x.max() < 1 and abs(x.mean()) < 0.05 and abs(x.std() - 1 / math.sqrt(3)) < 0.02


def test_results_contract(spark):
    schema = "task string, method string, seed int, metric double"
    good = [(t, m, s, 0.5) for t in "ab" for m in "xy" for s in range(2)]
    cohort = spark.createDataFrame([(t, k) for t in "ab" for k in range(3)], "task string, k int")
    predictions = [(t, m, k) for t in "ab" for m in "xy" for k in range(3)]
    check = lambda rows, p=predictions, tasks=("a", "b"): {r.check: r.observed for r in contracts.metric_table(spark.createDataFrame(rows, schema), "task", "method", "seed", "metric", tasks=list(tasks), seeds=2, predictions=spark.createDataFrame(p, "task string, method string, k int"), cohort=cohort, key="k").collect() if not r.passed}
    assert check(good) == {}
    assert check(good[1:]) == {"other_seeds": 1}
    assert check([*good, good[0]]) == {"other_seeds": 1}
    assert check([("a", "x", 0, None), ("a", "x", 1, float("inf")), *good[2:]]) == {"not_finite": 2}
    assert check(good, tasks="abc") == {"missing_tasks": 2}
    assert check(good, tasks="a") == {"unknown_tasks": 4}
    assert check(good, predictions[1:]) == {"missing_predictions": 1}
    assert check(good, [*predictions, predictions[0], ("a", "x", 9)]) == {"repeated_predictions": 1, "unknown_predictions": 1}


def test_published_numbers(spark):
    funnel = lambda *rows: spark.createDataFrame(list(rows), "every int, broad int, strict int")
    intervals = spark.createDataFrame([("K", 1.0, 2.0, 3.0), ("E", 2.0, 2.0, 3.0), ("N", None, 1.0, 2.0)], "g string, low double, estimate double, high double")
    check = lambda f, i, need: {r.check: r.observed for r in contracts.published_numbers(f, ["every", "broad", "strict"], i, "g", need).collect() if not r.passed}
    assert check(funnel((9, 9, 1)), intervals.where("g = 'K'"), ["K"]) == {}
    assert check(funnel((9, 8, 0), (9, 10, 1), (9, 3, 4), (9, None, 1), (3, 2, 1)), intervals, ["K", "GU"]) == {"funnel_order": 4, "estimate_outside": 2, "missing_groups": 1}


def test_group_comparison_of_no_rows(spark):
    rows = spark.createDataFrame([("F", 1, 1, "K", 0.5, True), ("F", 2, 1, "DISC", 0.5, True)], "fraction string, known int, unknown int, category string, r2 double, env boolean")
    assert pipelines.group_comparison(rows, "fraction", "known", "unknown", "category", "DISC", "r2", ["env"]).count() == 0


def test_windowed_embedding_odd_texts(spark):
    df = spark.createDataFrame([(1, "ab" * 10), (2, ""), (3, None), (4, "a\nb"), (5, "😀" * 7)], "id int, t string")
    lengths = lambda: lambda texts: [[float(len(x)), 1.0] for x in texts]
    got = {r.id: (r.windows, r.embedding) for r in inference.embed_windowed(df, "id", "t", lengths, width=8, shards=2).collect()}
    assert got == {1: (3, [pytest.approx((64 + 64 + 16) / 20), 1.0]), 4: (1, [3.0, 1.0]), 5: (1, [7.0, 1.0])}


def test_least_squares_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 2))
    y = 1 + x @ [2.0, -1.0] + rng.standard_normal(200) * 0.1
    fit = stats.ols(spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double"), "y", ["a", "b"])
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert [fit[k]["beta"] for k in ("intercept", "a", "b")] == pytest.approx(want.tolist())
