"""Bootstrap of continuous scores in ranges, and vector indexes by file and row."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import inference, metrics, stats


def rows(ties: bool):
    rng = random.Random(5)
    return [(f"g{rng.randrange(40)}", rng.randint(0, 1), rng.randrange(25) / 3 if ties else rng.random()) for _ in range(1_500)] + [("g0", 1, None)]


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("together", [7, 256])
def test_weighted_auroc_equals_brute_force(spark, monkeypatch, ties, together):
    monkeypatch.setattr(stats, "TOGETHER", together)
    df = spark.createDataFrame(rows(ties), "g string, y int, s double")
    got = {r.r: r.auroc for r in stats.weighted_auroc(df.repartition(6), "g", "s", "y", 30).collect()}
    hashes = {r.g: r.h for r in df.select("g", F.xxhash64("g", F.lit(0)).alias("h")).distinct().collect()}
    draws = {g: np.random.Generator(np.random.Philox(h & 0x7FFFFFFFFFFFFFFF)).poisson(1, 30) for g, h in hashes.items()}
    seen = [x for x in rows(ties) if x[2] is not None]
    y, s, w = np.array([x[1] for x in seen]), np.array([x[2] for x in seen]), np.stack([draws[x[0]] for x in seen]).astype(float)
    wins = (s[y == 1][:, None] > s[y == 0][None]) + 0.5 * (s[y == 1][:, None] == s[y == 0][None])
    for r in range(30):
        p, n = w[y == 1, r], w[y == 0, r]
        assert got[r] == pytest.approx(p @ wins @ n / p.sum() / n.sum(), rel=1e-12)


def test_weights_of_one_are_the_plain_auroc(spark, monkeypatch):
    """With every weight 1 each replicate is the AUROC of the rows."""
    df = spark.createDataFrame(rows(True), "g string, y int, s double").where("s IS NOT NULL")
    plain = metrics.ranking(df, [], "s", "y").first()["auroc"]
    many = stats.weighted_auroc(df.withColumn("g", F.monotonically_increasing_id()), "g", "s", "y", 300).agg(F.avg("auroc")).first()[0]
    assert abs(many - plain) < 0.01


def test_weighted_auroc_odd_rows(spark):
    schema = "g string, y int, s double"
    assert {r.auroc for r in stats.weighted_auroc(spark.createDataFrame([], schema), "g", "s", "y", 3).collect()} <= {None}
    assert {r.auroc for r in stats.weighted_auroc(spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.7)], schema), "g", "s", "y", 3).collect()} == {None}


def test_index_leads_back_to_the_vector(spark, tmp_path):
    path = str(tmp_path / "vectors")
    df = spark.range(1_000).select(F.col("id").cast("string").alias("id"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (i * F.col("id")).cast("float")).alias("v"), (F.col("id") % 3).alias("shard"))
    df.repartition(4).write.option("maxRecordsPerFile", 60).partitionBy("shard").parquet(path)
    index = inference.vector_index(spark, path, "id", "v", representation="x", revision="r1")
    assert index.columns == ["id", "representation", "revision", "shard", "row", "dimension", "dtype"]
    facts = index.agg(F.count(F.lit(1)), F.countDistinct("shard", "row"), F.max("row"), F.max("dimension"), F.max("dtype")).first()
    assert facts[0] == facts[1] == 1_000 and facts[2] == 59 and facts[3:] == (4, "float")
    back = inference.looked_up(spark, path, index.where("id IN ('17', '999')"), "id", "v").collect()
    assert sorted((r.id, r.stored_key, r.v[0]) for r in back) == [("17", "17", 17.0), ("999", "999", 999.0)]
