"""Running sums, ranks and quantiles of large groups; sparse features and averaged descent."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, models, ranges, sparse
from tidemark.operators.contracts import ContractError
from tidemark.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def grouped():
    rng = random.Random(1)
    return [(rng.choice(["one", "one", "one", None, "b"]), i, rng.choice([None, 1.0, 2.5, rng.gauss(0, 9)])) for i in range(2_000)] + [("single", 9_999, 4.0), ("empty", 9_998, None)]


def test_running_sums_and_ranks_equal_brute_force(spark, grouped):
    df = spark.createDataFrame(grouped, "g string, k long, v double").repartition(5)
    rows = sorted(grouped, key=lambda r: (r[0] or "", r[1]))
    for descending in (False, True):
        got = {(r.g, r.k): (r.s, r.v1) for r in ranges.running(df.withColumn("v", F.coalesce("v", F.lit(0.0))), ["g"], ["k"], {"v": "s"}, descending=descending).collect()}
        by = defaultdict(list)
        for g, k, v in reversed(rows) if descending else rows:
            by[g].append((k, v or 0.0))
        for g, own in by.items():
            sums = np.cumsum([v for _, v in own])
            for i, (k, _) in enumerate(own):
                assert got[g, k][0] == pytest.approx(sums[i]) and got[g, k][1] == (own[i + 1][1] if i + 1 < len(own) else None)
    places = {(r.g, r.k): r.p for r in ranges.ranked(df, ["g"], ["k"], "p").collect()}
    assert all(places[g, k] == i + 1 for g in by for i, (k, _) in enumerate(sorted(by[g])))


def test_quantiles_equal_percentile(spark, grouped):
    df = spark.createDataFrame(grouped, "g string, k long, v double").repartition(5)
    probs = {"a": 0.0, "b": 0.025, "c": 1 / 3, "d": 0.5, "e": 1.0}
    want = {r[0]: r[1] for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, probs.values())))).collect() if r[1]}
    got = {r.g: [r[n] for n in probs] for r in ranges.quantiles(df, ["g"], "v", probs).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want)
    assert ranges.quantiles(df, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(df.agg(F.median("v")).first()[0])


def test_a_group_of_all_rows_is_many_tasks(spark):
    df = spark.range(200_000).select(F.lit("all").alias("g"), F.xxhash64("id").alias("h"), (F.col("id") % 1_000).cast("double").alias("v"))
    tasks = [r["n"] for r in ranges.ranked(df, ["g"], ["h"], "place").groupBy(F.floor(F.col("place") / 50_000.5).alias("quarter"), F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(tasks) > 1 and sum(tasks) == 200_000 and max(tasks) < 200_000
    assert ranges.quantiles(df, ["g"], "v", {"m": 0.5, "q": 0.9}).first()[1:] == pytest.approx((499.5, 899.1))


def test_curve_of_groups_equals_each_group_alone(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.choice("xy"), round(rng.random(), 2), rng.randint(0, 1)) for _ in range(900)], "g string, s double, y int")
    both = {r.g: r[1:] for r in metrics.ranking(df, ["g"], "s", "y").collect()}
    for g in "xy":
        assert tuple(both[g]) == pytest.approx(tuple(metrics.ranking(df.where(F.col("g") == g), [], "s", "y").first()))


def test_classical_sets(spark):
    rows = [(1, "ATGGCCTAA"), (2, "acgtnacg"), (3, ""), (4, "ATGATGATGAAA")]
    df = spark.createDataFrame(rows, "id long, seq string")
    sets = {(r.id, r.representation): dict(zip(r.indices, r["values"], strict=True)) for r in sparse.classical_sets(df.select("id"), df, "id", "seq").collect()}
    assert len(sets) == 24 and sets[1, "length_gc"] == {0: 9.0, 1: pytest.approx(4 / 9)}
    codons = [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT"]
    found = sets[4, "codon_67"]
    assert found[codons.index("ATG")] == 0.75 and found[codons.index("AAA")] == 0.25 and len(found) == 5 and list(found) == sorted(found)
    assert sets[3, "codon_67"] == {64: 0.0, 65: 0.0, 66: 0.0} and sets[3, "kmer_1_6"] == {}
    want = {}
    at = 0
    for k in range(1, 7):
        n = Counter(s for i in range(len("ACGTNACG") - k + 1) if "N" not in (s := "ACGTNACG"[i : i + k]))
        for s, c in n.items():
            want[at + int("".join(str("ACGT".index(x)) for x in s), 4)] = c / sum(n.values())
        at += 4**k
    assert sets[2, "kmer_1_6"] == pytest.approx(want)
    with pytest.raises(ContractError):
        sparse.classical_sets(spark.createDataFrame([(9,)], "id long"), df, "id", "seq")


def test_scaled_without_centring(spark):
    rows = [(0, [0, 2], [2.0, 1.0]), (1, [2], [3.0]), (2, [0, 1], [4.0, 5.0]), (3, [0, 1, 2], [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, indices array<int>, values array<double>")
    dense = np.zeros((4, 4))
    for i, at, v in rows:
        dense[i, at] = v
    sd = dense[:3].std(0)
    sd[sd == 0] = 1
    for r in sparse.scaled(df, F.col("id") < 3, 4).collect():
        assert r["values"] == pytest.approx((dense[r.id] / sd)[r.indices].tolist())


@pytest.fixture(scope="module")
def classes(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(2.5 * (i % 3 == k), 1) for k in range(3)] + [rng.gauss(0, 1)], "abc"[i % 3] if i % 9 else "a") for i in range(1_200)]
    return spark.createDataFrame(rows, "id int, values array<double>, c string").withColumn("indices", F.sequence(F.lit(0), F.lit(3))).cache()


def test_averaged_descent_depends_on_rows_alone(spark, classes):
    train = F.col("id") % 4 != 0
    fits = [sparse.averaged_sgd(d, "id", "c", train, 4, shard=200, epochs=4)[0] for d in (classes.repartition(1), classes.repartition(7), classes.orderBy(F.desc("id")))]
    assert np.allclose(fits[0], fits[1], rtol=1e-9, atol=1e-12) and np.allclose(fits[0], fits[2], rtol=1e-9, atol=1e-12)
    one_shard = sparse.averaged_sgd(classes, "id", "c", train, 4, epochs=4)[0]
    assert not np.allclose(one_shard, fits[0])


def test_averaged_descent_against_the_multinomial(spark, classes):
    train = F.col("id") % 4 != 0
    right = lambda out: out.where(~train).agg(F.avg((F.col("predicted") == F.col("c")).cast("int"))).first()[0]
    ours = right(sparse.class_scores(classes, *sparse.averaged_sgd(classes, "id", "c", train, 4)))
    theirs = right(models.multiclass(classes, "values", "c", train))
    assert ours > 0.8 and ours > theirs - 0.03


def test_averaged_descent_odd_rows(spark):
    empty = spark.createDataFrame([], "id int, c string, indices array<int>, values array<double>")
    model, labels = sparse.averaged_sgd(empty, "id", "c", F.lit(True), 3)
    assert model.shape == (4, 0) and labels == []
    rows = spark.createDataFrame([(1, "x", [], []), (2, "y", [0], [1.0]), (3, "y", [0], [1.0])], "id int, c string, indices array<int>, values array<double>")
    out = sparse.class_scores(rows, *sparse.averaged_sgd(rows, "id", "c", F.lit(True), 3, epochs=30, penalty=1e-6)).collect()
    assert {r.id: r.predicted for r in out} == {1: "x", 2: "y", 3: "y"}


def test_penalties_share_their_passes(spark, sf, classes):
    """Models fitted together are those fitted alone, one that stops early too; the query that fits two makes few jobs."""
    train = F.col("id") % 4 != 0
    together, labels = sparse.averaged_sgds(classes, "id", "c", train, 4, (1e-4, 1.0), shard=200, epochs=6, tolerance=0.05)
    for penalty, model in zip((1e-4, 1.0), together, strict=True):
        alone = sparse.averaged_sgd(classes, "id", "c", train, 4, penalty=penalty, shard=200, epochs=6, tolerance=0.05)
        assert labels == alone[1] == ["a", "b", "c"] and np.allclose(model, alone[0], rtol=1e-9, atol=1e-12)
    spark.sparkContext.setJobGroup("sparse", "")
    assert QUERIES["l04_sparse_logistic"](spark, sf).count() == 1
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("sparse"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 80, jobs


def test_class_scores_of_rows_in_slices(spark):
    rows = [(i, [p for p in range(5) if (i >> p) & 1], [float(i + p) for p in range(5) if (i >> p) & 1]) for i in range(1_200)]
    model = np.arange(18.0).reshape(6, 3) - 7
    got = sparse.class_scores(spark.createDataFrame([*rows, (-1, None, None)], "id int, indices array<int>, values array<double>").repartition(1), model, ["a", "b", "c"]).collect()
    want = {i: model[at].T @ np.array(v) + model[-1] if at else model[-1] for i, at, v in [*rows, (-1, [], [])]}
    assert len(got) == 1_201 and all(np.allclose(r.logits, want[r.id]) for r in got)


def test_random_features_repeat(spark):
    df = spark.range(3_000)
    a = {r.id: r.f for r in models.random_features(df, "id", 3, 1, "f").collect()}
    b = {r.id: r.f for r in models.random_features(df.repartition(9), "id", 3, 1, "f").collect()}
    x = np.array(list(a.values()))
    assert a == b and abs(x.mean()) < 0.05 and abs(x.std() - 1) < 0.05 and abs(np.corrcoef(x.T)[0, 1]) < 0.06
