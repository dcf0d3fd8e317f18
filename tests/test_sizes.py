"""Operators over many blocks, and what they hold and shuffle."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import graph, matrix, models, ood, sequences, shared, similarity, sparse, splits, stats
from tidemark.plans.catalog import QUERIES


def test_similarity_over_many_blocks(spark, monkeypatch):
    """Blocks of a few records and steps of one give what one block gives; letters beyond the bases, too."""
    rng = random.Random(5)
    base = ["".join(rng.choice("ACGTN") for _ in range(120)) for _ in range(3)] + ["".join(chr(rng.randrange(300, 900)) for _ in range(120))]
    seqs = [base[i % 4][: 120 - i % 7] + "".join(rng.choice("ACGT") for _ in range(i % 5)) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, s string")

    def found():
        near = similarity.nearest(df.where("id % 3 = 0"), df.where("id % 3 > 0"), "id", "s", hits=3).collect()
        return sorted(near, key=lambda r: (r.id, r.place)), sorted(similarity.clusters(df, "id", "s").collect())

    whole = found()
    assert len(whole[0]) == 14 * 3 and {r.representative for r in whole[1]} == {0, 1, 2, 3}
    for name, value in (("LETTERS", 900), ("RECORDS", 9), ("ROWS", 1), ("MET", 50)):
        monkeypatch.setattr(similarity, name, value)
    assert found() == whole


def test_kmer_totals_are_those_of_the_spectrum(spark):
    df = spark.createDataFrame([(1, "ACGTNACG"), (2, None), (3, "AC"), (4, "")], "id int, s string")
    per = sequences.kmer_spectrum(df, "id", "s", range(1, 4)).groupBy("k", "kmer").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("records"), F.avg("share").alias("mean_share"))
    rows = lambda d: {(r.k, r.kmer): (r.n, r.records, round(r.mean_share, 12)) for r in d.collect()}
    assert rows(sequences.kmer_totals(df, "s", range(1, 4))) == rows(per)


def test_kmer_counts_in_slices(spark, monkeypatch):
    """A batch is cut in slices of RECORDS records; slices of a few give what one gives."""
    df = spark.range(0, 30, 1, 1).select("id", F.expr("substring('ACGTNACGGT', cast(id % 7 as int), 6)").alias("s"))
    rows = lambda: sorted((r.id, r.k, r.kmers, r.counts) for r in sequences.kmer_counts(df, "id", "s", range(1, 3)).collect())
    whole = rows()
    monkeypatch.setattr(sequences, "RECORDS", 7)
    assert len(whole) == 60 and rows() == whole


def test_codon_rows(spark):
    df = spark.createDataFrame([(1, "ACGACGTTTNAAG"), (2, None)], "id int, s string")
    got = {r.id: (r.indices, r.values) for r in sparse.codon_rows(df, "id", "s").collect()}
    assert got[1] == ([6, 63, 64, 65, 66], [2 / 3, 1 / 3, 1 / 4, 2 / 4, 2 / 4]) and got[2] == ([64, 65, 66], [0.0, 0.0, 0.0])


def test_permuted_labels_keep_the_old_one(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], i % 3) for i in range(60)], "k int, y string, g int")
    got = models.permuted_labels(df, "k", "y", "g", 3, keep="was").collect()
    assert {r.k: r.was for r in got} == {i: "ab"[i % 2] for i in range(60)}
    assert sorted((r.g, r.y) for r in got) == sorted((i % 3, "ab"[i % 2]) for i in range(60)) and any(r.y != r.was for r in got)


def test_a_selection_of_nothing_is_empty(spark):
    assert splits.exact_selection(spark.createDataFrame([(1, 2)], "k int, n long"), "k", "n", [0], 1).collect() == []


def test_steps_of_components_hold_little_in_a_task(spark):
    """240,000 edges of seven hubs: a task of a step holds under 400 MB of them."""
    store = spark._jsparkSession.sparkContext().statusStore()
    listed = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    stages = lambda: (lambda found: [found.apply(i) for i in range(found.size())])(listed())
    before = {s.stageId() for s in stages()}
    edges = spark.range(240_000).selectExpr("10000000 + id % 7 AS src", "id AS dst")
    got = graph.connected_components(edges).groupBy("component").count().collect()
    assert sorted(r.component for r in got) == list(range(7)) and sum(r["count"] for r in got) == 240_007
    peak = max(s.peakExecutionMemory() / max(1, s.numCompleteTasks()) for s in stages() if s.stageId() not in before)
    assert peak < 400 << 20, peak


def test_degrees_are_counted_in_tasks_of_bounded_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 1000)
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert QUERIES["g03_degree_summary"](spark, sf).rdd.getNumPartitions() == 1 + n // 1000 > 4


def test_only_rows_below_the_cap_are_ranked(spark):
    """Rows whose first digits of the hash stand beyond the cap go before the ranking; the rows kept are those of all ranks."""
    df = spark.range(20_000).selectExpr("id AS k", "id % 2 AS g")
    got = splits.capped(df, ["g"], "k", 5, 3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"row_number\(\).*< 5\b", plan, re.S), plan
    whole = splits.placed(df, ["g"], "k", 3).where("place <= 5")
    assert got.count() == 10 and sorted(got.select("g", "k", "place").collect()) == sorted(whole.select("g", "k", "place").collect())


def test_nested_models_share_their_passes(spark):
    """All models come from a few passes, and are what each one gives fitted by itself."""
    rng = random.Random(9)
    rows = [(float(rng.random() < 0.4), rng.gauss(0, 1), rng.gauss(2, 1), rng.choice("abc"), rng.choice("pq")) for _ in range(600)]
    df = spark.createDataFrame(rows, "y double, x double, z double, c string, k string")
    spark.sparkContext.setJobGroup("ladder", "")
    got = stats.nested_models(df, "y", {"M0": (["x"], []), "M1": (["x", "z"], ["c"])}, category="k", sensitivity=F.col("x") > 0).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("ladder"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    alone = {"M0": (df, ["x"], []), "M1": (df, ["x", "z"], ["c"]), "M2": (df, ["x", "z"], ["c", "k"]), "M3": (df.where("x > 0"), ["x", "z"], ["c", "k"])}
    for name, (d, n, k) in alone.items():
        want = [(r.term, *(round(v, 6) for v in (r.beta, r.se, r.p))) for r in stats.logistic(d, "y", n, k).collect()]
        assert [(r.term, *(round(v, 6) for v in (r.beta, r.se, r.p))) for r in got if r.model == name] == want
    assert jobs < 40, jobs


def test_specificity_with_ties_and_rows_without_a_group(spark):
    """Of equal means the first name is dominant, however rows are dealt; rows without a group count as one, as in the SQL."""
    rows = [(k, g, float(v)) for k in range(40) for g, v in (("A", 1), ("N", 2), ("N", 4), ("R", 3))] + [(50, None, 8.0), (50, "A", 4.0), (50, "N", 4.0)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    for d in (df.repartition(7), df.orderBy("g"), df.orderBy(F.desc("g"))):
        got = {r.id: r for r in matrix.entropy_specificity(d, "id", "g", "v").collect()}
        assert all(got[k].dominant == "N" for k in range(40))
        assert (got[50].n_groups, got[50].dominant, got[50].dominant_share) == (3, "A", 0.5)


def test_nearest_cosine_over_many_blocks(spark, monkeypatch):
    """Blocks meet in tasks of their own without a shuffle of pairs; what comes out is brute force, also for fewer rows than k."""
    rng = np.random.default_rng(7)
    m = rng.normal(size=(300, 5)).astype(np.float32)
    m[10] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<float>")
    unit = m.astype(float) / np.maximum(np.linalg.norm(m.astype(float), axis=1, keepdims=True), 1e-300)
    monkeypatch.setattr(ood, "TILE", 7)
    for known, k in ((range(100, 300), 10), (range(296, 300), 10)):
        found = ood.nearest_cosine(df.where("id < 100"), df.where(F.col("id") >= known[0]), "id", "v", k=k, block=30)
        want = 1 - np.sort(unit[:100] @ unit[known[0] :].T, axis=1)[:, -k:].mean(1)
        got = {r.id: r.knn_cosine for r in found.collect()}
        assert len(got) == 100 and all(abs(got[i] - want[i]) < 1e-12 for i in range(100))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Window" not in plan
    assert ood.nearest_cosine(df.where("id < 100"), df.where("id > 900"), "id", "v").count() == 0


def _shuffled(spark, run) -> int:
    """Bytes that a run writes to be shuffled."""
    written = lambda: spark._jsparkSession.sparkContext().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    run()
    return written() - before


def test_nearest_records_shuffle_no_pairs_of_blocks(spark, monkeypatch):
    """Many blocks shuffle about what few do, and all pairs still meet; k-mers of 64 bits, too."""
    rng = random.Random(8)
    seqs = ["".join(rng.choice("ACGT") for _ in range(1_500)) for _ in range(20)]
    seqs = [s[i : i + 1_000] + "".join(rng.choice("ACGT") for _ in range(500)) for s in seqs for i in (0, 200, 400)]
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, s string").cache()
    run = lambda k=12: sorted(map(tuple, similarity.nearest(df.where("id % 3 = 0"), df.where("id % 3 > 0"), "id", "s", k=k, hits=2).collect()))
    one = _shuffled(spark, run), run(), run(20)
    monkeypatch.setattr(similarity, "LETTERS", 6_000)
    many = _shuffled(spark, run), run(), run(20)
    assert many[1:] == one[1:] and many[0] < 3 * one[0] + 100_000, (one[0], many[0])
    assert {(r[0], r[2]) for r in one[2]} == {(i, i + j) for i in range(0, 60, 3) for j in (1, 2)}


def test_clusters_shuffle_no_pairs_of_blocks(spark, monkeypatch):
    """Many blocks shuffle about what few do; records of few different k-mers among long ones keep their links."""
    rng = random.Random(9)
    base = ["".join(rng.choice("ACGT") for _ in range(1_500)) for _ in range(20)]
    seqs = [s[: len(s) - 40 * i] for s in base for i in range(3)] + ["AC" * 400, "AC" * 700, "AC" * 7 + "G", base[0][:15], base[0][:700] * 2]
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, s string").cache()
    run = lambda k=12: sorted(map(tuple, similarity.clusters(df, "id", "s", k=k).collect()))
    one = _shuffled(spark, run), run(), run(20)
    monkeypatch.setattr(similarity, "LETTERS", 4_000)
    many = _shuffled(spark, run), run(), run(20)
    assert many[1:] == one[1:] and many[0] < 3 * one[0] + 100_000, (one[0], many[0])
    sets = [{s[i : i + 12] for i in range(len(s) - 11)} for s in seqs]
    comp = list(range(len(seqs)))
    for a in range(len(seqs)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and n / len(sets[a] | sets[b]) >= 0.3 and n >= 0.8 * min(len(sets[a]), len(sets[b])):
                x, y = comp[a], comp[b]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
    assert {m: c for c, m in one[1]} == dict(enumerate(comp))
