from __future__ import annotations

import hashlib
import io
import math
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing, labels, vectors
from tidemark.operators import contracts, graph, inference, mapping, metrics, models, ood, packages, sequences, similarity, splits, stats
from tidemark.sources import scans, sinks, streams


def one(df):
    return df.first().asDict()


def test_function_flags(spark):
    df = spark.createDataFrame([("K", "NA", "K00001", "-"), ("GU", "NA", "-", "-"), ("SINGL", "EU", "", "NA")], "cat string, single string, ko string, pf string")
    rows = df.select(*(c.alias(k) for k, c in labels.function_flags(["ko", "pf"], "cat", "single").items())).collect()
    assert [r.strict_known for r in rows] == [True, False, False]
    assert [r.strict_unknown for r in rows] == [False, True, True]


def test_hashes_equal_hashlib(spark):
    r = one(spark.createDataFrame([("gene-a",)], "k string").select(hashing.stable_hash(F.col("k"), 3).alias("h"), hashing.bucket(F.col("k"), 32).alias("b"), hashing.uniform(hashing.stable_hash(F.col("k"), 3)).alias("u")))
    h = hashlib.sha256(b"3:gene-a").hexdigest()
    assert r["h"] == h and r["u"] == int(h[:16], 16) / 2**64
    assert r["b"] == int(hashlib.sha256(b"gene-a").hexdigest()[:16], 16) % 32


def test_canonical_reasons(spark):
    rows = [("a", "x", 2, True), ("a", "y", 5, False), ("b", "x", 3, False), ("b", "y", 3, False), ("c", "", 1, True), ("d", "x", 1, True), ("d", "y", 2, True), ("e", "x", 1, False), ("e", "y", 2, False)]
    out = {r.u: (r.canonical, r.reason) for r in mapping.canonical(spark.createDataFrame(rows, "u string, c string, n_rows long, has_representative boolean"), "u", "c").collect()}
    assert out == {"a": ("x", "representative_row"), "b": ("x", "lexical_tiebreak"), "c": ("", "missing_cluster"), "d": ("y", "representative_tiebreak"), "e": ("y", "largest_support")}


def test_checked_join_raises(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(contracts.ContractError):
        contracts.checked_join(a, a.distinct(), ["k"])
    assert contracts.checked_join(a, a.distinct(), ["k"], validate="many_to_one").count() == 2


def test_components_random(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, i) for i in range(2000, 2300)] + [(5000 + i, 5001 + i) for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_empty(spark):
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_nested_selection_equals_loop(spark):
    rng = random.Random(2)
    sizes = {i: rng.randrange(1, 9) for i in range(200)}
    targets = [50, 130]
    order = sorted(sizes, key=lambda k: (hashlib.sha256(f"7:{k}".encode()).hexdigest(), k))
    chosen, have = {}, 0
    for level, target in enumerate(targets):
        for k in order:
            if k not in chosen and have + sizes[k] <= target:
                chosen[k] = level
                have += sizes[k]
    got = splits.exact_selection(spark.createDataFrame(list(sizes.items()), "k int, size long"), "k", "size", targets, 7).collect()
    assert sum(sizes[r.k] for r in got if r.level == 0) == 50 and sum(sizes[r.k] for r in got) == 130
    assert {r.k: r.level for r in got} == chosen


def test_matching_is_balanced(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("xy"), rng.choice("ab")) for i in range(100)]
    out = splits.matched(spark.createDataFrame(rows, "k int, c string, l string"), ["c"], "l", ("a", "b"), "k", 1).groupBy("c").pivot("l", ["a", "b"]).count().collect()
    assert all(r.a == r.b for r in out)


def test_ranking_metrics(spark):
    df = spark.createDataFrame([(0, 0.05), (0, 0.10), (0, 0.20), (1, 0.80), (1, 0.90), (1, 0.95)], "y int, s double")
    m = one(metrics.ranking(df, [], "s", "y"))
    assert (m["auroc"], m["average_precision"], m["fpr_at_recall"]) == (1.0, 1.0, 0.0)


def test_auroc_with_ties(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(2), rng.randrange(6) / 5, rng.randrange(1, 4)) for _ in range(80)]
    got = one(metrics.ranking(spark.createDataFrame(rows, "y int, s double, w int"), [], "s", "y", F.col("w").cast("double")))["auroc"]
    pos, neg = [r for r in rows if r[0]], [r for r in rows if not r[0]]
    wins = sum(p[2] * n[2] * ((p[1] > n[1]) + 0.5 * (p[1] == n[1])) for p in pos for n in neg)
    assert abs(got - wins / sum(p[2] for p in pos) / sum(n[2] for n in neg)) < 1e-12


def test_translation(spark):
    r = one(spark.createDataFrame([("ATGGCNTAA",)], "s string").select(sequences.translated(F.col("s")).alias("p"), *(c.alias(k) for k, c in sequences.translation_quality(F.col("s")).items())))
    assert r["p"] == "MX" and r["terminal_stop"] and r["internal_stops"] == 0 and r["ambiguous_codons"] == 1


def test_windows_join_back(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, "abc"), (3, "")], "k int, s string")
    got = {}
    for r in sorted(sequences.windows(df, "k", "s", 4).collect(), key=lambda r: (r.k, r.window)):
        got[r.k] = got.get(r.k, "") + r.part
    assert got == {1: "abcdefghij", 2: "abc"}


def test_ood_scores_order(spark):
    df = spark.createDataFrame([(1, [8.0, -2.0]), (2, [0.1, 0.0])], "id int, z array<double>").select("id", ood.msp(F.col("z")).alias("a"), ood.max_logit(F.col("z")).alias("b"), ood.energy(F.col("z")).alias("c"))
    x, y = (df.where(f"id = {i}").first() for i in (1, 2))
    assert x.a < y.a and x.b < y.b and x.c < y.c


def test_vector_functions(spark):
    r = one(spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>").select(vectors.norm(F.col("a")).alias("n"), vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.median(F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0), F.lit(9.0))).alias("m")))
    assert r == {"n": 5.0, "c": 0.96, "m": 2.5}


def test_fusion(spark):
    a = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, e array<double>")
    b = spark.createDataFrame([("b", [20.0, 21.0]), ("a", [11.0, 10.0])], "id string, e array<double>")
    assert {r.id: r.e for r in models.fused(a, b, "id", "e").collect()} == {"a": [1, 11, 10], "b": [2, 20, 21]}


def test_ols(spark):
    df = spark.createDataFrame([(float(x), 3.0 + 2.0 * x) for x in range(10)], "x double, y double")
    b = stats.ols(df, "y", ["x"])
    assert abs(b["x"]["beta"] - 2) < 1e-9 and abs(b["intercept"]["beta"] - 3) < 1e-9
    assert stats.two_sided_p(0.0) == 1.0 and math.isclose(stats.two_sided_p(1.959964), 0.05, abs_tol=1e-6)


def test_resumed_embedding_skips_done(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "b"), (3, None)], "id long, text string")
    backend = lambda: lambda texts: [[float(len(t))] for t in texts]
    done = inference.embed(df.where("id = 1"), "id", "text", backend, shards=2)
    rest = inference.embed(df, "id", "text", backend, shards=2, done=done)
    assert {r.id: r.embedding for r in rest.collect()} == {2: [1.0], 3: [0.0]}


def test_fasta_and_profiles(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a one\nMP\nEP\n>b\nAA\n")
    rows = {r.id: r.seq for r in scans.fasta(spark, str(tmp_path / "x.fa")).collect()}
    assert rows == {"a": "MPEP", "b": "AA"}
    assert one(scans.sequence_profile(scans.fasta(spark, str(tmp_path / "x.fa")))) == {"sequences": 2, "residues": 6, "longest": 4, "first_id": "a", "preview": "MPEP"}
    (tmp_path / "y.fa").write_text("\n>a\nMP\n")
    assert [tuple(r) for r in scans.fasta(spark, str(tmp_path / "y.fa")).collect()] == [("a", "MP")]
    (tmp_path / "z.fa").write_text("stray\n>a\nMP\n")
    with pytest.raises(ValueError, match="first header"):
        scans.fasta(spark, str(tmp_path / "z.fa"))


def test_repaired_header(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("x\ty\nk1\t1\tNA\nk2\t2.5\t3\n")
    rows = {r.k: (r.x, r.y) for r in scans.repaired_table(spark, str(tmp_path / "t.tsv"), "k").collect()}
    assert rows == {"k1": (1.0, None), "k2": (2.5, 3.0)}
    (tmp_path / "u.tsv").write_text("x\ty\n1\t2\n1\t2\t3\n")
    with pytest.raises(ValueError):
        scans.repaired_table(spark, str(tmp_path / "u.tsv"), "k")


def test_archive_members(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        info = tarfile.TarInfo("d/m.txt")
        info.size = 2
        tar.addfile(info, io.BytesIO(b"hi"))
    r = streams.archive_members(spark, str(tmp_path)).first()
    assert (r.member, r.bytes, r.sha256) == ("d/m.txt", 2, hashlib.sha256(b"hi").hexdigest())


def test_json_status_and_files(spark, tmp_path):
    for name, text in (("a", '{"status": "PASS"}'), ("b", '{"status": "FAIL"}'), ("c", "{")):
        (tmp_path / f"{name}.json").write_text(text)
    assert {r.status: r.n for r in scans.json_status(spark, str(tmp_path)).collect()} == {"PASS": 1, "FAIL": 1, None: 1}
    assert scans.files(spark, str(tmp_path)).count() == 3
    assert hashlib.md5(b"{").hexdigest() in {r.md5 for r in streams.file_digests(spark, str(tmp_path)).collect()}


def test_sinks_refuse_and_publish(spark, tmp_path):
    df = spark.range(5)
    sinks.parquet(df, str(tmp_path / "p"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.parquet(df, str(tmp_path / "p"))
    with pytest.raises(ValueError):
        sinks.published(df, str(tmp_path / "s1"), str(tmp_path / "o1"), F.col("id") < 4)
    sinks.published(df, str(tmp_path / "s2"), str(tmp_path / "o2"), F.col("id") < 5)
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 5
    assert not (tmp_path / "s2").exists() and not (tmp_path / "o1").exists()
    with pytest.raises(FileExistsError):
        sinks.published(df, str(tmp_path / "s3"), str(tmp_path / "o2"), F.col("id") < 5)


def test_lenient_scan(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("a\tb\tc\n1\t\tx\n2\n\t\ty\tmore\n")
    assert [tuple(r) for r in scans.lenient(spark, str(tmp_path / "l.tsv"), ["a", "b", "c"]).collect()] == [("1", "", "x"), ("2", None, None), ("", "", "y")]
    assert scans.lenient(spark, str(tmp_path / "l.tsv"), ["a", "b", "c"], limit=1).count() == 1


def test_vector_shards_and_ledger(spark, tmp_path):
    path = str(tmp_path / "v")
    v = spark.createDataFrame([("a", [1.0, 2.0], 0), ("b", [3.0, 4.0], 1), ("c", [float("nan"), 1.0], 1)], "id string, embedding array<double>, shard int")
    assert sinks.vector_shards(v.where("id = 'a'"), path) == 1 and sinks.vector_shards(v, path) == 1 and sinks.vector_shards(v.where("id <> 'c'"), path) == 0
    assert {r.id: r.embedding for r in scans.vector_shards(spark, path).collect()} == {"a": [1, 2], "b": [3, 4]}
    ledger = spark.read.parquet(path + "_ledger").where("shard = 1").first()
    assert (ledger.rows, ledger.width, ledger.excluded, ledger.status) == (1, 2, 1, "DONE")
    assert ledger.checksum == sinks.shard_ledger(spark.read.parquet(path), "shard", "id", "embedding").where("shard = 1").first().checksum
    for bad in ([("d", [1.0, 2.0, 3.0], 0)], [("a", [1.0, 2.0], 7)]):
        spark.createDataFrame(bad, v.schema).write.mode("append").parquet(str(tmp_path / f"bad{bad[0][0]}"))
        with pytest.raises(ValueError):
            scans.vector_shards(spark, path, str(tmp_path / f"bad{bad[0][0]}"))


def test_manifest(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_bytes(b"hello")
    (tmp_path / "y.txt").write_bytes(b"bye")
    md5, sha = hashlib.md5(b"hello").hexdigest(), hashlib.sha256(b"hello").hexdigest()
    rows = [("right", "in", "d/x.txt", md5.upper(), sha, 5, "MIT"), ("md5 only", "in", "d/x.txt", md5, None, None, None), ("wrong sha", "in", "d/x.txt", md5, "0" * 64, 5, None), ("wrong size", "in", "y.txt", None, "", 4, None), ("absent", "in", "z.txt", None, None, None, None)]
    schema = "artifact_id string, role string, uri string, md5 string, sha256 string, size_bytes long, license string"
    for partitions in (1, 4):
        out = {r.artifact_id: r for r in packages.verify_manifest(spark, spark.createDataFrame(rows, schema).repartition(partitions), str(tmp_path)).collect()}
        assert {k: r.status for k, r in out.items()} == {"right": "PASS", "md5 only": "PASS", "wrong sha": "FAIL", "wrong size": "FAIL", "absent": "FAIL"}
        assert not out["absent"].exists and out["wrong sha"].md5_ok and out["wrong sha"].sha256_ok is False and out["md5 only"].sha256_ok is None
    with pytest.raises(ValueError):
        packages.verify_manifest(spark, spark.createDataFrame(rows[:1] * 2, schema), str(tmp_path))


def test_package_contract(spark, tmp_path):
    body = {"u1/a.txt": b"one", "u1/b.txt": b"two", "u2/a.txt": b"three"}
    with tarfile.open(tmp_path / "p.tar", "w") as tar:
        for name, x in body.items():
            info = tarfile.TarInfo(name)
            info.size = len(x)
            tar.addfile(info, io.BytesIO(x))
    digest = hashlib.sha256((tmp_path / "p.tar").read_bytes()).hexdigest()
    row = lambda k, kind: (k, kind, "p.tar", f"{k}/{kind}.txt", hashlib.sha256(body[f"{k}/{kind}.txt"]).hexdigest(), len(body[f"{k}/{kind}.txt"]), digest)
    schema = "id string, kind string, archive_path string, member_path string, original_sha256 string, original_bytes long, archive_sha256 string"
    check = lambda rows, kinds: {r.check: r.observed for r in packages.verify_packages(spark, spark.createDataFrame(rows, schema), str(tmp_path), "id", kinds).collect() if not r.passed}
    good = [row("u1", "a"), row("u1", "b"), row("u2", "a")]
    assert check(good, ["a", "b"]) == {"incomplete_kinds": 1}
    assert check(good[:2], ["a", "b"]) == {"unlisted_members": 1}
    bad = [good[0], (*good[1][:4], "0" * 64, 9, digest), good[2], ("u2", "b", "p.tar", "../b.txt", "0", 1, "f" * 64), ("u2", "b", "p.tar", "u2/b.txt", None, 1, digest)]
    assert check(bad, ["a", "b"]) == {"null_fields": 1, "repeated_keys": 1, "archives_of_several_digests": 1, "unsafe_members": 1, "missing_members": 2, "other_sizes": 1, "other_digests": 1, "other_archive_digests": 1}


def test_kmers_and_codons_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGTN") for _ in range(n)) for n in (0, 1, 2, 5, 6, 7, 300)] + [None, "ACGT" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    got = {(r.id, r.k): dict(zip(r.kmers, r.counts, strict=True)) for r in sequences.kmer_counts(df, "id", "s", range(1, 7)).collect()}
    for i, t in enumerate(texts):
        for k in range(1, 7):
            want = {}
            for at in range(len(t or "") - k + 1):
                w = t[at : at + k]
                if "N" not in w:
                    want[w] = want.get(w, 0) + 1
            assert got[i, k] == want
    shares = sequences.kmer_spectrum(df, "id", "s", range(2, 4)).groupBy("id", "k").agg(F.sum("share").alias("t")).collect()
    assert all(abs(r.t - 1) < 1e-9 for r in shares)
    codons = {r.id: r.c for r in df.select("id", sequences.codons(F.col("s")).alias("c")).collect()}
    assert all(codons[i] == [t[k : k + 3] for k in range(0, len(t) // 3 * 3, 3)] if t else codons[i] == [] for i, t in enumerate(texts))


def test_nearest_and_clusters_brute_force(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("ACGT") for _ in range(200)) for _ in range(6)]

    def near(s):
        s = list(s)
        for _ in range(rng.randrange(0, 4)):
            s[rng.randrange(len(s))] = rng.choice("ACGT")
        return "".join(s)

    seqs = [near(base[i % 6]) for i in range(60)] + ["ACG", "ACG", "", base[0], base[0]]
    sets = [{s[i : i + 12] for i in range(len(s) - 11)} for s in seqs]
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    df = spark.createDataFrame([*enumerate(seqs), (99, None)], "id int, s string")
    train = [i for i in range(len(seqs)) if i % 3]
    for first, hits in ((1, 3), (5, 1), (10**6, 4)):
        got = {}
        for r in similarity.nearest(df.where("id % 3 = 0"), df.where("id % 3 > 0"), "id", "s", first=first, growth=2, hits=hits).collect():
            got.setdefault(r.id, []).append((r.place, r.nearest, r.jaccard))
        for i in range(0, len(seqs), 3):
            want = sorted((j for j in train if sets[i] & sets[j]), key=lambda j: (-jac(sets[i], sets[j]), j))[:hits]
            assert [x[1] for x in sorted(got[i], key=lambda x: x[0] or 0)] == (want or [None])
            assert all(abs(x[2] - jac(sets[i], sets[x[1]])) < 1e-12 for x in got[i] if want)
    comp = list(range(len(seqs)))
    for a in range(len(seqs)):
        for b in range(a):
            if seqs[a] == seqs[b] or (jac(sets[a], sets[b]) >= 0.3 and len(sets[a] & sets[b]) >= 0.8 * min(len(sets[a]), len(sets[b]))):
                x, y = comp[a], comp[b]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
    assert {r.member: r.representative for r in similarity.clusters(df, "id", "s").collect()} == dict(enumerate(comp))
    assert hashing.group_id(F.lit("a"))._jc.toString() and spark.range(1).select(hashing.group_id(F.lit("a")).alias("g")).first().g == "GROUP_" + hashlib.sha256(b"a").hexdigest()[:16]


def test_clusters_lose_no_link_to_hubs(spark):
    """Pairs whose shared k-mers are all held by many other records that come first in every order, too."""
    rng = random.Random(21)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    seqs = []
    for _ in range(12):
        shared = letters(90)
        seqs += [letters(8) + shared + letters(8), letters(8) + shared + letters(8)]
        seqs += [letters(150) + shared[i : i + 30] + letters(150) for i in range(0, 61, 6) for _ in range(3)]  # hubs hold parts of it only
    sets = [{s[i : i + 12] for i in range(len(s) - 11)} for s in seqs]
    comp = list(range(len(seqs)))
    for a in range(len(seqs)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and n / len(sets[a] | sets[b]) >= 0.3 and n >= 0.8 * min(len(sets[a]), len(sets[b])):
                x, y = comp[a], comp[b]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
    assert len(set(comp)) < len(comp)
    assert {r.member: r.representative for r in similarity.clusters(spark.createDataFrame(list(enumerate(seqs)), "id int, s string"), "id", "s").collect()} == dict(enumerate(comp))


def test_ranged_curve_equals_grouped(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(rng.randrange(2), rng.randrange(400) / 7, 1) for _ in range(3000)], "y int, s double, g int")
    whole, grouped = one(metrics.ranking(df, [], "s", "y")), one(metrics.ranking(df, ["g"], "s", "y"))
    assert all(abs(whole[k] - grouped[k]) < 1e-12 for k in whole)
    assert one(metrics.best_threshold(df, [], "s", "y")) == {k: v for k, v in one(metrics.best_threshold(df, ["g"], "s", "y")).items() if k != "g"}


def test_logistic_recovers_coefficients(spark):
    rng = random.Random(12)
    rows = []
    for i in range(6000):
        x, z, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.choice("ab")
        p = 1 / (1 + math.exp(-(0.5 + 1.2 * x - 0.7 * z + (0.8 if c == "b" else 0))))
        rows.append((float(rng.random() < p), x, z, c, f"k{i % 30}", None if i % 50 == 0 else rng.random()))
    df = spark.createDataFrame(rows, "y double, x double, z double, c string, k string, w double")
    b = {r.term: r for r in stats.logistic(df, "y", ["x", "z"], ["c"]).collect()}
    assert all(abs(b[t].beta - v) < 4 * b[t].se for t, v in (("x", 1.2), ("z", -0.7))) and abs(abs(b[next(t for t in b if t.startswith("c_"))].beta) - 0.8) < 0.3
    ladder = stats.nested_models(df, "y", {"M0": (["x"], []), "M1": (["x", "z", "w"], ["c"])}, category="k", top=5, sensitivity=F.col("x") > 0)
    n = {(r.model, r.n) for r in ladder.select("model", "n").distinct().collect()}
    complete = df.dropna()
    assert n == {("M0", complete.count()), ("M1", complete.count()), ("M2", complete.count()), ("M3", complete.where("x > 0").count())}
    assert ladder.where("model = 'M2' AND term LIKE 'k_%'").count() == 5


def test_bootstraps(spark):
    rng = random.Random(14)
    values = [float(rng.randrange(50)) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    r = one(stats.bootstrap_mean(df, "v", 400))
    mean = sum(values) / len(values)
    se = (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5 / len(values) ** 0.5
    assert r["replicates"] == 400 and abs(r["mean"] - mean) < se and 3.3 * se < r["high"] - r["low"] < 4.6 * se
    assert one(stats.bootstrap_mean(df.repartition(7), "v", 400))["low"] == pytest.approx(r["low"])
    rows = [(g, int(rng.random() < 0.5), rng.randrange(20)) for g in range(60) for _ in range(20)]
    paired = spark.createDataFrame([(g, y, y * 6.0 + n, float(rng.randrange(20))) for g, y, n in rows], "g int, y int, a double, b double")
    out = stats.paired_bootstrap(paired, "g", "a", "b", "y", 200, least=100)
    s = out.agg(F.avg("delta").alias("m"), F.stddev("delta").alias("d"), F.count("delta").alias("n")).first()
    whole = one(metrics.ranking(paired, [], "a", "y"))["auroc"] - one(metrics.ranking(paired, [], "b", "y"))["auroc"]
    assert s.n == 200 and abs(s.m - whole) < 0.3 * s.d + 0.005 and 0.005 < s.d < 0.06
    same = stats.paired_bootstrap(paired.withColumn("b", F.col("a")), "g", "a", "b", "y", 50)
    assert same.where("delta <> 0").count() == 0
    with pytest.raises(ValueError):
        stats.paired_bootstrap(paired.where("y = 1"), "g", "a", "b", "y", 20, least=1)


def test_run_summary(spark):
    df = spark.createDataFrame([(0, "auroc", 0.6), (1, "auroc", 0.8), (0, "ap", 0.5), (1, "ap", 0.5)], "run int, metric string, value double")
    out = {r.metric: r for r in stats.run_summary(df, "run", ["metric"], "value").collect()}
    assert abs(out["auroc"].mean - 0.7) < 1e-12 and out["auroc"].least == 0.6 and out["auroc"].low == 0.6 and out["auroc"].high == 0.8 and out["ap"].low == out["ap"].high == 0.5
    for bad in (df.where("run = 0"), df.where("NOT (run = 1 AND metric = 'ap')")):
        with pytest.raises(ValueError):
            stats.run_summary(bad, "run", ["metric"], "value")


@pytest.fixture(scope="module")
def two_classes(spark):
    rng = random.Random(15)
    rows = []
    for i in range(900):
        c = i % 3
        rows.append((i, [rng.gauss(3.0 * (c == k), 1) for k in range(3)] + [rng.gauss(0, 5), 1.0], "abc"[c], int(c == 0), ("train", "validation", "test")[(i // 3) % 3]))
    return spark.createDataFrame(rows, "id int, e array<double>, c string, y int, split string").cache()


def test_selection_classes_and_controls(spark, two_classes):
    scored, c = models.selected_logistic(two_classes, "e", "y", "split")
    m = one(metrics.ranking(scored.where("split = 'test'"), [], "probability", "y"))
    assert m["auroc"] > 0.9 and c in (0.01, 0.1, 1.0, 10.0, 100.0)
    out = models.multiclass(two_classes, "e", "c", F.col("split") == "train").where("split <> 'train'")
    assert out.agg(F.avg((F.col("predicted") == F.col("c")).cast("int"))).first()[0] > 0.85 and len(out.first().logits) == 3
    noise, _ = models.selected_logistic(models.random_features(two_classes.drop("e"), "id", 4, 1, "e"), "e", "y", "split", grid=(1.0,))
    controls = models.near_chance(metrics.ranking(noise.where("split = 'test'"), [], "probability", "y"), 1 / 3).first()
    assert controls.near_chance and not models.near_chance(spark.createDataFrame([(0.9, 0.9)], "auroc double, average_precision double"), 0.3).first().near_chance
    table = models.predictions(scored, "id", "c", "y", "probability", "split", task="t", representation="native", config={"C": c})
    other = models.predictions(scored.repartition(5), "id", "c", "y", "probability", "split", task="t", representation="native", config={"C": c})
    assert table.count() == 900 and {r[0] for r in table.select("split_hash").union(other.select("split_hash")).distinct().collect()} == {table.first().split_hash}
    assert table.where("(probability_positive >= 0.5) <> (predicted_label = 1)").count() == 0


def test_permuted_labels_move(spark, two_classes):
    dealt = models.permuted_labels(two_classes.select("id", "y", "split"), "id", "y", "split", 3).withColumnRenamed("y", "new").join(two_classes.select("id", "y"), "id")
    assert dealt.where("new <> y").count() > 250
    assert dealt.groupBy("split").agg(F.sum("new").alias("a"), F.sum("y").alias("b")).where("a <> b").count() == 0


def test_pca_by_properties(spark, two_classes):
    train = F.col("split") == "train"
    z = models.scaled_vectors(two_classes, "e", train, "z")
    out, shares = models.pca(z, "z", train, 3, "pc")
    means = out.where(train).select(*(F.col("pc")[i].alias(f"p{i}") for i in range(3)))
    cov = [[means.stat.cov(f"p{i}", f"p{j}") for j in range(3)] for i in range(3)]
    assert all(abs(cov[i][j]) < 1e-8 for i in range(3) for j in range(3) if i != j) and cov[0][0] >= cov[1][1] >= cov[2][2] and shares == sorted(shares, reverse=True)


def test_fusion_alignment_and_results(spark):
    rng = random.Random(16)
    side = lambda n, w: spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(w)]) for i in range(n)], "id int, e array<double>")
    a, b = side(60, 6), side(60, 4)
    out = models.fusion_variants(a, b, "id", "e", F.col("id") % 4 != 0, 3)
    assert {r.variant: (r.n, r.w) for r in out.groupBy("variant").agg(F.count("id").alias("n"), F.max(F.size("e")).alias("w")).collect()} == {"native": (60, 10), "separate": (60, 6), "joint": (60, 3), "balanced": (60, 3)}
    with pytest.raises(ValueError):
        models.fusion_variants(a, b.where("id > 0"), "id", "e", F.col("id") % 4 != 0, 3)
    cohort = spark.createDataFrame([(1, "x"), (2, "y")], "id int, l string")
    assert models.aligned_features(cohort, a, "id").count() == 2
    with pytest.raises(ValueError):
        models.aligned_features(cohort, a.where("id <> 2"), "id")
    with pytest.raises(ValueError):
        models.aligned_features(cohort, a.union(a), "id")


def test_pilot_detects_held_out_classes(spark):
    from tidemark.plans import pipelines

    rng = random.Random(18)
    rows = [(8 * i + c, [rng.gauss(6.0 * (k == c), 1) for k in range(8)], f"c{c}", i // 2 * 8 + c) for c in range(8) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, e array<double>, label string, grp int")
    scores, truth = pipelines.open_set_scores(df, "id", "e", "label", F.col("grp"), least=20, seed=4, components=6)
    out = {r.method: r.auroc for r in metrics.ranking(scores.join(truth, "id"), ["method"], "score", "y").collect()}
    assert set(out) == {"msp", "max_logit", "energy", "mahalanobis", "relative_mahalanobis", "prototype_cosine", "knn_cosine"} and min(out.values()) > 0.6 and out["mahalanobis"] > 0.9
    again, _ = pipelines.open_set_scores(df.repartition(3).sortWithinPartitions(F.desc("id")), "id", "e", "label", F.col("grp"), least=20, seed=4, components=6)
    assert scores.select("id", "method").exceptAll(again.select("id", "method")).count() == 0


def test_contiguity_and_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.0, 0.0]), ("b", [float("nan"), 1.0])], "id string, e array<double>")
    assert one(contracts.vector_contract(v, "id", "e")) == {"n_rows": 3, "n_ids": 2, "least_width": 2, "largest_width": 2, "n_not_finite": 1, "n_zero": 1}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
