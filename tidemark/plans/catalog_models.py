"""Queries on sampling and splits, graphs, sequences, metrics, statistics, open-set scores and inference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import hashing as H
from tidemark.functions import vectors as V
from tidemark.operators import contracts as C
from tidemark.operators import graph as G
from tidemark.operators import inference as I
from tidemark.operators import metrics as M
from tidemark.operators import models as L
from tidemark.operators import ood as O
from tidemark.operators import sequences as B
from tidemark.operators import sparse as K
from tidemark.operators import splits as S
from tidemark.operators import stats as E
from tidemark.operators.shared import filled, reliable
from tidemark.operators.ranges import quantiles
from tidemark.plans import pipelines as P
from tidemark.plans.registry import Tables, query, r

_HASH = "sha256('{s}:' || CAST({k} AS VARCHAR))"
_U32 = "CAST(CAST('0x' || substr({h}, 1, 8) AS UBIGINT) AS DOUBLE) / 4294967295.0"
_U64 = "CAST(CAST('0x' || substr({h}, 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0"


def _h(k: str, s: int) -> str:
    return _HASH.format(k=k, s=s)


# --- sampling, matching, splits


@query("h01_hash_order", f"SELECT p_partkey, row_number() OVER (ORDER BY {_h('p_partkey', 7)}, p_partkey) <= 50 AS first_50 FROM part")
def h01(t: Tables) -> DataFrame:
    first = t.part.select("p_partkey").orderBy(*S.hash_order(7, "p_partkey")).limit(50).withColumn("f", F.lit(True))
    return t.part.select("p_partkey").join(F.broadcast(first), "p_partkey", "left").select("p_partkey", F.coalesce("f", F.lit(False)).alias("first_50"))


@query("h02_group_split", f"SELECT o_custkey, CASE WHEN {_U32.format(h=_h('o_custkey', 3))} < 0.70 THEN 'train' WHEN {_U32.format(h=_h('o_custkey', 3))} < 0.85 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM orders GROUP BY 1, 2")
def h02(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey", S.split_of(F.col("o_custkey"), 3).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "h03_quantile_bins",
    "WITH m AS (SELECT quantile_cont(l_discount, 0.25) AS a, quantile_cont(l_discount, 0.5) AS b, quantile_cont(l_discount, 0.75) AS c, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem), e AS (SELECT list_distinct([a, b, c]) AS inner_, lo, hi FROM m) SELECT l_orderkey, l_linenumber, l_partkey, CAST(len([x FOR x IN inner_ IF x < l_discount AND x > lo AND x < hi]) AS INTEGER) AS bin FROM lineitem, e",
)
def h03(t: Tables) -> DataFrame:
    return S.quantile_bins(t.lineitem, "l_discount", 4, "bin").select("l_orderkey", "l_linenumber", "l_partkey", "bin")


_MATCH = f"WITH c AS (SELECT p_partkey, p_type, CASE WHEN p_size > 30 THEN 'big' ELSE 'small' END AS label FROM part), q AS (SELECT *, row_number() OVER (PARTITION BY p_type, label ORDER BY {_h('p_partkey', 5)}, p_partkey) AS place, least(sum(CASE WHEN label = 'big' THEN 1 ELSE 0 END) OVER w, sum(CASE WHEN label = 'small' THEN 1 ELSE 0 END) OVER w) AS quota FROM c WINDOW w AS (PARTITION BY p_type)), k AS (SELECT p_partkey, p_type, label FROM q WHERE place <= quota)"


@query("h04_exact_matching", f"{_MATCH} SELECT * FROM k")
def h04(t: Tables) -> DataFrame:
    c = t.part.select("p_partkey", "p_type", F.when(F.col("p_size") > 30, "big").otherwise("small").alias("label"))
    return S.matched(c, ["p_type"], "label", ("big", "small"), "p_partkey", 5).select("p_partkey", "p_type", "label")


@query("h05_nested_selection", f"""WITH RECURSIVE g AS (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY {_h('l_orderkey', 9)}, l_orderkey) AS i FROM g),
    t AS (SELECT CAST(sum(size) // 10 AS BIGINT) AS first, CAST(sum(size) // 4 AS BIGINT) AS second FROM g),
    a AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS have, false AS taken UNION ALL SELECT o.i, a.have + CASE WHEN a.have + o.size <= t.first THEN o.size ELSE 0 END, a.have + o.size <= t.first FROM a JOIN o ON o.i = a.i + 1, t),
    rest AS (SELECT o.*, row_number() OVER (ORDER BY o.i) AS j FROM o JOIN a USING (i) WHERE NOT taken),
    b AS (SELECT CAST(0 AS BIGINT) AS j, (SELECT max(have) FROM a) AS have, false AS taken UNION ALL SELECT rest.j, b.have + CASE WHEN b.have + rest.size <= t.second THEN rest.size ELSE 0 END, b.have + rest.size <= t.second FROM b JOIN rest ON rest.j = b.j + 1, t)
    SELECT l_orderkey, size, 0 AS level FROM o JOIN a USING (i) WHERE taken UNION ALL SELECT l_orderkey, size, 1 FROM rest JOIN b USING (j) WHERE taken""")
def h05(t: Tables) -> DataFrame:
    groups = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("size"))
    total = t.lineitem.count()
    return S.exact_selection(groups, "l_orderkey", "size", [total // 10, total // 4], 9)


@query("h06_quota_sample", f"WITH q AS (SELECT l_suppkey, CAST(floor(count(*) * 0.15) AS BIGINT) AS quota FROM lineitem GROUP BY 1), k AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_h('l_partkey', 2)}, l_partkey) AS place FROM k) SELECT l_suppkey, l_partkey FROM o JOIN q USING (l_suppkey) WHERE place <= quota")
def h06(t: Tables) -> DataFrame:
    quotas = t.lineitem.groupBy("l_suppkey").agg(F.floor(F.count(F.lit(1)) * 0.15).cast("long").alias("quota"))
    return S.quota_sample(t.lineitem.select("l_suppkey", "l_partkey").distinct(), quotas, ["l_suppkey"], "l_partkey", 2).select("l_suppkey", "l_partkey")


_COUNTS = f"WITH c AS (SELECT o_orderpriority, CASE WHEN {_U32.format(h=_h('o_custkey', 3))} < 0.70 THEN 'train' WHEN {_U32.format(h=_h('o_custkey', 3))} < 0.85 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM orders GROUP BY 1, 2)"


@query("h07_largest_feasible", f"{_COUNTS}, m AS (SELECT split, min(n) AS least FROM c GROUP BY 1), x AS (SELECT t AS total, CAST(floor(t * 0.70::DOUBLE) AS BIGINT) AS tr, CAST(floor(t * 0.15::DOUBLE) AS BIGINT) AS va FROM (SELECT unnest(range(0, 20001)) AS t)) SELECT max(total) AS largest FROM x WHERE tr <= (SELECT least FROM m WHERE split = 'train') AND va <= (SELECT least FROM m WHERE split = 'validation') AND total - tr - va <= (SELECT least FROM m WHERE split = 'test')")
def h07(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_orderpriority", S.split_of(F.col("o_custkey"), 3).alias("split")).agg(F.count(F.lit(1)).alias("n"))
    return S.largest_feasible(counts, "split", "n", 20_000)


@query("h08_available_threshold", "WITH q AS (SELECT quantile_cont(l_discount, 0.10) AS q10, quantile_cont(l_discount, 0.25) AS q25, quantile_cont(l_discount, 0.50) AS q50 FROM lineitem), n AS (SELECT l_suppkey, count(*) FILTER (l_discount <= 0) AS n0, count(*) FILTER (l_discount <= q10) AS n1, count(*) FILTER (l_discount <= q25) AS n2 FROM lineitem, q GROUP BY 1), m AS (SELECT min(n0) AS n0, min(n1) AS n1, min(n2) AS n2 FROM n) SELECT CASE WHEN n0 >= 100 THEN 'zero' WHEN n1 >= 100 THEN 'q10' WHEN n2 >= 100 THEN 'q25' ELSE 'q50' END AS rule, round(least(0.5, CASE WHEN n0 >= 100 THEN 0 WHEN n1 >= 100 THEN q10 WHEN n2 >= 100 THEN q25 ELSE q50 END), 9) AS threshold FROM m, q")
def h08(t: Tables) -> DataFrame:
    q = t.lineitem.agg(F.percentile("l_discount", F.array(F.lit(0.10), F.lit(0.25), F.lit(0.50))).alias("q"))
    x = F.col("l_discount")
    n = t.lineitem.crossJoin(F.broadcast(q)).groupBy("l_suppkey").agg(F.count_if(x <= 0).alias("n0"), F.count_if(x <= F.col("q")[0]).alias("n1"), F.count_if(x <= F.col("q")[1]).alias("n2"))
    m = n.agg(F.min("n0").alias("n0"), F.min("n1").alias("n1"), F.min("n2").alias("n2")).crossJoin(F.broadcast(q))
    pick = lambda a, b, c, d: F.when(F.col("n0") >= 100, a).when(F.col("n1") >= 100, b).when(F.col("n2") >= 100, c).otherwise(d)
    return m.select(pick("zero", "q10", "q25", "q50").alias("rule"), r(F.least(F.lit(0.5), pick(F.lit(0.0), F.col("q")[0], F.col("q")[1], F.col("q")[2]))).alias("threshold"))


_HOLD = f"WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1 HAVING count(*) >= 20), o AS (SELECT *, row_number() OVER (ORDER BY {_U64.format(h=_h('label', 4))}, label) AS place, count(*) OVER () AS k FROM c), p AS (SELECT *, least(greatest(round_even(k * 0.70, 0), 1), k - 2) AS a FROM o), hold AS (SELECT label, n, CASE WHEN place <= a THEN 'id' WHEN place <= a + least(greatest(round_even(k * 0.15, 0), 1), k - a - 1) THEN 'validation_ood' ELSE 'test_ood' END AS part FROM p)"


@query("h09_class_holdout", f"{_HOLD} SELECT * FROM hold")
def h09(t: Tables) -> DataFrame:
    return S.class_holdout(t.embeddings, "label", 20, 4)


@query("h10_group_safe", f"{_HOLD}, v AS (SELECT vec_id, vec_id // 4 AS grp, part FROM embeddings JOIN hold USING (label)), g AS (SELECT grp, count(DISTINCT part) AS k FROM v GROUP BY 1) SELECT part, CASE WHEN k > 1 THEN 'group_spans_parts' END AS reason, count(*) AS n FROM v JOIN g USING (grp) GROUP BY 1, 2")
def h10(t: Tables) -> DataFrame:
    rows = t.embeddings.join(F.broadcast(S.class_holdout(t.embeddings, "label", 20, 4)), "label").withColumn("grp", F.floor(F.col("vec_id") / 4))
    return S.group_safe(rows, "grp", "part").groupBy("part", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("h11_group_role", f"WITH v AS (SELECT vec_id // 4 AS grp FROM embeddings), u AS (SELECT {_U64.format(h=_h('grp', 5))} AS u FROM v) SELECT CASE WHEN u < 0.70 THEN 'train' WHEN u < 0.85 THEN 'calibration' ELSE 'test' END AS role, count(*) AS n FROM u GROUP BY 1")
def h11(t: Tables) -> DataFrame:
    return t.embeddings.groupBy(S.role_of(F.floor(F.col("vec_id") / 4), 4).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("h12_hash_shard", "SELECT CAST(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS UBIGINT) % 8 AS INTEGER) AS shard, count(*) AS n FROM documents GROUP BY 1")
def h12(t: Tables) -> DataFrame:
    return t.documents.groupBy(H.bucket(F.col("doc_id"), 8).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("h13_benchmark_assembly", "SELECT o_orderkey, round(ln(1 + o_totalprice), 8) AS log_price, coalesce(nullif(trim(c_mktsegment), ''), 'Unknown') AS segment, n_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 1000")
def h13(t: Tables) -> DataFrame:
    from tidemark.functions.labels import blank_to

    j = t.orders.where("o_totalprice > 1000").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.select("o_orderkey", r(F.log1p("o_totalprice"), 8).alias("log_price"), blank_to(F.col("c_mktsegment")).alias("segment"), "n_name")


@query("h14_retention_ledger", "WITH s AS (SELECT 1 AS stage, l_linestatus, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 2, l_linestatus, count(*) FROM lineitem WHERE l_quantity > 10 GROUP BY 2 UNION ALL SELECT 3, l_linestatus, count(*) FROM lineitem WHERE l_quantity > 10 AND l_discount > 0.02 GROUP BY 2) SELECT stage, l_linestatus, n, round(n / lag(n) OVER (PARTITION BY l_linestatus ORDER BY stage) - 1, 9) AS change FROM s")
def h14(t: Tables) -> DataFrame:
    stages = [F.lit(True), F.col("l_quantity") > 10, (F.col("l_quantity") > 10) & (F.col("l_discount") > 0.02)]
    one = t.lineitem.groupBy("l_linestatus").agg(*(F.count_if(c).alias(f"n{i}") for i, c in enumerate(stages, 1)))
    s = one.select("l_linestatus", F.inline(F.array(*(F.struct(F.lit(i).alias("stage"), F.col(f"n{i}").alias("n")) for i in (1, 2, 3)))))
    return s.withColumn("change", r(F.col("n") / F.lag("n").over(Window.partitionBy("l_linestatus").orderBy("stage")) - 1))


@query("q07_candidate_pool", f"WITH lo AS (SELECT l_linestatus, least(quantile_cont(l_discount * 10, 0.25), 0.5) AS low FROM lineitem GROUP BY 1), s AS (SELECT l.l_linestatus || '::' || CASE WHEN l_discount * 10 > 0.5 THEN 'high' WHEN l_discount * 10 <= low THEN 'low' END || '::' || l_returnflag AS stratum, l_partkey FROM lineitem l JOIN lo USING (l_linestatus)), d AS (SELECT DISTINCT stratum, l_partkey FROM s WHERE stratum IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_h('l_partkey', 1)}, l_partkey) AS place FROM d) SELECT stratum, l_partkey, CAST(place AS INTEGER) AS place FROM k WHERE place <= 30")
def q07(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_linestatus", (F.col("l_discount") * 10).alias("score"), "l_returnflag", "l_partkey")
    return P.candidate_pool(rows, "l_partkey", "l_linestatus", "score", "l_returnflag", 30, 1).select("stratum", "l_partkey", "place")


@query("q08_frozen_benchmark", f"{_MATCH} SELECT p_partkey, p_type, label, CASE WHEN {_U32.format(h=_h('(p_partkey // 4)', 5))} < 0.70 THEN 'train' WHEN {_U32.format(h=_h('(p_partkey // 4)', 5))} < 0.85 THEN 'validation' ELSE 'test' END AS split FROM k")
def q08(t: Tables) -> DataFrame:
    c = t.part.select("p_partkey", "p_type", F.when(F.col("p_size") > 30, "big").otherwise("small").alias("label"), F.floor(F.col("p_partkey") / 4).alias("grp"))
    return P.frozen_benchmark(c, "p_partkey", "grp", ["p_type"], "label", ("big", "small"), 5).select("p_partkey", "p_type", "label", "split")


# --- graphs


@query("g01_star_edges", "WITH a AS (SELECT l_orderkey, min(l_partkey) AS src FROM lineitem GROUP BY 1) SELECT DISTINCT src, l_partkey AS dst FROM lineitem JOIN a USING (l_orderkey) WHERE l_partkey <> src")
def g01(t: Tables) -> DataFrame:
    return G.star_edges(t.lineitem, "l_orderkey", "l_partkey")


@query(
    "g02_components",
    "WITH RECURSIVE e AS (SELECT DISTINCT p_size % 50 AS a, p_partkey AS b FROM part WHERE p_size < 8), n AS (SELECT p_partkey AS b, p_size % 50 AS s FROM part WHERE p_size < 8), x AS (SELECT b, 1000000 + s AS h FROM n) SELECT b AS id, min(b) OVER (PARTITION BY h) AS component FROM x UNION ALL SELECT h AS id, min(b) AS component FROM x GROUP BY h",
)
def g02(t: Tables) -> DataFrame:
    e = t.part.where("p_size < 8").select((F.lit(1_000_000) + F.col("p_size") % 50).cast("long").alias("src"), F.col("p_partkey").alias("dst"))
    return G.connected_components(e)


@query("g03_degree_summary", "WITH d AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS degree, min(l_suppkey) AS chosen FROM lineitem GROUP BY 1) SELECT l_partkey, degree, degree > 1 AS multi, EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = d.l_partkey AND l.l_suppkey = d.chosen) AS chosen_is_member FROM d")
def g03(t: Tables) -> DataFrame:
    n = filled(t.lineitem)
    pairs = t.lineitem.select("l_partkey", "l_suppkey").repartition(n, "l_partkey", "l_suppkey").distinct()
    d = pairs.groupBy("l_partkey").agg(F.count("l_suppkey").alias("degree"), F.min("l_suppkey").alias("chosen")).repartition(n, "l_partkey", "chosen")
    members = pairs.select("l_partkey", F.col("l_suppkey").alias("chosen"), F.lit(True).alias("m")).repartition(n, "l_partkey", "chosen")
    return C.checked_join(d, members, ["l_partkey", "chosen"], "left").select("l_partkey", "degree", (F.col("degree") > 1).alias("multi"), F.coalesce("m", F.lit(False)).alias("chosen_is_member"))


@query("g04_giant_gate", "WITH s AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS n_groups, max(n) AS largest, round(max(n) / sum(n), 9) AS share, max(n) > 100000 OR max(n) / sum(n) > 0.01 AS giant, round(quantile_cont(n, 0.99), 6) AS p99 FROM s")
def g04(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    share = F.max("n") / F.sum("n")
    return s.agg(F.count(F.lit(1)).alias("n_groups"), F.max("n").alias("largest"), r(share).alias("share"), ((F.max("n") > 100_000) | (share > 0.01)).alias("giant"), r(F.percentile("n", F.lit(0.99)), 6).alias("p99"))


# --- sequences: texts stand for sequences, letters mapped to bases

_BASES = "translate(upper(regexp_replace(substr(text, 1, 1000000), '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTNN')"


def sequences(t: Tables) -> DataFrame:
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return t.documents.select("doc_id", F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTNN").alias("seq"))


def _n(letter: str) -> str:
    return f"(length(s) - length(replace(s, '{letter}', '')))"


_SEQ = f"WITH q AS (SELECT doc_id, {_BASES.replace('substr(text, 1, 1000000)', 'text')} AS s FROM documents)"


@query("b01_nucleotide_quality", f"{_SEQ} SELECT doc_id, CAST(length(s) AS INTEGER) AS nt_length, round(({_n('G')} + {_n('C')}) / nullif({_n('A')} + {_n('C')} + {_n('G')} + {_n('T')}, 0), 9) AS gc, round({_n('N')} / nullif(length(s), 0), 9) AS n_share, sha256(s) AS content_hash FROM q")
def b01(t: Tables) -> DataFrame:
    x = B.nucleotide_quality(F.col("seq"))
    return sequences(t).select("doc_id", x["nt_length"].alias("nt_length"), r(x["gc"]).alias("gc"), r(x["n_share"]).alias("n_share"), x["content_hash"].alias("content_hash"))


@query("b02_requested_records", f"{_SEQ} SELECT doc_id, sha256(s) AS content_hash FROM q WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def b02(t: Tables) -> DataFrame:
    wanted = t.labels.where("quality = 1").select("doc_id").distinct()
    return sequences(t).join(wanted, "doc_id", "left_semi").select("doc_id", F.sha2("seq", 256).alias("content_hash"))


def _codon_sql() -> str:
    table = ", ".join(f"'{c}': '{a}'" for c, a in zip(B.CODONS, B.AMINO_ACIDS, strict=True))
    starts = ", ".join(f"'{c}'" for c in B.STARTS)
    amino = f"CASE WHEN i = 0 AND substr(s, 1, 3) IN ({starts}) THEN 'M' ELSE coalesce(MAP {{{table}}}[substr(s, 3 * i + 1, 3)], 'X') END"
    return f"{_SEQ}, c AS (SELECT doc_id, s, list_aggregate([{amino} FOR i IN range(0, length(s) // 3)], 'string_agg', '') AS p FROM q), d AS (SELECT doc_id, s, regexp_replace(coalesce(p, ''), '\\*$', '') AS p FROM c)"


@query("b03_translation", f"{_codon_sql()} SELECT doc_id, sha256(p) AS protein_hash, CAST(length(p) AS INTEGER) AS protein_length, CAST(length(p) - length(replace(p, '*', '')) AS INTEGER) AS internal_stops, CAST(length(s) % 3 AS INTEGER) AS length_mod3 FROM d")
def b03(t: Tables) -> DataFrame:
    x = B.translation_quality(F.col("seq"))
    return sequences(t).select("doc_id", F.sha2(B.translated(F.col("seq")), 256).alias("protein_hash"), *(x[k].alias(k) for k in ("protein_length", "internal_stops", "length_mod3")))


@query("b04_protein_validity", f"{_codon_sql()} SELECT doc_id, length(s) % 3 = 0 AND length(p) = length(replace(p, '*', '')) AND length(p) >= 3 AS plain_valid FROM d")
def b04(t: Tables) -> DataFrame:
    x = B.translation_quality(F.col("seq"))
    return sequences(t).select("doc_id", ((x["length_mod3"] == 0) & (x["internal_stops"] == 0) & (x["protein_length"] >= 3)).alias("plain_valid"))


@query("b05_codon_usage", f"{_SEQ}, c AS (SELECT doc_id % 10 AS g, unnest([substr(s, 3 * i + 1, 3) FOR i IN range(0, length(s) // 3)]) AS codon FROM q), k AS (SELECT g, codon, count(*) AS n FROM c WHERE NOT regexp_matches(codon, '[^ACGT]') GROUP BY 1, 2) SELECT g, codon, n, round(n / sum(n) OVER (PARTITION BY g), 9) AS share FROM k")
def b05(t: Tables) -> DataFrame:
    u = B.codon_usage(sequences(t), "doc_id", "seq").groupBy((F.col("doc_id") % 10).alias("g"), "codon").agg(F.sum("n").alias("n"))
    return u.withColumn("share", r(F.col("n") / F.sum("n").over(Window.partitionBy("g"))))


_GC = ", ".join(f"round(coalesce(len([x FOR x, i IN a IF (i - 1) % 3 = {p} AND x IN ('G', 'C')]) / nullif(len([x FOR x, i IN a IF (i - 1) % 3 = {p} AND x <> 'N']), 0), 0), 9) AS gc{p + 1}" for p in range(3))


@query("b06_gc_by_position", f"{_SEQ}, k AS (SELECT doc_id, string_split(s, '') AS a FROM q) SELECT doc_id, {_GC} FROM k")
def b06(t: Tables) -> DataFrame:
    return sequences(t).select("doc_id", *(r(c).alias(k) for k, c in B.gc_by_position(F.col("seq")).items()))


_AA = ", ".join(f"round(coalesce((length(p) - length(replace(p, '{a}', ''))) / nullif(length(p), 0), 0), 9) AS aa_{a.lower()}" for a in B.PROTEIN_LETTERS)


@query("b07_composition", f"{_codon_sql()} SELECT doc_id, {_AA} FROM d")
def b07(t: Tables) -> DataFrame:
    p = sequences(t).select("doc_id", B.translated(F.col("seq")).alias("p"))
    return p.select("doc_id", *(r(c).alias(k.lower()) for k, c in B.protein_composition(F.col("p")).items()))


@query("b08_kmer_spectrum", f"""{_SEQ}, k AS (SELECT doc_id, k, unnest([substr(s, i, k) FOR i IN range(1, length(s) - k + 2)]) AS kmer FROM q, (SELECT unnest(range(1, 7)) AS k)),
    c AS (SELECT doc_id, k, kmer, count(*) AS n FROM k WHERE NOT regexp_matches(kmer, '[^ACGT]') GROUP BY ALL),
    x AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id, k) AS share FROM c)
    SELECT doc_id, CAST(k AS INTEGER) AS k, count(*) AS n_kmers, CAST(sum(n) AS BIGINT) AS n_valid, round(max(share), 9) AS largest_share, sha256(string_agg(kmer || ':' || CAST(n AS VARCHAR), ',' ORDER BY kmer)) AS spectrum_sha256 FROM x GROUP BY 1, 2""")
def b08(t: Tables) -> DataFrame:
    """The whole spectrum of each record and k = 1..6 as a digest, its size, and its largest share."""
    # the work on a record outweighs its way through a shuffle, and a file of one row group would be one task
    c = B.kmer_counts(sequences(t).repartition("doc_id"), "doc_id", "seq", range(1, 7)).where(F.size("kmers") > 0)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    text = F.array_join(F.zip_with("kmers", "counts", lambda k, n: F.concat(k, F.lit(":"), n.cast("string"))), ",")
    return c.select("doc_id", "k", F.size("kmers").cast("long").alias("n_kmers"), total.alias("n_valid"), r(F.array_max("counts") / total).alias("largest_share"), F.sha2(text, 256).alias("spectrum_sha256"))


@query("b08_kmer_features", f"""{_SEQ}, k AS (SELECT doc_id, k, unnest([substr(s, i, k) FOR i IN range(1, length(s) - k + 2)]) AS kmer FROM q, (SELECT unnest(range(1, 7)) AS k)),
    c AS (SELECT doc_id, k, kmer, count(*) AS n FROM k WHERE NOT regexp_matches(kmer, '[^ACGT]') GROUP BY ALL),
    x AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id, k) AS share FROM c) SELECT CAST(k AS INTEGER) AS k, kmer, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_records, round(avg(share), 8) AS mean_share FROM x GROUP BY 1, 2""")
def b08f(t: Tables) -> DataFrame:
    # the work on a record outweighs its way through a shuffle, and a file of one row group would be one task
    s = B.kmer_totals(sequences(t).repartition("doc_id"), "seq", range(1, 7))
    return s.select("k", "kmer", "n", F.col("records").alias("n_records"), r("mean_share", 8).alias("mean_share"))


@query("b09_content_groups", "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def b09(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("b10_windows", f"{_SEQ} SELECT doc_id, CAST(i AS INTEGER) AS \"window\", substr(s, i * 500 + 1, 500) AS part FROM (SELECT doc_id, s, unnest(range(0, (length(s) + 499) // 500)) AS i FROM q)")
def b10(t: Tables) -> DataFrame:
    return B.windows(sequences(t), "doc_id", "seq", 500)


@query("b11_prefix_examples", "SELECT doc_id, substr(text, 1, 120) AS example FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def b11(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.substring("text", 1, 120).alias("example"))


# --- metrics

_PRED = "WITH s AS (SELECT l_linestatus AS g, CAST(l_returnflag = 'R' AS INT) AS y, l_discount AS p FROM lineitem)"
_CURVE = f"""{_PRED}, d AS (SELECT g, p, sum(y) AS a, sum(1 - y) AS b FROM s GROUP BY 1, 2),
    c AS (SELECT g, p, sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(a) OVER (PARTITION BY g) AS pos, sum(b) OVER (PARTITION BY g) AS neg FROM d WINDOW w AS (PARTITION BY g ORDER BY p DESC)),
    l AS (SELECT *, coalesce(lag(tp) OVER v, 0) AS tp0, coalesce(lag(fp) OVER v, 0) AS fp0, lead(tp) OVER v AS tp1, lead(fp) OVER v AS fp1, row_number() OVER v AS k FROM c WINDOW v AS (PARTITION BY g ORDER BY p DESC))"""


def _scores(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_linestatus").alias("g"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_discount").alias("p"))


@query("m01_ranking_metrics", f"{_CURVE} SELECT g, round(sum((fp - fp0) * (tp + tp0) / 2) / (max(pos) * max(neg)), 9) AS auroc, round(sum((tp - tp0) * tp / (tp + fp)) / max(pos), 9) AS average_precision, round(coalesce(min(CASE WHEN (k = 1 OR tp1 IS NULL OR tp1 - tp <> tp - tp0 OR fp1 - fp <> fp - fp0) AND tp >= 0.95 * pos THEN fp / neg END), 1), 9) AS fpr_at_recall FROM l GROUP BY g")
def m01(t: Tables) -> DataFrame:
    m = M.ranking(_scores(t), ["g"], "p", "y")
    return m.select("g", *(r(c).alias(c) for c in ("auroc", "average_precision", "fpr_at_recall")))


@query("m04_best_threshold", f"{_CURVE}, j AS (SELECT *, tp / pos - fp / neg AS j FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(j, 12) DESC, p DESC) AS k FROM j) SELECT g, p AS threshold, round(j, 9) AS youden FROM k WHERE k = 1")
def m04(t: Tables) -> DataFrame:
    return M.best_threshold(_scores(t), ["g"], "p", "y").withColumn("youden", r("youden"))


@query("m05_thresholded", f"{_PRED}, c AS (SELECT g, count(*) FILTER (y = 1 AND p > 0.05)::DOUBLE AS tp, count(*) FILTER (y = 0 AND p > 0.05)::DOUBLE AS fp, count(*) FILTER (y = 1 AND p <= 0.05)::DOUBLE AS fn, count(*) FILTER (y = 0 AND p <= 0.05)::DOUBLE AS tn FROM s GROUP BY 1) SELECT g, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 9) AS mcc, round(fp / (fp + tn), 9) AS false_reject, round(fn / (fn + tp), 9) AS false_accept FROM c")
def m05(t: Tables) -> DataFrame:
    m = M.thresholded(_scores(t), ["g"], F.col("y"), (F.col("p") > 0.05).cast("int"))
    return m.select("g", *(r(c).alias(c) for c in m.columns if c != "g"))


@query("m05_macro_f1", "WITH s AS (SELECT l_returnflag AS t, CASE WHEN l_quantity > 30 THEN 'R' WHEN l_quantity > 15 THEN 'N' ELSE 'A' END AS g FROM lineitem), c AS (SELECT t AS c, 1 AS t, 0 AS g, CAST(t = g AS INT) AS hit FROM s UNION ALL SELECT g, 0, 1, 0 FROM s), f AS (SELECT c, 2 * sum(hit) / (sum(t) + sum(g)) AS f1 FROM c GROUP BY 1) SELECT round(avg(f1), 9) AS macro_f1, count(*) AS n_classes FROM f")
def m05b(t: Tables) -> DataFrame:
    guess = F.when(F.col("l_quantity") > 30, "R").when(F.col("l_quantity") > 15, "N").otherwise("A")
    return M.macro_f1(t.lineitem.select(F.col("l_returnflag").alias("t"), guess.alias("g")), "t", "g").withColumn("macro_f1", r("macro_f1"))


@query("m06_brier", f"{_PRED} SELECT g, round(avg((p - y) * (p - y)), 9) AS brier FROM s GROUP BY g")
def m06(t: Tables) -> DataFrame:
    return _scores(t).groupBy("g").agg(r(M.brier(F.col("p"), F.col("y"))).alias("brier"))


# --- statistics


@query("e01_logistic")
def e01(t: Tables) -> DataFrame:
    rows = t.lineitem.select((F.col("l_returnflag") == "R").cast("double").alias("y"), "l_discount", "l_quantity", "l_linestatus")
    return E.logistic(rows, "y", ["l_discount", "l_quantity"], ["l_linestatus"])


@query("e02_nested_models")
def e02(t: Tables) -> DataFrame:
    """M0-M4 on the same complete cases, M5 with the 20 most frequent brands, M6 on the rows of a sensitivity filter."""
    brands = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = t.lineitem.join(brands, "l_partkey").select((F.col("l_returnflag") == "R").cast("double").alias("y"), "l_discount", "l_quantity", "l_tax", (F.col("l_extendedprice") / 10_000).alias("price"), "l_linestatus", "p_brand")
    numeric = ["l_discount", "l_quantity", "l_tax", "price"]
    specs = {"M0": (numeric[:1], []), "M1": (numeric[:2], []), "M2": (numeric[:3], []), "M3": (numeric, []), "M4": (numeric, ["l_linestatus"])}
    return E.nested_models(rows, "y", specs, category="p_brand", top=20, sensitivity=F.col("l_quantity") > 5)


@query("e03_ols", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def e03(t: Tables) -> DataFrame:
    b = E.ols(t.lineitem, "l_extendedprice", ["l_quantity"])
    return t.spark.createDataFrame([(round(b["l_quantity"]["beta"], 6), round(b["intercept"]["beta"], 4))], "slope double, intercept double")


@query("e04_variance_inflation", "SELECT round(1 / (1 - corr(l_discount, l_quantity) * corr(l_discount, l_quantity)), 8) AS vif FROM lineitem")
def e04(t: Tables) -> DataFrame:
    v = E.variance_inflation(t.lineitem, ["l_discount", "l_quantity"])
    return t.spark.createDataFrame([(round(v["l_discount"], 8),)], "vif double")


@query("e05_odds_ratio", "WITH c AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS a, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS b, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS c, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') AS d FROM lineitem GROUP BY 1), x AS (SELECT *, CASE WHEN least(a, b, c, d) = 0 THEN 0.5 ELSE 0 END AS e FROM c) SELECT l_suppkey, round((a + e)::DOUBLE * (d + e) / ((b + e)::DOUBLE * (c + e)), 8) AS odds_ratio FROM x")
def e05(t: Tables) -> DataFrame:
    R, Fs = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    c = t.lineitem.groupBy("l_suppkey").agg(F.count_if(R & Fs).alias("a"), F.count_if(R & ~Fs).alias("b"), F.count_if(~R & Fs).alias("c"), F.count_if(~R & ~Fs).alias("d"))
    return c.select("l_suppkey", r(E.odds_ratio(*(F.col(k) for k in "abcd")), 8).alias("odds_ratio"))


@query("e06_bootstrap_mean")
def e06(t: Tables) -> DataFrame:
    return E.bootstrap_mean(t.events, "value", 500)


@query("e07_rank_sum", "WITH s AS (SELECT l_quantity AS v, l_returnflag AS g FROM lineitem WHERE l_returnflag IN ('A', 'R')), k AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM s), c AS (SELECT count(*) FILTER (g = 'A')::DOUBLE AS n1, count(*) FILTER (g = 'R')::DOUBLE AS n2, sum(r) FILTER (g = 'A') AS r1 FROM k) SELECT n1, n2, round(r1 - n1 * (n1 + 1) / 2, 3) AS u, round(2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2) - 1, 9) AS cliffs_delta FROM c")
def e07(t: Tables) -> DataFrame:
    s = E.rank_sum(t.lineitem, "l_quantity", "l_returnflag", ("A", "R"))
    return s.select("n1", "n2", r("u", 3).alias("u"), r("cliffs_delta").alias("cliffs_delta"))


@query("e08_paired_bootstrap")
def e08(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("grp"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    return E.delta_summary(E.paired_bootstrap(rows, "grp", "a", "b", "y", 2_000, least=1_000).withColumn("task", F.lit("returned")), ["task"])


@query("e10_best_single", f"{_CURVE.replace('l_discount AS p', 'l_discount AS p')}, a AS (SELECT g, sum((fp - fp0) * (tp + tp0) / 2) / (max(pos) * max(neg)) AS auroc FROM l GROUP BY g) SELECT g, round(auroc, 9) AS auroc FROM a ORDER BY auroc DESC, g LIMIT 1")
def e10(t: Tables) -> DataFrame:
    return M.ranking(_scores(t), ["g"], "p", "y").select("g", r("auroc").alias("auroc")).orderBy(F.desc("auroc"), "g").limit(1)


@query("e11_run_summary", "SELECT user_id % 5 AS run, event_type, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS sd, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2")
def e11(t: Tables) -> DataFrame:
    return t.events.groupBy((F.col("user_id") % 5).alias("run"), "event_type").agg(r(F.avg("value"), 8).alias("mean"), r(F.stddev_samp("value"), 8).alias("sd"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("e11_run_intervals")
def e11b(t: Tables) -> DataFrame:
    """Mean over five runs with its bootstrap interval; runs must have the same keys."""
    per = t.events.groupBy((F.col("user_id") % 5).alias("run"), "event_type").agg(F.avg("value").alias("value"))
    return E.run_summary(per, "run", ["event_type"], "value")


# --- vectors and open-set scores

_V = "WITH v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings)"


@query("j10_vector_fusion", "SELECT vec_id, len(embedding || embedding) AS width, round(list_sum([CAST(x AS DOUBLE) FOR x IN (embedding || embedding)]), 5) AS total FROM embeddings")
def j10(t: Tables) -> DataFrame:
    f = L.fused(t.embeddings, t.embeddings, "vec_id", "embedding")
    return f.select("vec_id", F.size("embedding").cast("long").alias("width"), r(V.total(F.col("embedding")), 5).alias("total"))


@query("f16_vector_functions", f"{_V} SELECT vec_id, round(sqrt(list_sum([x * x FOR x IN e])), 6) AS norm, round(list_sum([x * x FOR x IN e]), 6) AS square FROM v")
def f16(t: Tables) -> DataFrame:
    e = F.col("embedding")
    return t.embeddings.select("vec_id", r(V.norm(e), 6).alias("norm"), r(V.dot(e, e), 6).alias("square"))


_LOGITS = f"{_V}, z AS (SELECT vec_id, [x * 10 FOR x IN e[1:10]] AS z FROM v), w AS (SELECT *, list_max(z) AS m FROM z)"


@query("o01_logit_scores", f"{_LOGITS} SELECT vec_id, round(1 - 1 / list_sum([exp(x - m) FOR x IN z]), 8) AS msp, round(-m, 8) AS max_logit, round(-(m + ln(list_sum([exp(x - m) FOR x IN z]))), 8) AS energy FROM w")
def o01(t: Tables) -> DataFrame:
    z = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 10)
    return t.embeddings.select("vec_id", r(O.msp(z), 8).alias("msp"), r(O.max_logit(z), 8).alias("max_logit"), r(O.energy(z), 8).alias("energy"))


_STATE = f"""{_V}, x AS (SELECT vec_id, label, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS d FROM v), m AS (SELECT label, d, avg(x) AS m FROM x GROUP BY 1, 2), g AS (SELECT d, avg(x) AS g FROM x GROUP BY 1),
    s AS (SELECT d, greatest(sum((x - m) * (x - m)) / (count(*) - 1), 0.0001) AS s FROM x JOIN m USING (label, d) GROUP BY 1)"""


@query("o04_distance_state", f"{_STATE} SELECT label, round(sum(m), 5) AS mean_sum, round(sum(g), 5) AS global_sum, round(sum(s), 6) AS variance_sum FROM m JOIN g USING (d) JOIN s USING (d) GROUP BY 1")
def o04(t: Tables) -> DataFrame:
    s = O.distance_state(t.embeddings, "label", "embedding")
    return s.select("label", r(V.total(F.col("mean")), 5).alias("mean_sum"), r(V.total(F.col("global_mean")), 5).alias("global_sum"), r(V.total(F.col("variance")), 6).alias("variance_sum"))


@query("o05_distance_scores", f"{_STATE}, d AS (SELECT vec_id, m.label, sum((x - m) * (x - m) / s) AS a, sum((x - g) * (x - g) / s) AS b, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS c FROM x JOIN m USING (d) JOIN g USING (d) JOIN s USING (d) GROUP BY 1, 2) SELECT vec_id, round(min(a), 5) AS mahalanobis, round(min(a - b), 5) AS relative_mahalanobis, round(1 - max(c), 7) AS prototype_cosine FROM d GROUP BY 1")
def o05(t: Tables) -> DataFrame:
    s = O.distance_scores(t.embeddings, "vec_id", "embedding", O.distance_state(t.embeddings, "label", "embedding"), "label")
    return s.select("vec_id", r("mahalanobis", 5).alias("mahalanobis"), r("relative_mahalanobis", 5).alias("relative_mahalanobis"), r("prototype_cosine", 7).alias("prototype_cosine"))


@query("o07_nearest_cosine", f"{_V}, c AS (SELECT a.vec_id, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC) AS k FROM c) SELECT vec_id, round(1 - avg(c), 7) AS knn_cosine FROM k WHERE k <= 10 GROUP BY 1")
def o07(t: Tables) -> DataFrame:
    n = O.nearest_cosine(t.embeddings.where("vec_id % 5 = 0"), t.embeddings.where("vec_id % 5 <> 0"), "vec_id", "embedding")
    return n.withColumn("knn_cosine", r("knn_cosine", 7))


@query("o08_score_summary", f"{_PRED}, v AS (SELECT g, quantile_cont(p, 0.95) AS th FROM s WHERE y = 0 GROUP BY 1) SELECT s.g, th, round(avg(CAST(p > th AS INT)) FILTER (y = 1), 9) AS detected, round(avg(CAST(p > th AS INT)) FILTER (y = 0), 9) AS false_alarm FROM s JOIN v ON s.g = v.g GROUP BY 1, 2")
def o08(t: Tables) -> DataFrame:
    s = _scores(t)
    th = quantiles(s.where("y = 0"), ["g"], "p", {"th": 0.95})
    over = (F.col("p") > F.col("th")).cast("int")
    return s.join(F.broadcast(th), "g").groupBy("g", "th").agg(r(F.avg(F.when(F.col("y") == 1, over))).alias("detected"), r(F.avg(F.when(F.col("y") == 0, over))).alias("false_alarm"))


@query("o09_open_set_pilot")
def o09(t: Tables) -> DataFrame:
    """Class holdout, group safety, roles, scaling, components, classifier, all seven detectors in one long table, ranking metrics of each."""
    scores, truth = P.open_set_scores(t.embeddings, "vec_id", "embedding", "label", F.floor(F.col("vec_id") / 4), least=20, seed=4, components=16)
    return M.ranking(scores.join(truth, "vec_id"), ["method"], "score", "y")


# --- models and inference


@query("l01_task_cohorts", "SELECT 'returned' AS task, count(*) AS n, CAST(sum(CAST(l_returnflag = 'R' AS INT)) AS BIGINT) AS n_positive FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT 'open', count(*), CAST(sum(CAST(l_returnflag = 'R' AS INT)) AS BIGINT) FROM lineitem WHERE l_linestatus = 'O'")
def l01(t: Tables) -> DataFrame:
    c = L.cohort(t.lineitem, {"returned": F.col("l_linestatus") == "F", "open": F.col("l_linestatus") == "O"})
    return c.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n_positive"))


@query("l02_train_scaling", "WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem WHERE l_linestatus = 'F') SELECT l_suppkey, round(sum((l_quantity - m) / s), 5) AS z FROM lineitem, s GROUP BY 1")
def l02(t: Tables) -> DataFrame:
    return L.scaled(t.lineitem, ["l_quantity"], F.col("l_linestatus") == "F").groupBy("l_suppkey").agg(r(F.sum("l_quantity"), 5).alias("z"))


@query("l03_train_pca")
def l03(t: Tables) -> DataFrame:
    train = F.col("vec_id") % 5 != 0
    z = L.scaled_vectors(t.embeddings, "embedding", train, "z")
    return L.pca(z, "z", train, 4, "pc")[0].select("vec_id", "label", "pc")


@query("l04_selected_logistic")
def l04(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("y"), S.split_of(F.floor(F.col("vec_id") / 4), 3).alias("split"))
    out, _ = L.selected_logistic(rows, "embedding", "y", "split")
    return M.ranking(out.where("split = 'test'"), ["split"], "probability", "y")


@query("l05_class_weights", "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 9) AS weight FROM c")
def l05(t: Tables) -> DataFrame:
    return L.class_weights(t.embeddings, "label").withColumn("weight", r("weight"))


@query("l05_multiclass")
def l05b(t: Tables) -> DataFrame:
    """Accuracy by class of the multinomial classifier on rows that it wasn't fitted on."""
    train = F.col("vec_id") % 5 != 0
    z = L.scaled_vectors(t.embeddings, "embedding", train, "z")
    out = L.multiclass(z, "z", "label", train).where(~train)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted") == F.col("label").cast("string")).cast("int")).alias("accuracy"))


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    return tuple(t.embeddings.select("vec_id", F.slice("embedding", start, 32).alias("embedding")) for start in (1, 33))


@query("l06_fusion_variants", "WITH e AS (SELECT count(*) AS n, round(sum(list_sum([CAST(x AS DOUBLE) FOR x IN embedding])), 4) AS total, round(sum(list_sum([CAST(x AS DOUBLE) * (i + vec_id % 7) FOR x, i IN embedding])), 3) AS placed FROM embeddings) SELECT variant, n, width, CASE WHEN variant = 'native' THEN total END AS total, CASE WHEN variant = 'native' THEN placed END AS placed FROM e, (VALUES ('native', 64), ('separate', 16), ('joint', 8), ('balanced', 8)) AS v(variant, width)")
def l06(t: Tables) -> DataFrame:
    v = L.fusion_variants(*_halves(t), "vec_id", "embedding", F.col("vec_id") % 5 != 0, 8)
    whole = F.when(F.col("variant") == "native", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x))
    placed = F.when(F.col("variant") == "native", F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1 + F.col("vec_id") % 7)), F.lit(0.0), lambda a, x: a + x))
    return v.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width"), r(F.sum(whole), 4).alias("total"), r(F.sum(placed), 3).alias("placed"))


_ROW_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))"


@query("l07_permuted_labels", f"""WITH s AS (SELECT {_ROW_KEY} AS k, l_linestatus, l_returnflag FROM lineitem),
    a AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY k) AS i FROM s), b AS (SELECT l_linestatus, l_returnflag AS dealt, row_number() OVER (PARTITION BY l_linestatus ORDER BY {_h('k', 3)}, k) AS i FROM s)
    SELECT a.l_linestatus, l_returnflag, dealt, count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(k), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM a JOIN b USING (l_linestatus, i) GROUP BY ALL""")
def l07(t: Tables) -> DataFrame:
    """Which label each row is dealt: rows by old and new label, and a digest of their keys."""
    rows = t.lineitem.select(F.expr(_ROW_KEY).alias("k"), "l_linestatus", "l_returnflag")
    dealt = L.permuted_labels(rows, "k", "l_returnflag", "l_linestatus", 3, keep="was").withColumnsRenamed({"l_returnflag": "dealt", "was": "l_returnflag"})
    return dealt.groupBy("l_linestatus", "l_returnflag", "dealt").agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(F.sha2("k", 256), 1, 8), 16, 10).cast("long")).alias("digest"))


@query("l07_null_controls")
def l07b(t: Tables) -> DataFrame:
    """Models of permuted labels and of random features, on rows kept aside: both must be near chance."""
    rows = t.embeddings.select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("y"), S.split_of(F.floor(F.col("vec_id") / 4), 3).alias("split"))
    dealt = L.permuted_labels(rows.where("split = 'train'"), "vec_id", "y", "split", 5).unionByName(rows.where("split <> 'train'"))
    noise = L.random_features(rows.drop("embedding"), "vec_id", 8, 5, "embedding")
    out = []
    for name, d in (("permuted_labels", dealt), ("random_features", noise)):
        scored, _ = L.selected_logistic(d, "embedding", "y", "split", grid=(1.0,))
        test = scored.where("split = 'test'")
        m = M.ranking(test, ["split"], "probability", "y").select("auroc", "average_precision")
        out.append(L.near_chance(m, test.agg(F.avg("y")).first()[0] or 0.5).withColumn("control", F.lit(name)))
    return out[0].unionByName(out[1])


@query("l08_aligned_features", "SELECT doc_id, quality, length(text) AS n_letters, len(string_split(text, ' ')) AS n_words FROM labels JOIN documents USING (doc_id)")
def l08(t: Tables) -> DataFrame:
    features = t.documents.select("doc_id", F.length("text").cast("long").alias("n_letters"), F.size(F.split("text", " ")).cast("long").alias("n_words"))
    return L.aligned_features(t.labels.select("doc_id", "quality"), features, "doc_id")


@query("l08_classical_sets", f"""{_codon_sql()}, b1 AS (SELECT doc_id, s, string_split(s, '') AS a FROM q),
    c1 AS (SELECT doc_id, unnest([substr(s, 3 * i + 1, 3) FOR i IN range(0, length(s) // 3)]) AS codon FROM q), u AS (SELECT doc_id, codon, count(*) AS n FROM c1 WHERE NOT regexp_matches(codon, '[^ACGT]') GROUP BY 1, 2),
    g AS (SELECT doc_id, {_GC} FROM b1), aa AS (SELECT doc_id, {_AA} FROM d),
    k AS (SELECT doc_id, k, unnest([substr(s, i, k) FOR i IN range(1, length(s) - k + 2)]) AS kmer FROM q, (SELECT unnest(range(1, 7)) AS k)), m AS (SELECT DISTINCT doc_id, k, kmer FROM k WHERE NOT regexp_matches(kmer, '[^ACGT]')),
    n AS (SELECT doc_id, length(s) AS len, coalesce(({_n('G')} + {_n('C')}) / nullif({_n('A')} + {_n('C')} + {_n('G')} + {_n('T')}, 0), 0) AS gc FROM q)
    SELECT 'length' AS representation, 1 AS width, count(*) AS n, count(*) AS held, round(sum(len), 4) AS total FROM n
    UNION ALL SELECT 'gc', 1, count(*), count(*), round(sum(gc), 4) FROM n UNION ALL SELECT 'length_gc', 2, count(*), 2 * count(*), round(sum(len + gc), 4) FROM n
    UNION ALL SELECT 'codon_67', 67, (SELECT count(*) FROM q), (SELECT count(*) FROM u) + 3 * (SELECT count(*) FROM q), round((SELECT count(DISTINCT doc_id) FROM u) + (SELECT sum(gc1 + gc2 + gc3) FROM g), 4)
    UNION ALL SELECT 'aa20', 20, count(*), 20 * count(*), round(sum({' + '.join(f'aa_{a.lower()}' for a in B.PROTEIN_LETTERS)}), 4) FROM aa
    UNION ALL SELECT 'kmer_1_6', 5460, (SELECT count(*) FROM q), count(*), round(count(DISTINCT (doc_id, k)), 4) FROM m""")
def l08s(t: Tables) -> DataFrame:
    """The six classical feature sets of all records as sparse rows: by set its width, rows, held places and sum of values."""
    s = sequences(t)
    total = F.sum(F.aggregate("values", F.lit(0.0), lambda a, v: a + v))
    sets = K.classical_sets(s.select("doc_id"), s, "doc_id", "seq")
    return sets.groupBy("representation", "width").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("indices")).alias("held"), r(total, 4).alias("total"))


@query("l05_averaged_sgd")
def l05c(t: Tables) -> DataFrame:
    """Accuracy by class of the averaged descent on scaled vectors, on rows that it wasn't fitted on."""
    train = F.col("vec_id") % 5 != 0
    z = L.scaled_vectors(t.embeddings, "embedding", train, "values").withColumn("indices", F.sequence(F.lit(0), F.size("values") - 1))
    found = K.class_scores(z.where(~train), *K.averaged_sgd(z, "vec_id", "label", train, 64))
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted") == F.col("label").cast("string")).cast("int")).alias("accuracy"))


@query("l04_sparse_logistic")
def l04s(t: Tables) -> DataFrame:
    """The k-mer shares of labelled records, scaled without centring: the penalty with the best validation, ranked on test rows."""
    s = sequences(t).join(t.labels.select("doc_id", F.col("quality").cast("int").alias("y")), "doc_id")
    rows = reliable(K.kmer_rows(s, "doc_id", "seq", keep=("y",)).withColumn("split", S.split_of(F.col("doc_id"), 3)))
    rows = K.scaled(rows, F.col("split") == "train", 5460)
    penalties = (1e-4, 1e-2)
    models, labels = K.averaged_sgds(rows, "doc_id", "y", F.col("split") == "train", 5460, penalties, epochs=5)
    scored = rows.where("split <> 'train'")
    for i, model in enumerate(models):
        scored = K.class_scores(scored, model, labels, f"logits{i}")
    score = lambda i, p: F.struct(F.lit(p).alias("penalty"), (F.get(f"logits{i}", 1) - F.get(f"logits{i}", 0)).alias("score"))
    scored = reliable(scored.select("split", "y", F.inline(F.array(*(score(i, p) for i, p in enumerate(penalties))))))
    best = M.ranking(scored.where("split = 'validation'"), ["penalty"], "score", "y").orderBy(F.desc_nulls_last("average_precision"), "penalty").first()["penalty"]
    return M.ranking(scored.where((F.col("split") == "test") & (F.col("penalty") == best)), ["penalty"], "score", "y")


@query("l09_predictions")
def l09(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", F.floor(F.col("vec_id") / 4).alias("grp"), "embedding", (F.col("label") < 5).cast("int").alias("y"), S.split_of(F.floor(F.col("vec_id") / 4), 3).alias("split"))
    scored, c = L.selected_logistic(rows, "embedding", "y", "split", grid=(0.1, 1.0))
    return L.predictions(scored, "vec_id", "grp", "y", "probability", "split", task="low_label", representation="native", config={"model": "logistic", "C": c})


_RESULTS = "WITH a AS (SELECT event_type AS task, user_id % 4 AS method, avg(value) AS v FROM events GROUP BY 1, 2), s AS (SELECT task, method, v, 'main' AS scope FROM a WHERE method < 3 UNION ALL SELECT task, method, v + 1, 'rerun' FROM a WHERE method > 1), k AS (SELECT *, row_number() OVER (PARTITION BY task, method ORDER BY scope) AS p FROM s WHERE isfinite(v)), c AS (SELECT task, method, v, scope FROM k WHERE p = 1)"


def _results(t: Tables) -> DataFrame:
    a = t.events.groupBy(F.col("event_type").alias("task"), (F.col("user_id") % 4).alias("method")).agg(F.avg("value").alias("v"))
    return L.canonical_results({"main": a.where("method < 3"), "rerun": a.where("method > 1").withColumn("v", F.col("v") + 1)}, ["task", "method"], "v")


@query("l10_canonical_results", f"{_RESULTS} SELECT task, method, round(v, 8) AS v, scope FROM c")
def l10(t: Tables) -> DataFrame:
    return _results(t).withColumn("v", r("v", 8))


@query("l10_master_table", f"{_RESULTS}, n AS (SELECT event_type AS task, count(*) AS n_events FROM events GROUP BY 1) SELECT c.task, arg_max(method, v) AS best_method, round(max(v), 8) AS best_v, arg_max(method, v) FILTER (method < 2) AS classical_method, round(max(v) FILTER (method < 2), 8) AS classical_v, round(max(v) - max(v) FILTER (method < 2), 8) AS margin, max(n_events) AS n_events FROM c LEFT JOIN n ON c.task = n.task GROUP BY c.task")
def l10b(t: Tables) -> DataFrame:
    support = t.events.groupBy(F.col("event_type").alias("task")).agg(F.count(F.lit(1)).alias("n_events"))
    return L.master_table(_results(t), ["task"], "method", "v", [0, 1], support).withColumns({c: r(c, 8) for c in ("best_v", "classical_v", "margin")})


@query("i01_embedding_job")
def i01(t: Tables) -> DataFrame:
    def backend():
        return lambda texts: [[float(len(x)), float(x.count(" "))] for x in texts]

    return I.embed(t.documents, "doc_id", "text", backend, shards=8)


@query("i02_mock_embedding")
def i02(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", I.mock_embedding(F.col("doc_id"), 16).alias("embedding"))


@query("i03_pooling", "WITH x AS (SELECT o_custkey, unnest([1, 2]) AS d, unnest([o_totalprice, CAST(o_orderkey AS DOUBLE)]) AS x, o_orderkey FROM orders WHERE o_orderstatus <> 'P') SELECT o_custkey, round(avg(x) FILTER (d = 1), 7) AS mean_price, arg_max(x, o_orderkey) FILTER (d = 2) AS last_key FROM x GROUP BY 1")
def i03(t: Tables) -> DataFrame:
    tokens = t.orders.select("o_custkey", "o_orderkey", F.array("o_totalprice", F.col("o_orderkey").cast("double")).alias("v"), (F.col("o_orderstatus") != "P").alias("mask"))
    p = I.pooled(tokens, "o_custkey", "o_orderkey", "v", "mask")
    return p.select("o_custkey", r(F.col("mean")[0], 7).alias("mean_price"), F.col("last")[1].alias("last_key"))


@query("i04_weighted_windows", "SELECT l_suppkey, round(sum(l_quantity * l_discount) / sum(l_quantity), 9) AS x FROM lineitem GROUP BY 1")
def i04(t: Tables) -> DataFrame:
    w = I.weighted_windows(t.lineitem.select("l_suppkey", "l_quantity", F.array("l_discount").alias("v")), "l_suppkey", "v", "l_quantity")
    return w.select("l_suppkey", r(F.col("v")[0]).alias("x"))


def _letter_shares():
    """A backend whose vector is the share of two letters, so a text's mean by windows is that of the whole text."""
    return lambda texts: [[t.count("e") / len(t), t.count("n") / len(t)] for t in texts]


@query("i04_windowed_embedding", "SELECT doc_id, CAST(ceil(length(text) / 512) AS BIGINT) AS windows, round((length(text) - length(replace(text, 'e', ''))) / length(text), 6) AS e, round((length(text) - length(replace(text, 'n', ''))) / length(text), 6) AS n FROM documents WHERE length(text) > 0")
def i04w(t: Tables) -> DataFrame:
    """Every window of every text through a backend."""
    found = I.embed_windowed(t.documents, "doc_id", "text", _letter_shares, width=512, shards=8)
    return found.select("doc_id", "windows", r(F.col("embedding")[0], 6).alias("e"), r(F.col("embedding")[1], 6).alias("n"))


@query("i06_context_audit", "SELECT source, round(quantile_cont(length(text), 0.95), 6) AS p95, count(*) FILTER (length(text) > 2048) AS n_over FROM documents GROUP BY 1")
def i06(t: Tables) -> DataFrame:
    over = t.documents.groupBy("source").agg(F.count_if(F.length("text") > 2048).alias("n_over"))
    return over.join(quantiles(t.documents, ["source"], F.length("text"), {"p95": 0.95}), "source", "left").select("source", r("p95", 6).alias("p95"), "n_over")


@query("v08_open_set_invariants", f"{_HOLD}, v AS (SELECT vec_id // 4 AS grp, label, part FROM embeddings JOIN hold USING (label)), n AS (SELECT 'label' AS c, CAST(label AS VARCHAR) AS v, count(DISTINCT part) AS k FROM v GROUP BY 2 UNION ALL SELECT 'grp', CAST(grp AS VARCHAR), count(DISTINCT part) FROM v GROUP BY 2) SELECT c AS \"column\", count(*) AS n_values, count(*) FILTER (k > 1) AS n_crossing FROM n GROUP BY 1")
def v08(t: Tables) -> DataFrame:
    rows = t.embeddings.join(F.broadcast(S.class_holdout(t.embeddings, "label", 20, 4)), "label").withColumn("grp", F.floor(F.col("vec_id") / 4))
    return C.key_crossings(rows, ["label", "grp"], "part")


@query("v09_metric_table", "WITH m AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS v FROM events GROUP BY 1, 2) SELECT count(*) AS n_rows, count(*) FILTER (NOT isfinite(v)) AS n_not_finite, count(DISTINCT event_type) AS n_tasks FROM m")
def v09(t: Tables) -> DataFrame:
    m = t.events.groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return m.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.isnan("v") | (F.abs("v") == float("inf"))).alias("n_not_finite"), F.countDistinct("event_type").alias("n_tasks"))


_METRICS = """WITH m AS (SELECT event_type AS task, user_id % 4 AS method, user_id % 5 AS seed, avg(value) AS metric FROM events WHERE NOT (user_id % 4 = 1 AND user_id % 5 = 2 AND event_type = 'view') GROUP BY 1, 2, 3),
    p AS (SELECT DISTINCT event_type AS task, user_id % 4 AS method, user_id AS k FROM events WHERE user_id % 4 <> 3 OR user_id % 3 > 0), c AS (SELECT DISTINCT event_type AS task, user_id AS k FROM events WHERE user_id % 7 > 0)"""


@query("v09_results_contract", f"""{_METRICS}, r AS (SELECT DISTINCT task, method FROM m), w AS (SELECT r.task, method, k FROM r JOIN c USING (task))
    SELECT c AS "check", n AS observed, n = 0 AS passed FROM (SELECT 'other_seeds' AS c, count(*) AS n FROM (SELECT task, method FROM m GROUP BY 1, 2 HAVING count(DISTINCT seed) <> 5 OR count(*) <> 5)
      UNION ALL SELECT 'not_finite', count(*) FILTER (metric IS NULL OR NOT isfinite(metric)) FROM m
      UNION ALL SELECT 'missing_tasks', count(*) FROM (SELECT t.task, method FROM (SELECT DISTINCT method FROM m) CROSS JOIN (VALUES ('view'), ('click'), ('other')) t(task)) x ANTI JOIN r USING (task, method)
      UNION ALL SELECT 'unknown_tasks', count(*) FILTER (task NOT IN ('view', 'click', 'other')) FROM m
      UNION ALL SELECT 'repeated_predictions', 0 UNION ALL SELECT 'missing_predictions', count(*) FROM w ANTI JOIN p USING (task, method, k) UNION ALL SELECT 'unknown_predictions', count(*) FROM p ANTI JOIN w USING (task, method, k))""")
def v09r(t: Tables) -> DataFrame:
    """Results by task and method with seeds, predictions of them, and the cohort that they should cover."""
    e = t.events.withColumns({"task": F.col("event_type"), "method": F.col("user_id") % 4, "seed": F.col("user_id") % 5})
    results = e.where("NOT (method = 1 AND seed = 2 AND task = 'view')").groupBy("task", "method", "seed").agg(F.avg("value").alias("metric"))
    predictions = e.where("method <> 3 OR user_id % 3 > 0").select("task", "method", F.col("user_id").alias("k")).distinct()
    cohort = e.where("user_id % 7 > 0").select("task", F.col("user_id").alias("k"))
    return C.metric_table(results, "task", "method", "seed", "metric", tasks=["view", "click", "other"], seeds=5, predictions=predictions, cohort=cohort, key="k")


@query("v15_published_numbers", """WITH f AS (SELECT l_suppkey, count(*) AS every, count(*) FILTER (l_returnflag <> 'A') AS broad, count(*) FILTER (l_returnflag = 'R' OR (l_suppkey % 10 = 3 AND l_returnflag = 'A')) AS narrow FROM lineitem GROUP BY 1),
    i AS (SELECT l_returnflag AS g, l_linenumber AS m, avg(l_quantity) AS estimate, quantile_cont(l_quantity, 0.025) AS low, CASE WHEN l_linenumber = 7 THEN 20 ELSE quantile_cont(l_quantity, 0.975) END AS high FROM lineitem GROUP BY 1, 2)
    SELECT c AS "check", n AS observed, n = 0 AS passed FROM (SELECT 'funnel_order' AS c, count(*) FILTER (narrow <= 0 OR broad > every OR narrow > broad) AS n FROM f
      UNION ALL SELECT 'estimate_outside', count(*) FILTER (NOT (low < estimate AND estimate < high)) FROM i UNION ALL SELECT 'missing_groups', 1)""")
def v15n(t: Tables) -> DataFrame:
    """Funnels of each supplier, intervals of each flag and line, and a required group that isn't there."""
    flag = F.col("l_returnflag")
    funnel = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("every"), F.count_if(flag != "A").alias("broad"), F.count_if((flag == "R") | ((F.col("l_suppkey") % 10 == 3) & (flag == "A"))).alias("narrow"))
    limits = quantiles(t.lineitem, ["l_returnflag", "l_linenumber"], "l_quantity", {"low": 0.025, "high": 0.975})
    i = t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_quantity").alias("estimate")).join(limits, ["l_returnflag", "l_linenumber"])
    i = i.withColumn("high", F.when(F.col("l_linenumber") == 7, 20.0).otherwise(F.col("high")))
    return C.published_numbers(funnel, ["every", "broad", "narrow"], i, "l_returnflag", ["A", "N", "R", "X"])
