"""Queries on aggregates, windows, matrices, mapping, audits and the named compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import support_state
from tidemark.operators import contracts as C
from tidemark.operators import mapping as M
from tidemark.operators import matrix as X
from tidemark.operators.ranges import quantiles, ranked
from tidemark.plans.catalog_rows import ANNOTATED, annotated
from tidemark.plans.registry import Tables, query, r

_PAIRS = "SELECT l_partkey, CASE WHEN l_suppkey % 13 = 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS cluster, count(*) AS n_rows, bool_or(l_linenumber = 1) AS has_representative FROM lineitem GROUP BY 1, 2"
_CANON = f"""WITH p AS ({_PAIRS}), v AS (SELECT *, cluster <> '' AS ok FROM p),
    w AS (SELECT *, sum(CASE WHEN ok AND has_representative THEN 1 ELSE 0 END) OVER (PARTITION BY l_partkey) AS reps, max(CASE WHEN ok THEN n_rows END) OVER (PARTITION BY l_partkey) AS top FROM v),
    x AS (SELECT *, sum(CASE WHEN ok AND n_rows = top THEN 1 ELSE 0 END) OVER (PARTITION BY l_partkey) AS ties, row_number() OVER (PARTITION BY l_partkey ORDER BY ok DESC, has_representative DESC, n_rows DESC, cluster) AS k FROM w),
    canon AS (SELECT l_partkey, CASE WHEN ok THEN cluster ELSE '' END AS canonical, CASE WHEN NOT ok THEN 'missing_cluster' WHEN reps = 1 THEN 'representative_row' WHEN reps > 1 THEN 'representative_tiebreak' WHEN ties = 1 THEN 'largest_support' ELSE 'lexical_tiebreak' END AS reason FROM x WHERE k = 1)"""
_STATS = f"""{_CANON}, u AS (SELECT p_partkey AS l_partkey, p_size > 25 AS known, p_size < 15 AS unknown, p_type AS category FROM part),
    rows_ AS (SELECT cluster, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM p WHERE trim(cluster) NOT IN ('', '-', 'NA', 'nan') GROUP BY cluster),
    s AS (SELECT canonical AS cluster, count(*) AS n_units, count(*) FILTER (known) AS n_known, count(*) FILTER (unknown) AS n_unknown, coalesce(mode(nullif(trim(category), '') ORDER BY category), '') AS category FROM canon LEFT JOIN u USING (l_partkey) WHERE canonical <> '' GROUP BY canonical)
    SELECT rows_.cluster, n_rows, coalesce(n_units, 0) AS n_units, coalesce(n_known, 0) AS n_known, coalesce(n_unknown, 0) AS n_unknown, coalesce(category, '') AS category, round(coalesce(n_units, 0) / n_rows, 9) AS unit_ratio, round(n_unknown / nullif(n_units, 0), 9) AS unknown_share FROM rows_ LEFT JOIN s USING (cluster)"""


def link_pairs(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("cluster", F.when(F.col("l_suppkey") % 13 != 0, F.col("l_suppkey").cast("string")))
    return M.link_pairs(rows, "l_partkey", "cluster", F.col("l_linenumber") == 1)


@query("a01_pair_collapse", _PAIRS)
def a01(t: Tables) -> DataFrame:
    return link_pairs(t)


@query("a02_cardinality", f"WITH p AS ({_PAIRS}), n AS (SELECT l_partkey, count(DISTINCT nullif(cluster, '')) AS n FROM p GROUP BY 1) SELECT count(*) AS n_units, count(*) FILTER (n = 1) AS n_unique, count(*) FILTER (n > 1) AS n_multi, count(*) FILTER (n = 0) AS n_missing, max(n) AS most FROM n")
def a02(t: Tables) -> DataFrame:
    return M.cardinality(link_pairs(t), "l_partkey", "cluster")


@query("w01_canonical", f"{_CANON} SELECT * FROM canon")
def w01(t: Tables) -> DataFrame:
    return M.canonical(link_pairs(t), "l_partkey", "cluster")


@query("a03_cluster_statistics", _STATS)
def a03(t: Tables) -> DataFrame:
    units = t.part.select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") > 25).alias("known"), (F.col("p_size") < 15).alias("unknown"), F.col("p_type").alias("category"))
    s = M.cluster_statistics(link_pairs(t), units, "l_partkey", "cluster", "known", "unknown", "category")
    return s.withColumns({"unit_ratio": r("unit_ratio"), "unknown_share": r("unknown_share")}).select("cluster", "n_rows", "n_units", "n_known", "n_unknown", "category", "unit_ratio", "unknown_share")


_MAPPING = _STATS.replace("    SELECT rows_.cluster", """,
    k AS (SELECT cluster, count(*) AS n_pairs, count(*) FILTER (n > 1) AS n_shared_units FROM p JOIN (SELECT l_partkey, count(DISTINCT nullif(cluster, '')) AS n FROM p GROUP BY 1) USING (l_partkey) GROUP BY 1),
    y AS (SELECT canonical AS cluster, count(*) FILTER (reason = 'representative_row') AS by_representative, count(*) FILTER (reason = 'representative_tiebreak') AS by_tiebreak, count(*) FILTER (reason = 'largest_support') AS by_support, count(*) FILTER (reason = 'lexical_tiebreak') AS by_name FROM canon GROUP BY 1)
    SELECT rows_.cluster""").replace("unknown_share FROM rows_ LEFT JOIN s USING (cluster)", "unknown_share, n_pairs, n_shared_units, coalesce(by_representative, 0) AS by_representative, coalesce(by_tiebreak, 0) AS by_tiebreak, coalesce(by_support, 0) AS by_support, coalesce(by_name, 0) AS by_name FROM rows_ LEFT JOIN s USING (cluster) LEFT JOIN k USING (cluster) LEFT JOIN y USING (cluster)")


@query("q02_cluster_mapping", _MAPPING)
def q02(t: Tables) -> DataFrame:
    """Pairs, their cardinality, the canonical assignment with its reasons, and the statistics, by cluster."""
    pairs = link_pairs(t)
    several = pairs.groupBy("l_partkey").agg(F.count_distinct(F.nullif("cluster", F.lit(""))).alias("k"))
    shared = pairs.join(several, "l_partkey").groupBy("cluster").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("k") > 1).alias("n_shared_units"))
    reasons = {"representative_row": "by_representative", "representative_tiebreak": "by_tiebreak", "largest_support": "by_support", "lexical_tiebreak": "by_name"}
    chosen = M.canonical(pairs, "l_partkey", "cluster").groupBy(F.col("canonical").alias("cluster")).agg(*(F.count_if(F.col("reason") == k).alias(v) for k, v in reasons.items()))
    return a03(t).join(shared, "cluster", "left").join(chosen, "cluster", "left").fillna(0, [*reasons.values()])


@query("a04_stable_mode", "SELECT p_brand, coalesce(mode(nullif(trim(CASE WHEN p_size < 5 THEN ' ' ELSE p_type END), '') ORDER BY p_type), '') AS modal FROM part GROUP BY p_brand")
def a04(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(M.stable_mode(F.when(F.col("p_size") < 5, " ").otherwise(F.col("p_type"))).alias("modal"))


_MODAL = """WITH v AS (SELECT p_brand, 'p_type' AS "column", nullif(trim(CASE WHEN p_size < 5 THEN '' ELSE p_type END), '') AS value FROM part UNION ALL SELECT p_brand, 'size', CAST(p_size AS VARCHAR) FROM part),
    c AS (SELECT p_brand, "column", value, count(*) AS n FROM v GROUP BY 1, 2, 3),
    k AS (SELECT *, sum(n) OVER w AS t, sum(CASE WHEN value IS NOT NULL THEN n ELSE 0 END) OVER w AS f, row_number() OVER (PARTITION BY p_brand, "column" ORDER BY value IS NULL, n DESC, value) AS place FROM c WINDOW w AS (PARTITION BY p_brand, "column"))
    SELECT p_brand, "column", value AS modal, round(f / t, 9) AS coverage, CASE WHEN value IS NOT NULL THEN round(n / f, 9) END AS purity FROM k WHERE place = 1"""


@query("a05_modal_purity", _MODAL)
def a05(t: Tables) -> DataFrame:
    p = t.part.select("p_brand", F.when(F.col("p_size") < 5, "").otherwise(F.col("p_type")).alias("p_type"), F.col("p_size").cast("string").alias("size"))
    return M.modal_columns(p, "p_brand", ["p_type", "size"]).withColumns({"coverage": r("coverage"), "purity": r("purity")})


_RANKS = ("r1", "r2", "r3", "r4", "r5")
_TAXONOMY = """WITH b AS (SELECT p_brand AS g, CASE WHEN p_size < 5 THEN ' ' ELSE p_type END AS r1, CAST(p_size % 7 AS VARCHAR) AS r2, substr(p_name, 1, 7) AS r3, CASE WHEN p_size % 3 = 0 THEN 'third' END AS r4, '' AS r5, p_size > 25 AS big, p_retailprice > 1200 AS dear FROM part),
    v AS (SELECT g, unnest(['r1', 'r2', 'r3', 'r4', 'r5']) AS c, nullif(trim(unnest([r1, r2, r3, r4, r5])), '') AS value FROM b), c AS (SELECT g, c, value, count(*) AS n FROM v GROUP BY ALL),
    k AS (SELECT *, sum(n) OVER w AS t, sum(CASE WHEN value IS NOT NULL THEN n ELSE 0 END) OVER w AS f, row_number() OVER (PARTITION BY g, c ORDER BY value IS NULL, n DESC, value) AS place FROM c WINDOW w AS (PARTITION BY g, c)),
    m AS (SELECT g, c, value, round(f / t, 9) AS cov, CASE WHEN value IS NOT NULL THEN round(n / f, 9) END AS pur FROM k WHERE place = 1),
    x AS (SELECT g, """ + ", ".join(f"max(value) FILTER (c = '{k}') AS {k}_modal, max(cov) FILTER (c = '{k}') AS {k}_coverage, max(pur) FILTER (c = '{k}') AS {k}_purity" for k in _RANKS) + """ FROM m GROUP BY g)
    SELECT x.*, n, big_share, dear_share FROM x JOIN (SELECT g, count(*) AS n, round(avg(CAST(big AS INT)), 9) AS big_share, round(avg(CAST(dear AS INT)), 9) AS dear_share FROM b GROUP BY g) USING (g)"""


@query("a06_group_taxonomy", _TAXONOMY)
def a06(t: Tables) -> DataFrame:
    """Five ranks: mode, coverage and purity of each, and the means of two flags."""
    size = F.col("p_size")
    ranks = [F.when(size < 5, " ").otherwise(F.col("p_type")), (size % 7).cast("string"), F.substring("p_name", 1, 7), F.when(size % 3 == 0, "third"), F.lit("")]
    p = t.part.select(F.col("p_brand").alias("g"), *(c.alias(k) for k, c in zip(_RANKS, ranks, strict=True)), "p_size", "p_retailprice")
    out = M.group_taxonomy(p, "g", list(_RANKS), {"big_share": F.col("p_size") > 25, "dear_share": F.col("p_retailprice") > 1200})
    return out.withColumns({c: r(c) for c in out.columns if c.endswith(("_coverage", "_purity", "_share"))})


@query("a07_crosswalk", f"WITH a AS ({ANNOTATED}) SELECT a1 <> '-' AS stored, l_linenumber < 4 AS recomputed, category, count(*) AS n FROM a GROUP BY ALL")
def a07(t: Tables) -> DataFrame:
    return annotated(t).groupBy((F.col("a1") != "-").alias("stored"), (F.col("l_linenumber") < 4).alias("recomputed"), "category").agg(F.count(F.lit(1)).alias("n"))


@query("a08_filtered_sums", "SELECT l_suppkey, round(sum(l_quantity), 3) AS total, round(sum(l_quantity) FILTER (l_returnflag = 'R'), 3) AS returned, round(sum(l_quantity) FILTER (l_discount > 0.05), 3) AS cheap FROM lineitem GROUP BY 1")
def a08(t: Tables) -> DataFrame:
    part = lambda c: r(F.sum(F.when(c, F.col("l_quantity"))), 3)
    return t.lineitem.groupBy("l_suppkey").agg(r(F.sum("l_quantity"), 3).alias("total"), part(F.col("l_returnflag") == "R").alias("returned"), part(F.col("l_discount") > 0.05).alias("cheap"))


@query("a09_degree_histogram", "WITH d AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS degree FROM lineitem GROUP BY 1) SELECT degree, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY degree DESC) AS BIGINT) AS n_at_least FROM d GROUP BY degree")
def a09(t: Tables) -> DataFrame:
    d = t.lineitem.groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("n_at_least", F.sum("n").over(Window.orderBy(F.desc("degree"))))


@query("a10_group_prevalence", "SELECT l_shipdate IS NOT NULL AND l_linenumber > 3 AS late, l_linestatus, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS n_flag, round(avg(CAST(l_returnflag = 'R' AS INT)), 9) AS share FROM lineitem GROUP BY 1, 2")
def a10(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag") == "R"
    return t.lineitem.groupBy((F.col("l_shipdate").isNotNull() & (F.col("l_linenumber") > 3)).alias("late"), "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("n_flag"), r(F.avg(flag.cast("int"))).alias("share"))


@query("a11_value_counts", f"WITH a AS ({ANNOTATED}) SELECT coalesce(a3, '<MISSING>') AS value, count(*) AS n FROM a GROUP BY 1")
def a11(t: Tables) -> DataFrame:
    return annotated(t).groupBy(F.coalesce("a3", F.lit("<MISSING>")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("a12_distinct_counts", "SELECT count(DISTINCT l_orderkey) AS n1, count(DISTINCT l_partkey) AS n2, count(DISTINCT l_suppkey) AS n3 FROM lineitem")
def a12(t: Tables) -> DataFrame:
    return t.lineitem.agg(*(F.countDistinct(c).alias(n) for n, c in (("n1", "l_orderkey"), ("n2", "l_partkey"), ("n3", "l_suppkey"))))


@query(
    "a13_coverage_report",
    "WITH v AS (SELECT p_type, 'brand' AS rank, CASE WHEN p_size < 10 THEN '' ELSE p_brand END AS x FROM part UNION ALL SELECT p_type, 'name', p_name FROM part) SELECT 'all' AS universe, p_type AS category, rank, count(*) AS n, count(*) FILTER (x <> '') AS annotated, round(count(*) FILTER (x <> '') / count(*), 9) AS ratio FROM v GROUP BY 2, 3 UNION ALL SELECT 'total', 'any', rank, count(*), count(*) FILTER (x <> ''), round(count(*) FILTER (x <> '') / count(*), 9) FROM v GROUP BY 3",
)
def a13(t: Tables) -> DataFrame:
    entries = F.array(F.struct(F.lit("brand").alias("rank"), F.when(F.col("p_size") < 10, "").otherwise(F.col("p_brand")).alias("x")), F.struct(F.lit("name").alias("rank"), F.col("p_name").alias("x")))
    v = t.part.select("p_type", F.explode(entries).alias("e")).select("p_type", "e.*")
    filled = F.count_if(F.col("x") != "")
    one = lambda universe, category: v.groupBy(category.alias("category"), "rank").agg(F.count(F.lit(1)).alias("n"), filled.alias("annotated"), r(filled / F.count(F.lit(1))).alias("ratio")).withColumn("universe", F.lit(universe))
    return one("all", F.col("p_type")).unionByName(one("total", F.lit("any")))


@query("a14_group_quantiles", "SELECT l_suppkey, count(*) AS n, round(avg(l_quantity), 9) AS mean, round(quantile_cont(l_quantity, 0.5), 9) AS median, round(quantile_cont(l_quantity, 0.25), 9) AS q25, round(quantile_cont(l_quantity, 0.75), 9) AS q75, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY 1")
def a14(t: Tables) -> DataFrame:
    facts = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), r(F.avg("l_quantity")).alias("mean"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))
    q = quantiles(t.lineitem, ["l_suppkey"], "l_quantity", {"median": 0.5, "q25": 0.25, "q75": 0.75})
    return facts.join(q, "l_suppkey", "left").withColumns({c: r(c) for c in ("median", "q25", "q75")})


_MONTHS = "WITH m AS (SELECT l_suppkey, x.month, coalesce(sum(l_quantity), 0) AS q, coalesce(avg(CAST(l_discount > 0 AS INT)), 0) AS d FROM (SELECT DISTINCT l_suppkey FROM lineitem) s CROSS JOIN (SELECT unnest(range(1, 13)) AS month) x LEFT JOIN lineitem l USING (l_suppkey) WHERE month(l_shipdate) = x.month OR l_shipdate IS NULL GROUP BY 1, 2), f AS (SELECT s.l_suppkey, x.month, coalesce(q, 0) AS q, coalesce(d, 0) AS d FROM (SELECT DISTINCT l_suppkey FROM lineitem) s CROSS JOIN (SELECT unnest(range(1, 13)) AS month) x LEFT JOIN m USING (l_suppkey, month))"


def month_matrix(t: Tables) -> DataFrame:
    """Supplier by month: summed quantity and share of discounted lines as two arrays."""
    cell = t.lineitem.groupBy("l_suppkey", F.month("l_shipdate").alias("month")).agg(F.sum("l_quantity").alias("q"), F.avg((F.col("l_discount") > 0).cast("int")).alias("d"))
    maps = cell.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("month", F.struct("q", "d")))).alias("m"))
    at = lambda f: F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.coalesce(F.try_element_at("m", i)[f], F.lit(0.0)))
    return maps.select("l_suppkey", at("q").alias("value"), at("d").alias("detection"))


@query(
    "a15_matrix_summary",
    f"{_MONTHS}, c AS (SELECT l_suppkey, CASE WHEN d >= 0.9 THEN q ELSE 0 END AS v FROM f) SELECT l_suppkey, count(*) AS n, count(*) FILTER (v <> 0) AS n_nonzero, round(count(*) FILTER (v <> 0) / count(*), 9) AS prevalence, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(var_pop(v), 5) AS variance, max(v) AS largest FROM c GROUP BY 1",
)
def a15(t: Tables) -> DataFrame:
    m = month_matrix(t).withColumn("v", X.detected(F.col("value"), F.col("detection"), 0.9))
    s = X.row_summary(F.col("v"))
    digits = {"prevalence": 9, "mean": 6, "median": 6, "variance": 5}
    return m.select("l_suppkey", *(r(c, digits[k]).alias(k) if k in digits else c.alias(k) for k, c in s.items()))


_SPEC = """WITH m AS (SELECT l_suppkey, l_returnflag AS g, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2), s AS (SELECT *, m / sum(m) OVER (PARTITION BY l_suppkey) AS p, count(*) OVER (PARTITION BY l_suppkey) AS k FROM m)
    SELECT l_suppkey, max(k) AS n_groups, round(1 + sum(p * ln(p)) / nullif(ln(max(k)), 0), 9) AS specificity, arg_max(g, m) AS dominant, round(max(p), 9) AS dominant_share FROM s GROUP BY 1"""


@query("a16_entropy_specificity", _SPEC)
def a16(t: Tables) -> DataFrame:
    return X.entropy_specificity(t.lineitem, "l_suppkey", "l_returnflag", "l_quantity").withColumns({"specificity": r("specificity"), "dominant_share": r("dominant_share")})


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(
    "a17_composition",
    "WITH c AS (SELECT l_suppkey, l_returnflag AS c, count(*) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY l_suppkey) AS p, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, c) AS k FROM c) SELECT l_suppkey, CAST(sum(n) AS BIGINT) AS n, round(coalesce(max(p) FILTER (c = 'A'), 0), 9) AS share_0, round(coalesce(max(p) FILTER (c = 'N'), 0), 9) AS share_1, round(coalesce(max(p) FILTER (c = 'R'), 0), 9) AS share_2, round(sum(-p * ln(p)), 9) AS entropy, max(c) FILTER (k = 1) AS dominant FROM p GROUP BY 1",
)
def a17(t: Tables) -> DataFrame:
    c = X.composition(t.lineitem, ["l_suppkey"], "l_returnflag", ["A", "N", "R"])
    return c.select("l_suppkey", "n", *(r(f"share_{i}").alias(f"share_{i}") for i in range(3)), r("entropy").alias("entropy"), "dominant")


@query("a18_stratum_counts", "SELECT l_linestatus, l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def a18(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_linestatus", "l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("a19_stacked_groupings", "SELECT 'l_linestatus' AS grouping_name, l_linestatus AS value, count(*) AS n, count(*) FILTER (l_tax > 0) AS valid, round(count(*) FILTER (NOT l_tax > 0) / count(*), 9) AS invalid_share FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_returnflag', l_returnflag, count(*), count(*) FILTER (l_tax > 0), round(count(*) FILTER (NOT l_tax > 0) / count(*), 9) FROM lineitem GROUP BY 2")
def a19(t: Tables) -> DataFrame:
    t.lineitem.createOrReplaceTempView("tidemark_lineitem")
    return t.spark.sql("""SELECT CASE WHEN grouping(l_linestatus) = 0 THEN 'l_linestatus' ELSE 'l_returnflag' END AS grouping_name, coalesce(l_linestatus, l_returnflag) AS value, count(*) AS n,
        count_if(l_tax > 0) AS valid, round(count_if(NOT l_tax > 0) / count(*), 9) AS invalid_share FROM tidemark_lineitem GROUP BY GROUPING SETS ((l_linestatus), (l_returnflag))""")


@query("a20_reason_examples", "WITH e AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem WHERE l_discount > 0.08) SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey FROM e WHERE k <= 3")
def a20(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    place = F.row_number().over(Window.partitionBy("l_returnflag").orderBy(*keys))
    return t.lineitem.where("l_discount > 0.08").withColumn("place", place).where("place <= 3").select("l_returnflag", *keys)


_CELLS = "SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c, count(*) FILTER (quality = 0 AND toxic = 0) AS d FROM labels"


@query("a21_association", f"WITH x AS ({_CELLS}) SELECT a, b, c, d, round((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)), 9) AS odds_ratio, round((a / nullif(a + b, 0)) / nullif(c / nullif(c + d, 0), 0), 9) AS risk_ratio FROM x")
def a21(t: Tables) -> DataFrame:
    cell = lambda q, x: F.count_if((F.col("quality") == q) & (F.col("toxic") == x))
    x = t.labels.agg(cell(1, 1).alias("a"), cell(1, 0).alias("b"), cell(0, 1).alias("c"), cell(0, 0).alias("d"))
    a, b, c, d = (F.col(k) for k in "abcd")
    return x.withColumns({"odds_ratio": r((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))), "risk_ratio": r(F.try_divide(F.try_divide(a, a + b), F.try_divide(c, c + d)))})


@query("a22_cluster_mixing", "WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag) AS k1, count(DISTINCT l_linestatus) AS k2 FROM lineitem GROUP BY 1) SELECT count(*) AS n_clusters, count(*) FILTER (n = 1) AS n_single, max(n) AS largest, count(*) FILTER (k1 > 1) AS mixed_1, count(*) FILTER (k2 > 1) AS mixed_2 FROM g")
def a22(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_returnflag").alias("k1"), F.countDistinct("l_linestatus").alias("k2"))
    return g.agg(F.count(F.lit(1)).alias("n_clusters"), F.count_if(F.col("n") == 1).alias("n_single"), F.max("n").alias("largest"), F.count_if(F.col("k1") > 1).alias("mixed_1"), F.count_if(F.col("k2") > 1).alias("mixed_2"))


@query("a23_mean_difference", "WITH s AS (SELECT l_suppkey, avg(l_quantity) FILTER (l_linestatus = 'F') AS m1, avg(l_quantity) FILTER (l_linestatus = 'O') AS m2, var_samp(l_quantity) FILTER (l_linestatus = 'F') AS v1, var_samp(l_quantity) FILTER (l_linestatus = 'O') AS v2 FROM lineitem GROUP BY 1) SELECT l_suppkey, round(CASE WHEN v1 + v2 = 0 THEN 0 ELSE (m1 - m2) / sqrt((v1 + v2) / 2) END, 8) AS smd FROM s")
def a23(t: Tables) -> DataFrame:
    of = lambda f, s: f(F.when(F.col("l_linestatus") == s, F.col("l_quantity")))
    s = t.lineitem.groupBy("l_suppkey").agg(of(F.avg, "F").alias("m1"), of(F.avg, "O").alias("m2"), of(F.var_samp, "F").alias("v1"), of(F.var_samp, "O").alias("v2"))
    pooled = F.sqrt((F.col("v1") + F.col("v2")) / 2)
    return s.select("l_suppkey", r(F.when(pooled == 0, 0.0).otherwise((F.col("m1") - F.col("m2")) / pooled), 8).alias("smd"))


@query("a24_seed_aggregation", "SELECT event_type, count(*) AS n, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS sd FROM events GROUP BY 1")
def a24(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value"), 8).alias("mean"), r(F.stddev_samp("value"), 8).alias("sd"))


@query("a25_pivot_deltas", "WITH p AS (SELECT l_suppkey, avg(l_quantity) FILTER (l_linestatus = 'F') AS f, avg(l_quantity) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1) SELECT l_suppkey, round(f, 8) AS f, round(o, 8) AS o, round(f - o, 8) AS delta, f > o AS f_wins FROM p WHERE f IS NOT NULL AND o IS NOT NULL")
def a25(t: Tables) -> DataFrame:
    cells = t.lineitem.groupBy("l_suppkey", "l_linestatus").agg(F.avg("l_quantity").alias("m"))
    p = X.pivoted(cells, ["l_suppkey"], "l_linestatus", ["F", "O"], "m").dropna()
    return p.select("l_suppkey", r("F", 8).alias("f"), r("O", 8).alias("o"), r(F.col("F") - F.col("O"), 8).alias("delta"), (F.col("F") > F.col("O")).alias("f_wins"))


@query("a26_crosstab", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")
def a26(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("a27_rule_agreement", "SELECT round(avg(CAST(quality = toxic AS INT)), 9) AS agreement, count(*) AS n FROM labels")
def a27(t: Tables) -> DataFrame:
    return t.labels.agg(r(F.avg((F.col("quality") == F.col("toxic")).cast("int"))).alias("agreement"), F.count(F.lit(1)).alias("n"))


@query("a28_universes", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 20), b AS (SELECT p_partkey AS k FROM part WHERE p_size < 40) SELECT count(*) AS n_union, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS n_common, count(*) FILTER (b.k IS NULL) AS n_left_only, count(*) FILTER (a.k IS NULL) AS n_right_only FROM a FULL JOIN b ON a.k = b.k")
def a28(t: Tables) -> DataFrame:
    return M.universes(t.lineitem.where("l_quantity > 20").select(F.col("l_partkey").alias("k")), t.part.where("p_size < 40").select(F.col("p_partkey").alias("k")), "k")


@query("a29_size_percentiles", "SELECT lang, round(quantile_cont(length(text), 0.5), 6) AS p50, round(quantile_cont(length(text), 0.9), 6) AS p90, round(quantile_cont(length(text), 0.999), 6) AS p999, round(avg(CAST(length(text) > 4096 AS INT)), 9) AS over FROM documents GROUP BY lang")
def a29(t: Tables) -> DataFrame:
    n = F.length("text")
    q = quantiles(t.documents, ["lang"], n, {"p50": 0.5, "p90": 0.9, "p999": 0.999})
    over = t.documents.groupBy(F.col("lang").alias("__lang")).agg(r(F.avg((n > 4096).cast("int"))).alias("over"))
    return over.join(q, C.same(["__lang"], ["lang"]), "left").select(F.col("__lang").alias("lang"), *(r(c, 6).alias(c) for c in ("p50", "p90", "p999")), "over")


_FAMILY = "WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax - 0.04 AS s1, l_discount - 0.05 AS s2, (l_quantity - 25) / 500 AS s3 FROM lineitem)"


def _family(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_tax") - 0.04).alias("s1"), (F.col("l_discount") - 0.05).alias("s2"), ((F.col("l_quantity") - 25) / 500).alias("s3"))


@query("a30_best_two", f"{_FAMILY} SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(s1, s2, s3), 9) AS best, CASE WHEN s1 >= s2 AND s1 >= s3 THEN 's1' WHEN s2 >= s3 THEN 's2' ELSE 's3' END AS best_name, round(s1 + s2 + s3 - greatest(s1, s2, s3) - least(s1, s2, s3), 9) AS second FROM f")
def a30(t: Tables) -> DataFrame:
    b = X.best_two(["s1", "s2", "s3"])
    return _family(t).select("l_orderkey", "l_linenumber", "l_partkey", r(b["best"]).alias("best"), b["best_name"].alias("best_name"), r(b["second"]).alias("second"))


@query("a31_group_scores", f"{_FAMILY} SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(s1, 0) + greatest(s2, 0), 9) AS a, round(greatest(s3, 0), 9) AS b, CASE WHEN greatest(s1, 0) + greatest(s2, 0) >= greatest(s3, 0) THEN 'a' ELSE 'b' END AS winner FROM f")
def a31(t: Tables) -> DataFrame:
    s = _family(t).withColumns(X.group_scores({"a": ["s1", "s2"], "b": ["s3"]}))
    return s.select("l_orderkey", "l_linenumber", "l_partkey", r("a").alias("a"), r("b").alias("b"), X.best_two(["a", "b"])["best_name"].alias("winner"))


@query("a32_row_counts", f"{_FAMILY} SELECT l_orderkey, l_linenumber, l_partkey, CAST(s1 < 0 AS BIGINT) + CAST(s2 < 0 AS BIGINT) + CAST(s3 < 0 AS BIGINT) AS n_negative, round(least(s1, s2, s3), 9) AS least, round(greatest(s1, s2, s3), 9) AS largest FROM f")
def a32(t: Tables) -> DataFrame:
    c = X.row_counts(["s1", "s2", "s3"])
    return _family(t).select("l_orderkey", "l_linenumber", "l_partkey", c["n_negative"].alias("n_negative"), r(c["least"]).alias("least"), r(c["largest"]).alias("largest"))


@query("a33_first_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def a33(t: Tables) -> DataFrame:
    return M.first_by(t.events, ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", "event_id", "event_type")


@query("w05_running_count", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS place FROM lineitem")
def w05(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    placed = ranked(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "place")
    return placed.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("place") - 1).alias("place"))


@query("w06_partition_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events")
def w06(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.count(F.lit(1)).over(Window.partitionBy("user_id", "event_type")).alias("n"))


@query("w07_share_of_total", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, event_type, round(n / sum(n) OVER (PARTITION BY user_id), 9) AS share FROM c")
def w07(t: Tables) -> DataFrame:
    c = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return c.select("user_id", "event_type", r(F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).alias("share"))


@query("w08_change", "WITH m AS (SELECT l_linestatus, year(l_shipdate) AS stage, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_linestatus, stage, n, round(n / lag(n) OVER (PARTITION BY l_linestatus ORDER BY stage) - 1, 9) AS change FROM m")
def w08(t: Tables) -> DataFrame:
    m = t.lineitem.groupBy("l_linestatus", F.year("l_shipdate").cast("long").alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    return m.withColumn("change", r(F.col("n") / F.lag("n").over(Window.partitionBy("l_linestatus").orderBy("stage")) - 1))


@query("w09_first_after_sort", "SELECT l_partkey, l_suppkey, max(l_extendedprice) AS top FROM lineitem GROUP BY 1, 2")
def w09(t: Tables) -> DataFrame:
    return M.first_by(t.lineitem, ["l_partkey", "l_suppkey"], F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")).select("l_partkey", "l_suppkey", F.col("l_extendedprice").alias("top"))


@query("w10_contiguity", "WITH p AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings) SELECT label, count(*) AS n_rows, count(*) FILTER (k <> vec_id) AS n_out_of_place FROM p GROUP BY 1")
def w10(t: Tables) -> DataFrame:
    return C.contiguity(t.embeddings, "label", "vec_id")


@query("w11_rank_in_group", "WITH m AS (SELECT l_linestatus, l_returnflag, avg(l_quantity) AS s FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY s DESC, l_returnflag) AS k FROM m) SELECT l_linestatus, max(l_returnflag) FILTER (k = 1) AS best, CAST(max(k) FILTER (l_returnflag = 'R') AS INTEGER) AS rank_of_r FROM k GROUP BY 1")
def w11(t: Tables) -> DataFrame:
    m = t.lineitem.groupBy("l_linestatus", "l_returnflag").agg(F.avg("l_quantity").alias("s"))
    k = m.withColumn("k", F.row_number().over(Window.partitionBy("l_linestatus").orderBy(F.desc("s"), "l_returnflag")))
    return k.groupBy("l_linestatus").agg(F.max(F.when(F.col("k") == 1, F.col("l_returnflag"))).alias("best"), F.max(F.when(F.col("l_returnflag") == "R", F.col("k"))).alias("rank_of_r"))


@query("w12_group_size", "SELECT vec_id, vec_id // 4 AS grp, count(*) OVER (PARTITION BY vec_id // 4) AS size FROM embeddings")
def w12(t: Tables) -> DataFrame:
    g = F.floor(F.col("vec_id") / 4)
    return t.embeddings.select("vec_id", g.alias("grp")).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("grp")))


@query("v02_vector_contract", "SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_ids, min(len(embedding)) AS least_width, max(len(embedding)) AS largest_width, count(*) FILTER (len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) > 0) AS n_not_finite, count(*) FILTER (list_sum([x * x FOR x IN embedding]) = 0) AS n_zero FROM embeddings")
def v02(t: Tables) -> DataFrame:
    return C.vector_contract(t.embeddings, "vec_id", "embedding")


@query("v05_split_leakage", "WITH v AS (SELECT CASE WHEN l_orderkey % 10 < 7 THEN 'train' ELSE 'test' END AS part, l_orderkey, l_partkey FROM lineitem), x AS (SELECT part, 'l_orderkey' AS c, l_orderkey AS v FROM v UNION ALL SELECT part, 'l_partkey', l_partkey FROM v), n AS (SELECT c, v, count(DISTINCT part) AS k FROM x GROUP BY 1, 2) SELECT c AS \"column\", count(*) AS n_values, count(*) FILTER (k > 1) AS n_crossing FROM n GROUP BY 1")
def v05(t: Tables) -> DataFrame:
    v = t.lineitem.select(F.when(F.col("l_orderkey") % 10 < 7, "train").otherwise("test").alias("part"), "l_orderkey", "l_partkey")
    return C.key_crossings(v, ["l_orderkey", "l_partkey"], "part")


@query("v06_pool_contract", "WITH c AS (SELECT count(*) - count(DISTINCT p_partkey) AS repeated, count(*) FILTER (p_brand IS NULL) AS no_brand, count(*) FILTER (p_size > 50) AS too_large, count(DISTINCT p_type) AS types FROM part) SELECT 'repeated' AS \"check\", repeated AS observed, 0::BIGINT AS expected, repeated = 0 AS passed FROM c UNION ALL SELECT 'no_brand', no_brand, 0, no_brand = 0 FROM c UNION ALL SELECT 'too_large', too_large, 0, too_large = 0 FROM c UNION ALL SELECT 'types', types, 6, types = 6 FROM c")
def v06(t: Tables) -> DataFrame:
    return C.checks(t.part, {"repeated": (F.count(F.lit(1)) - F.countDistinct("p_partkey"), 0), "no_brand": (F.count_if(F.col("p_brand").isNull()), 0), "too_large": (F.count_if(F.col("p_size") > 50), 0), "types": (F.countDistinct("p_type"), 6)})


@query("v07_variable_mapping", "WITH m AS (SELECT * FROM (VALUES ('l_tax', 'g1'), ('l_discount', 'g1'), ('l_discount', 'g2'), ('l_other', 'g2')) AS m(v, g)), f AS (SELECT 'l_tax' AS v, count(l_tax) AS n FROM lineitem UNION ALL SELECT 'l_discount', count(l_discount) FROM lineitem UNION ALL SELECT 'l_quantity', count(l_quantity) FROM lineitem) SELECT coalesce(f.v, m.v) AS variable, f.v IS NULL AS unexpected, m.v IS NULL AS missing, coalesce(k, 0) > 1 AS duplicated FROM f FULL JOIN (SELECT v, count(*) AS k FROM m GROUP BY v) m ON f.v = m.v")
def v07(t: Tables) -> DataFrame:
    m = t.spark.createDataFrame([("l_tax", "g1"), ("l_discount", "g1"), ("l_discount", "g2"), ("l_other", "g2")], "variable string, g string").groupBy("variable").agg(F.count(F.lit(1)).alias("k"))
    cols = ["l_tax", "l_discount", "l_quantity"]
    f = t.lineitem.agg(*(F.count(c).alias(c) for c in cols)).select(F.explode(F.array(*map(F.lit, cols))).alias("variable")).withColumn("found", F.lit(True))
    return f.join(m, "variable", "full").select("variable", F.col("found").isNull().alias("unexpected"), F.col("k").isNull().alias("missing"), (F.coalesce("k", F.lit(0)) > 1).alias("duplicated"))


_FLAGS = f"""WITH a AS ({ANNOTATED}), b AS (SELECT *, trim(a1) NOT IN ('', '-', 'NA', 'nan') OR trim(a2) NOT IN ('', '-', 'NA', 'nan') OR trim(coalesce(a3, '')) NOT IN ('', '-', 'NA', 'nan') AS annotated, CASE WHEN category = 'SINGL' THEN single ELSE category END AS e FROM a),
    f AS (SELECT *, coalesce(e IN ('K', 'KWP'), false) AS kn, coalesce(e IN ('GU', 'EU'), false) AS un FROM b),
    g AS (SELECT *, annotated AND kn AS strict_known, NOT annotated AND un AS strict_unknown, NOT annotated AS broad_unknown, a1 <> '-' AND category IN ('K', 'KWP') AS stored_known, a1 = '-' AND a2 = ' NA ' AS stored_unknown FROM f)"""


@query("v10_label_audit", f"""{_FLAGS} SELECT count(*) AS n, count(*) FILTER (strict_known IS DISTINCT FROM stored_known) AS known_differs, count(*) FILTER (strict_unknown IS DISTINCT FROM stored_unknown) AS unknown_differs, count(*) FILTER (strict_known AND strict_unknown) AS in_both,
    count(*) FILTER (strict_known AND NOT annotated) AS known_without_annotation, count(*) FILTER (strict_unknown AND NOT broad_unknown) AS unknown_outside_broad, count(*) FILTER (stored_known AND stored_unknown) AS stored_in_both, count(*) FILTER (stored_unknown AND NOT broad_unknown) AS stored_outside_broad FROM g""")
def v10(t: Tables) -> DataFrame:
    """Recomputed against stored flags, exclusivity and subset rules."""
    from tidemark.functions.labels import function_flags

    stored = {"stored_known": (F.col("a1") != "-") & F.col("category").isin("K", "KWP"), "stored_unknown": (F.col("a1") == "-") & (F.col("a2") == " NA ")}
    rows = annotated(t).withColumns(stored).withColumns(function_flags(["a1", "a2", "a3"], "category", "single"))
    return C.label_audit(rows, "annotated", ("strict_known", "stored_known"), ("strict_unknown", "stored_unknown"), "broad_unknown")


@query("v11_value_bounds", "SELECT count(*) FILTER (l_discount < 0 OR l_discount > 1) AS out_of_bounds, count(*) FILTER (NOT isfinite(l_extendedprice)) AS not_finite, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) AS joined FROM lineitem")
def v11(t: Tables) -> DataFrame:
    d, p = F.col("l_discount"), F.col("l_extendedprice")
    one = t.lineitem.agg(F.count_if((d < 0) | (d > 1)).alias("out_of_bounds"), F.count_if(F.isnan(p) | (F.abs(p) == float("inf"))).alias("not_finite"))
    joined = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").agg(F.count(F.lit(1)).alias("joined"))
    return one.crossJoin(F.broadcast(joined))


@query("v12_mapping_contract", "WITH p AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT l_partkey, count(*) AS groups FROM p GROUP BY 1) SELECT (SELECT count(*) FROM p WHERE n > 1) AS duplicate_pairs, (SELECT count(*) FROM k WHERE groups > 1) AS keys_in_several, (SELECT count(*) FROM k) AS n_keys")
def v12(t: Tables) -> DataFrame:
    p = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    k = p.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("dups"))
    return k.agg(F.sum("dups").alias("duplicate_pairs"), F.count_if(F.col("groups") > 1).alias("keys_in_several"), F.count(F.lit(1)).alias("n_keys"))


@query("v13_sample_partition", "SELECT CASE WHEN n_regionkey IN (0, 1) THEN 'FL' ELSE 'ATT' END AS side, count(*) AS n_samples, count(DISTINCT n_nationkey) AS n_ids FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def v13(t: Tables) -> DataFrame:
    j = C.checked_join(t.nation.withColumnRenamed("n_regionkey", "r_regionkey"), t.region, ["r_regionkey"], validate="many_to_one")
    return j.groupBy(F.when(F.col("r_regionkey").isin(0, 1), "FL").otherwise("ATT").alias("side")).agg(F.count(F.lit(1)).alias("n_samples"), F.countDistinct("n_nationkey").alias("n_ids"))


@query("v14_table_contract", "SELECT count(*) - count(DISTINCT o_orderkey) AS repeated, count(*) FILTER (o_totalprice IS NULL) AS no_metric, count(*) FILTER (o_totalprice < 0) AS negative FROM orders")
def v14(t: Tables) -> DataFrame:
    return t.orders.agg((F.count(F.lit(1)) - F.countDistinct("o_orderkey")).alias("repeated"), F.count_if(F.col("o_totalprice").isNull()).alias("no_metric"), F.count_if(F.col("o_totalprice") < 0).alias("negative"))


@query("v15_interval_sanity", "WITH c AS (SELECT l_suppkey, avg(l_quantity) AS m, quantile_cont(l_quantity, 0.025) AS lo, quantile_cont(l_quantity, 0.975) AS hi FROM lineitem GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (m < lo OR m > hi) AS n_outside FROM c")
def v15(t: Tables) -> DataFrame:
    c = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("m")).join(quantiles(t.lineitem, ["l_suppkey"], "l_quantity", {"low": 0.025, "high": 0.975}), "l_suppkey")
    return c.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("m") < F.col("low")) | (F.col("m") > F.col("high"))).alias("n_outside"))


@query("v16_table_digest")
def v16(t: Tables) -> DataFrame:
    return C.table_digest(t.lineitem).select("n_rows", F.col("digest").cast("string").alias("digest"))


@query("q01_registry", f"WITH a AS ({ANNOTATED}), b AS (SELECT *, CASE WHEN category = 'SINGL' THEN single ELSE category END AS e, (trim(a1) NOT IN ('', '-', 'NA', 'nan')) OR (trim(a2) NOT IN ('', '-', 'NA', 'nan')) OR (trim(coalesce(a3, '')) NOT IN ('', '-', 'NA', 'nan')) AS s FROM a WHERE l_linenumber = 1) SELECT l_orderkey, l_partkey, s AS annotated, s AND coalesce(e IN ('K', 'KWP'), false) AS strict_known FROM b")
def q01(t: Tables) -> DataFrame:
    from tidemark.plans.pipelines import registry

    return registry(annotated(t), F.col("l_linenumber") == 1, ["a1", "a2", "a3"], "category", "single").select("l_orderkey", "l_partkey", "annotated", "strict_known")


@query("q04_matrix_transpose", _MONTHS + " SELECT month, round(sum(q), 3) AS total, count(*) FILTER (q > 0) AS n_positive FROM f GROUP BY month")
def q04(t: Tables) -> DataFrame:
    long = month_matrix(t).select("l_suppkey", F.posexplode("value").alias("p", "q"))
    return long.groupBy((F.col("p") + 1).cast("long").alias("month")).agg(r(F.sum("q"), 3).alias("total"), F.count_if(F.col("q") > 0).alias("n_positive"))


@query("q05_specificity_projection", f"WITH s AS ({_SPEC}), k AS (SELECT s_suppkey AS l_suppkey, s_nationkey FROM supplier) SELECT s_nationkey, count(specificity) AS n, round(avg(specificity), 8) AS mean, round(quantile_cont(specificity, 0.5), 8) AS median FROM s JOIN k USING (l_suppkey) GROUP BY 1")
def q05(t: Tables) -> DataFrame:
    s = X.entropy_specificity(t.lineitem, "l_suppkey", "l_returnflag", "l_quantity").withColumn("specificity", r("specificity"))
    j = C.checked_join(s, t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), ["l_suppkey"])
    facts = j.groupBy("s_nationkey").agg(F.count("specificity").alias("n"), r(F.avg("specificity"), 8).alias("mean"))
    return facts.join(quantiles(j, ["s_nationkey"], "specificity", {"median": 0.5}), "s_nationkey", "left").withColumn("median", r("median", 8))


_COVARIATES = """WITH k AS (SELECT c_custkey, c_mktsegment AS g, TRY_CAST(nullif(regexp_extract(c_name, '#0*([1-9][0-9]*)$', 1), '') AS BIGINT) AS contig, CASE c_custkey % 3 WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'Asia ' END AS domain FROM customer),
    l AS (SELECT c_custkey AS contig, CASE WHEN c_custkey % 7 = 0 THEN 'unclassified' ELSE concat_ws('; ', 'root', r_name, n_name) END AS lineage FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 5 <> 0),
    j AS (SELECT g, domain, CASE WHEN lower(trim(coalesce(lineage, ''))) IN ('', 'root', 'unclassified') THEN '' ELSE trim(string_split(lineage, ';')[2]) END AS rank0, CASE WHEN lower(trim(coalesce(lineage, ''))) IN ('', 'root', 'unclassified') THEN '' ELSE trim(string_split(lineage, ';')[3]) END AS rank1 FROM k LEFT JOIN l USING (contig)),
    b AS (SELECT *, coalesce(domain, '') <> '' AND rank0 <> '' AND lower(trim(domain)) <> lower(trim(rank0)) AS conflicts FROM j),
    v AS (SELECT g, unnest(['rank0', 'rank1']) AS rank, nullif(unnest([rank0, rank1]), '') AS value FROM b), c AS (SELECT g, rank, value, count(*) AS n FROM v GROUP BY ALL),
    m AS (SELECT *, sum(n) OVER w AS t, sum(CASE WHEN value IS NOT NULL THEN n ELSE 0 END) OVER w AS f, row_number() OVER (PARTITION BY g, rank ORDER BY value IS NULL, n DESC, value) AS place FROM c WINDOW w AS (PARTITION BY g, rank))
    SELECT g, rank, value AS modal, round(f / t, 9) AS coverage, CASE WHEN value IS NOT NULL THEN round(n / f, 9) END AS purity, CAST(t AS BIGINT) AS n_rows, CAST(f AS BIGINT) AS n_annotated, conflict_share FROM m JOIN (SELECT g, round(avg(CAST(conflicts AS INT)), 9) AS conflict_share FROM b GROUP BY g) USING (g) WHERE place = 1"""


@query("q10_taxonomy_covariates", _COVARIATES)
def q10(t: Tables) -> DataFrame:
    """Contig key, lineage join, ranks, conflict with the stored domain, group taxonomy, and coverage of each rank."""
    from tidemark.plans.pipelines import taxonomy_covariates

    n = F.col("c_custkey") % 3
    records = t.customer.select(F.col("c_mktsegment").alias("g"), "c_name", F.when(n == 0, "AFRICA").when(n == 1, "Asia ").alias("domain"))
    places = t.customer.where("c_custkey % 5 <> 0").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    lineage = F.when(F.col("c_custkey") % 7 == 0, "unclassified").otherwise(F.concat_ws("; ", F.lit("root"), "r_name", "n_name"))
    out = taxonomy_covariates(records, places.select(F.col("c_custkey").cast("string").alias("contig"), lineage.alias("lineage")), "g", "c_name", r"#0*([1-9][0-9]*)$", "domain", 2)
    return out.withColumns({c: r(c) for c in ("coverage", "purity", "conflict_share")})


@query("q11_report_numbers", "WITH m AS (SELECT event_type, count(*) AS n, round(avg(value), 8) AS mean, max(value) AS top FROM events GROUP BY 1) SELECT event_type, n, mean, top, row_number() OVER (ORDER BY mean DESC, event_type) = 1 AS is_best FROM m")
def q11(t: Tables) -> DataFrame:
    m = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value"), 8).alias("mean"), F.max("value").alias("top"))
    best = m.orderBy(F.desc("mean"), "event_type").limit(1).select("event_type", F.lit(True).alias("b"))
    return m.join(F.broadcast(best), "event_type", "left").select("event_type", "n", "mean", "top", F.coalesce("b", F.lit(False)).alias("is_best"))


_PHENOTYPE = """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linestatus AS fraction, l_discount * 8 AS r2, l_tax - 0.04 AS s1, l_discount - 0.05 AS s2, (l_quantity - 25) / 500 AS s3 FROM lineitem),
    g AS (SELECT *, greatest(s1, 0) + greatest(s2, 0) AS a, greatest(s3, 0) AS b FROM f)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s1 >= s2 AND s1 >= s3 THEN 's1' WHEN s2 >= s3 THEN 's2' ELSE 's3' END AS top, CAST(s1 < 0 AS BIGINT) + CAST(s2 < 0 AS BIGINT) + CAST(s3 < 0 AS BIGINT) AS n_negative, round(a, 9) AS score_a, round(b, 9) AS score_b,
    CASE WHEN greatest(a, b) <= 0 THEN 'unassigned' WHEN a >= b THEN 'a' ELSE 'b' END AS dominant, r2 > CASE WHEN fraction = 'F' THEN 0.10 ELSE 0.15 END AS predictable, r2 > 0.50 AS strong FROM g"""


@query("l12_phenotype", _PHENOTYPE)
def l12(t: Tables) -> DataFrame:
    from tidemark.plans.pipelines import phenotype

    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_linestatus").alias("fraction"), (F.col("l_discount") * 8).alias("r2"), (F.col("l_tax") - 0.04).alias("s1"), (F.col("l_discount") - 0.05).alias("s2"), ((F.col("l_quantity") - 25) / 500).alias("s3"))
    out = phenotype(rows, {"a": ["s1", "s2"], "b": ["s3"]}, F.col("r2"), F.col("fraction"), {"F": 0.10, "O": 0.15})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "top", "n_negative", r("score_a").alias("score_a"), r("score_b").alias("score_b"), "dominant", "predictable", "strong")


@query("l11_driver_labels", f"""{_FAMILY}, g AS (SELECT *, greatest(s1, s2, s3) AS best, CASE WHEN s1 >= s2 AND s1 >= s3 THEN 's1' WHEN s2 >= s3 THEN 's2' ELSE 's3' END AS top, greatest(s1, 0) + greatest(s2, 0) AS a, greatest(s3, 0) AS b FROM f)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN best <= 0 THEN 'unassigned' WHEN top = 's3' THEN 'b' ELSE 'a' END AS rule_a, CASE WHEN greatest(a / 2, b) <= 0 THEN 'unassigned' WHEN a / 2 >= b THEN 'a' ELSE 'b' END AS rule_b, CASE WHEN greatest(a, b) <= 0 THEN 'unassigned' WHEN a >= b THEN 'a' ELSE 'b' END AS rule_c FROM g""")
def l11(t: Tables) -> DataFrame:
    return _family(t).select("l_orderkey", "l_linenumber", "l_partkey", *(c.alias(k) for k, c in X.driver_labels({"a": ["s1", "s2"], "b": ["s3"]}).items()))


@query("e09_state_of_deltas", "WITH d AS (SELECT l_linestatus, l_quantity - 25 AS d FROM lineitem) SELECT l_linestatus, round(avg(d), 8) AS mean, round(quantile_cont(d, 0.5), 8) AS median, round(quantile_cont(d, 0.025), 8) AS low, round(quantile_cont(d, 0.975), 8) AS high, round(avg(CAST(d > 0 AS INT)), 9) AS p_positive, count(d) AS valid, CASE WHEN quantile_cont(d, 0.025) > 0 THEN 'SUPPORTED' WHEN quantile_cont(d, 0.975) < 0 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS state FROM d GROUP BY 1")
def e09(t: Tables) -> DataFrame:
    from tidemark.operators.stats import delta_summary

    s = delta_summary(t.lineitem.select("l_linestatus", (F.col("l_quantity") - 25).alias("delta")), ["l_linestatus"])
    return s.select("l_linestatus", *(r(c, 8 if c != "p_positive" else 9).alias(c) for c in ("mean", "median", "low", "high", "p_positive")), "valid", support_state(F.col("low"), F.col("high")).alias("state"))
