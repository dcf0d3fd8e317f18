"""Queries on projections, predicates, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import hashing as H
from tidemark.functions import labels as L
from tidemark.operators import contracts as C
from tidemark.operators import mapping as M
from tidemark.operators.ranges import quantiles
from tidemark.plans.registry import Tables, query, r

#: Annotated rows: three annotation columns with missing tokens, a category and a singleton category.
ANNOTATED = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN '-' ELSE l_returnflag END AS a1,
    CASE WHEN l_linestatus = 'O' THEN ' NA ' ELSE l_linestatus END AS a2, CASE WHEN l_linenumber > 4 THEN NULL WHEN l_linenumber > 2 THEN '' ELSE 'x' END AS a3,
    CASE l_linenumber WHEN 1 THEN 'K' WHEN 2 THEN 'KWP' WHEN 3 THEN 'GU' WHEN 4 THEN 'EU' WHEN 5 THEN 'SINGL' WHEN 6 THEN 'DISC' END AS category,
    CASE WHEN l_quantity > 25 THEN 'EU' ELSE 'K' END AS single FROM lineitem"""


def annotated(t: Tables) -> DataFrame:
    t.lineitem.createOrReplaceTempView("tidemark_lineitem")
    return t.spark.sql(ANNOTATED.replace("FROM lineitem", "FROM tidemark_lineitem"))


@query("p01_representative", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_linenumber = 1")
def p01(t: Tables) -> DataFrame:
    return t.lineitem.where("l_linenumber = 1").select("l_orderkey", "l_partkey", "l_linenumber")


_PRESENT = "(trim(coalesce({c}, '')) NOT IN ('', '-', 'NA', 'nan'))"


@query("p02_missing_tokens", f"WITH a AS ({ANNOTATED}) SELECT l_linenumber, count(*) FILTER ({_PRESENT.format(c='a1')}) AS n1, count(*) FILTER ({_PRESENT.format(c='a2')}) AS n2, count(*) FILTER ({_PRESENT.format(c='a3')}) AS n3 FROM a GROUP BY l_linenumber")
def p02(t: Tables) -> DataFrame:
    return annotated(t).groupBy("l_linenumber").agg(*(F.count_if(L.present(F.col(f"a{i}"))).alias(f"n{i}") for i in (1, 2, 3)))


@query(
    "p03_function_flags",
    f"""WITH a AS ({ANNOTATED}), b AS (SELECT *, {_PRESENT.format(c='a1')} OR {_PRESENT.format(c='a2')} OR {_PRESENT.format(c='a3')} AS s, CASE WHEN category = 'SINGL' THEN single ELSE category END AS e FROM a),
    f AS (SELECT s AS annotated, coalesce(e IN ('K', 'KWP'), false) AS category_known, coalesce(e IN ('GU', 'EU'), false) AS category_unknown FROM b)
    SELECT annotated, category_known, category_unknown, annotated AND category_known AS strict_known, NOT annotated AND category_unknown AS strict_unknown, NOT annotated AS broad_unknown, count(*) AS n FROM f GROUP BY ALL""",
)
def p03(t: Tables) -> DataFrame:
    flags = L.function_flags(["a1", "a2", "a3"], "category", "single")
    return annotated(t).select(*(c.alias(k) for k, c in flags.items())).groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))


@query("p04_key_normalisation", "SELECT 'KEY_' || CAST(s_suppkey AS VARCHAR) AS k1, CAST(s_nationkey AS VARCHAR) || '::' || CAST(s_suppkey AS VARCHAR) AS k2 FROM supplier")
def p04(t: Tables) -> DataFrame:
    return t.supplier.select(F.concat(F.lit("KEY_"), F.col("s_suppkey").cast("string")).alias("k1"), F.concat_ws("::", F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")).alias("k2"))


@query("p05_key_extraction", r"SELECT c_custkey, nullif(regexp_extract(c_name, '^([A-Za-z]+)#0*([1-9][0-9]*)$', 2), '') AS number, nullif(regexp_extract(c_name, '^X_(.*)$', 1), '') AS none FROM customer")
def p05(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", L.extracted(F.col("c_name"), r"^([A-Za-z]+)#0*([1-9][0-9]*)$", 2).alias("number"), L.extracted(F.col("c_name"), r"^X_(.*)$").alias("none"))


_LINEAGE = "concat_ws('; ', 'root', r_name, n_name)"


@query(
    "p06_lineage",
    f"""WITH l AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'unclassified' WHEN s_suppkey % 11 = 0 THEN NULL ELSE {_LINEAGE} END AS lineage FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT s_suppkey, CASE WHEN lower(trim(coalesce(lineage, ''))) IN ('', 'root', 'unclassified') THEN '' ELSE coalesce(trim(string_split(lineage, ';')[2]), '') END AS rank0,
    CASE WHEN lower(trim(coalesce(lineage, ''))) IN ('', 'root', 'unclassified') THEN '' ELSE coalesce(trim(string_split(lineage, ';')[3]), '') END AS rank1,
    CASE WHEN lower(trim(coalesce(lineage, ''))) IN ('', 'root', 'unclassified') THEN '' ELSE coalesce(trim(string_split(lineage, ';')[4]), '') END AS rank2 FROM l""",
)
def p06(t: Tables) -> DataFrame:
    j = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    lineage = F.when(F.col("s_suppkey") % 7 == 0, "unclassified").when(F.col("s_suppkey") % 11 == 0, None).otherwise(F.concat_ws("; ", F.lit("root"), "r_name", "n_name"))
    return j.select("s_suppkey", *(c.alias(f"rank{i}") for i, c in enumerate(L.lineage_ranks(lineage, 3))))


@query(
    "p07_conflict",
    """WITH v AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Prokaryote' WHEN 1 THEN ' bacteria' WHEN 2 THEN 'Eukaryota' WHEN 3 THEN '' END AS a, CASE p_partkey % 4 WHEN 0 THEN 'Archaea' WHEN 1 THEN 'eukaryote ' WHEN 2 THEN 'Bacteria' ELSE 'prokaryote' END AS b FROM part),
    w AS (SELECT p_partkey, lower(trim(coalesce(a, ''))) AS x, lower(trim(coalesce(b, ''))) AS y FROM v)
    SELECT p_partkey, x <> '' AND y <> '' AND NOT (x = y OR (x = 'prokaryote' AND y IN ('bacteria', 'archaea')) OR (y = 'prokaryote' AND x IN ('bacteria', 'archaea')) OR (x = 'eukaryote' AND y IN ('eukaryota', 'eukarya')) OR (y = 'eukaryote' AND x IN ('eukaryota', 'eukarya'))) AS conflicts FROM w""",
)
def p07(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    a = F.when(k % 5 == 0, "Prokaryote").when(k % 5 == 1, " bacteria").when(k % 5 == 2, "Eukaryota").when(k % 5 == 3, "")
    b = F.when(k % 4 == 0, "Archaea").when(k % 4 == 1, "eukaryote ").when(k % 4 == 2, "Bacteria").otherwise("prokaryote")
    return t.part.select("p_partkey", L.conflict(a, b).alias("conflicts"))


@query("p08_dominance", "WITH n AS (SELECT l_suppkey, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, CASE WHEN f > o THEN 'F' WHEN o > f THEN 'O' END AS dominant FROM n")
def p08(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("f"), F.count_if(F.col("l_linestatus") == "O").alias("o"))
    return n.select("l_suppkey", L.dominance(F.col("f"), F.col("o"), ("F", "O")).alias("dominant"))


_STRATA = "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0.05 THEN 'high' WHEN l_discount <= 0.02 THEN 'low' END AS level, l_linestatus AS fraction FROM lineitem"


@query("p09_threshold_stratum", f"WITH s AS ({_STRATA}) SELECT fraction || '::' || level || '::' || CAST(l_linenumber AS VARCHAR) AS stratum, count(*) AS n FROM s GROUP BY 1")
def p09(t: Tables) -> DataFrame:
    s = L.stratum(F.col("l_linestatus"), L.threshold_label(F.col("l_discount"), 0.05, 0.02), F.col("l_linenumber").cast("string"))
    return t.lineitem.groupBy(s.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query("p10_stratum_threshold", "WITH q AS (SELECT l_linestatus, quantile_cont(l_discount, 0.25) AS lim FROM lineitem GROUP BY l_linestatus) SELECT l.l_linestatus, CASE WHEN l_discount <= lim THEN 'low' WHEN l_discount > 0.05 THEN 'high' END AS level, count(*) AS n FROM lineitem l JOIN q ON l.l_linestatus = q.l_linestatus GROUP BY 1, 2")
def p10(t: Tables) -> DataFrame:
    q = quantiles(t.lineitem, ["l_linestatus"], "l_discount", {"lim": 0.25})
    level = F.when(F.col("l_discount") <= F.col("lim"), "low").when(F.col("l_discount") > 0.05, "high")
    return t.lineitem.join(q, "l_linestatus").groupBy("l_linestatus", level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("p11_quality_filters", f"WITH a AS ({ANNOTATED}), m AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS k FROM a GROUP BY l_partkey) SELECT a.l_partkey, count(*) AS n FROM a JOIN m USING (l_partkey) WHERE category IS DISTINCT FROM 'DISC' AND a3 IS NOT NULL AND k < 30 GROUP BY a.l_partkey")
def p11(t: Tables) -> DataFrame:
    a = annotated(t)
    few = a.groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("k")).where("k < 30")
    return a.join(few, "l_partkey", "left_semi").where(~F.col("category").eqNullSafe("DISC") & F.col("a3").isNotNull()).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("p12_single_label", "SELECT event_id, event_type FROM events WHERE event_type <> '' AND event_type <> '-' AND NOT contains(event_type, '|')")
def p12(t: Tables) -> DataFrame:
    e = F.col("event_type")
    return t.events.where((e != "") & (e != "-") & ~e.contains("|")).select("event_id", "event_type")


@query(
    "p13_complete_cases",
    "WITH v AS (SELECT CASE WHEN l_discount = 0 THEN 'NaN'::DOUBLE ELSE l_tax END AS x, CASE WHEN l_linenumber = 7 THEN 'Infinity'::DOUBLE ELSE l_quantity END AS y FROM lineitem), c AS (SELECT CASE WHEN isfinite(x) THEN x END AS x, CASE WHEN isfinite(y) THEN y END AS y FROM v) SELECT count(*) AS n_input, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_kept, count(*) FILTER (x IS NULL OR y IS NULL) AS n_excluded FROM c",
)
def p13(t: Tables) -> DataFrame:
    v = t.lineitem.select(L.finite(F.when(F.col("l_discount") == 0, float("nan")).otherwise(F.col("l_tax"))).alias("x"), L.finite(F.when(F.col("l_linenumber") == 7, float("inf")).otherwise(F.col("l_quantity"))).alias("y"))
    full = F.col("x").isNotNull() & F.col("y").isNotNull()
    return v.agg(F.count(F.lit(1)).alias("n_input"), F.count_if(full).alias("n_kept"), F.count_if(~full).alias("n_excluded"))


@query("p14_eligibility", "SELECT lang, length(text) + 2 <= 2048 AS eligible, count(*) AS n FROM documents GROUP BY 1, 2")
def p14(t: Tables) -> DataFrame:
    from tidemark.operators.sequences import eligible

    return t.documents.groupBy("lang", eligible(F.length("text"), 2048).alias("eligible")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p15_failure_reasons",
    "WITH r AS (SELECT concat_ws('+', CASE WHEN l_quantity > 40 THEN 'large' END, CASE WHEN l_discount > 0.08 THEN 'cheap' END, CASE WHEN l_tax = 0 THEN 'untaxed' END) AS reasons, CAST(l_quantity > 40 AS INT) + CAST(l_discount > 0.08 AS INT) + CAST(l_tax = 0 AS INT) AS k FROM lineitem) SELECT reasons, count(*) AS n, count(*) FILTER (k > 1) AS n_multi FROM r GROUP BY reasons",
)
def p15(t: Tables) -> DataFrame:
    conds = {"large": F.col("l_quantity") > 40, "cheap": F.col("l_discount") > 0.08, "untaxed": F.col("l_tax") == 0}
    k = sum((c.cast("int") for c in conds.values()), F.lit(0))
    return t.lineitem.select(L.failure_reasons(conds).alias("reasons"), k.alias("k")).groupBy("reasons").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") > 1).alias("n_multi"))


@query(
    "p16_binning",
    "WITH m AS (SELECT CASE WHEN max(l_discount) <= 1 THEN 100 ELSE 1 END AS f FROM lineitem), v AS (SELECT l_discount * f AS x FROM lineitem, m) SELECT CASE WHEN x >= -2 AND x < -0.1 THEN 'no_hit' WHEN x >= -0.1 AND x < 3 THEN 'lt3' WHEN x >= 3 AND x < 7 THEN '3to7' WHEN x >= 7 AND x < 101 THEN 'ge7' END AS bin, count(*) AS n FROM v GROUP BY 1",
)
def p16(t: Tables) -> DataFrame:
    top = t.lineitem.agg(F.when(F.max("l_discount") <= 1, 100.0).otherwise(1.0).alias("f"))
    x = F.col("l_discount") * F.col("f")
    return t.lineitem.crossJoin(F.broadcast(top)).groupBy(L.binned(x, [-2, -0.1, 3, 7, 101], ["no_hit", "lt3", "3to7", "ge7"]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p17_representation_parts",
    r"WITH n AS (SELECT DISTINCT p_brand || CASE WHEN p_size % 2 = 0 THEN '_native' ELSE '_PCA' || CAST(p_size AS VARCHAR) END AS name FROM part) SELECT name, regexp_replace(name, '_(native|PCA\d+)$', '') AS base, nullif(regexp_extract(name, '_(native|PCA)\d*$', 1), '') AS kind, TRY_CAST(nullif(regexp_extract(name, '_PCA(\d+)$', 1), '') AS INTEGER) AS dimension FROM n",
)
def p17(t: Tables) -> DataFrame:
    name = F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, "_native").otherwise(F.concat(F.lit("_PCA"), F.col("p_size").cast("string"))))
    n = t.part.select(name.alias("name")).distinct()
    return n.select("name", *(c.alias(k) for k, c in L.representation_parts(F.col("name")).items()))


@query(
    "p18_support_state",
    "WITH c AS (SELECT l_suppkey, avg(l_discount) - 0.05 AS m, stddev_samp(l_discount) / sqrt(count(*)) AS s FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, CASE WHEN m - s > 0 THEN 'SUPPORTED' WHEN m + s < 0 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS state, CASE WHEN m - s > 0 THEN 1 WHEN m + s < 0 THEN -1 ELSE 0 END AS number FROM c",
)
def p18(t: Tables) -> DataFrame:
    c = t.lineitem.groupBy("l_suppkey").agg((F.avg("l_discount") - 0.05).alias("m"), (F.stddev_samp("l_discount") / F.sqrt(F.count(F.lit(1)))).alias("s"))
    s = L.support_state(F.col("m") - F.col("s"), F.col("m") + F.col("s"))
    numbers = F.create_map(F.lit("SUPPORTED"), F.lit(1), F.lit("NEGATIVE"), F.lit(-1), F.lit("NEUTRAL"), F.lit(0))
    return c.select("l_suppkey", s.alias("state"), numbers[s].alias("number"))


@query("p19_harmonised_schema", "SELECT 'c_name' AS col, count(c_name) = count(TRY_CAST(c_name AS DOUBLE)) AS is_numeric FROM customer UNION ALL SELECT 'c_acctbal', count(c_acctbal) = count(TRY_CAST(CAST(c_acctbal AS VARCHAR) AS DOUBLE)) FROM customer UNION ALL SELECT 'c_nationkey', count(c_nationkey) = count(TRY_CAST(CAST(c_nationkey AS VARCHAR) AS DOUBLE)) FROM customer")
def p19(t: Tables) -> DataFrame:
    cols = ["c_name", "c_acctbal", "c_nationkey"]
    text = t.customer.select(*(F.col(c).cast("string") for c in cols))
    one = text.agg(*((F.count(c) == F.count(F.expr(f"try_cast({c} as double)"))).alias(c) for c in cols))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("is_numeric")) for c in cols))))


@query("p20_drop_columns", "SELECT * EXCLUDE (s_name) FROM supplier")
def p20(t: Tables) -> DataFrame:
    return t.supplier.drop("s_name")


@query(
    "p21_top_or_other",
    "WITH v AS (SELECT coalesce(nullif(trim(CASE WHEN p_size % 9 = 0 THEN ' ' ELSE p_brand END), ''), 'Unknown') AS b FROM part), top AS (SELECT b FROM v GROUP BY b ORDER BY count(*) DESC, b LIMIT 5) SELECT CASE WHEN b IN (SELECT b FROM top) THEN b ELSE 'Other' END AS brand, count(*) AS n FROM v GROUP BY 1",
)
def p21(t: Tables) -> DataFrame:
    v = t.part.select(L.blank_to(F.when(F.col("p_size") % 9 == 0, " ").otherwise(F.col("p_brand"))).alias("b"))
    top = v.groupBy("b").count().orderBy(F.desc("count"), "b").limit(5).select("b", F.lit(True).alias("top"))
    return v.join(F.broadcast(top), "b", "left").groupBy(F.when(F.col("top"), F.col("b")).otherwise("Other").alias("brand")).agg(F.count(F.lit(1)).alias("n"))


@query("p22_safe_member", "SELECT page_id, NOT starts_with(p, '/') AND NOT list_contains(string_split(p, '/'), '..') AS safe FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/' || url WHEN 1 THEN url || '/../x' ELSE 'a/' || url END AS p FROM pages)")
def p22(t: Tables) -> DataFrame:
    p = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/"), "url")).when(F.col("page_id") % 3 == 1, F.concat("url", F.lit("/../x"))).otherwise(F.concat(F.lit("a/"), "url"))
    return t.pages.select("page_id", L.safe_member(p).alias("safe"))


@query("j01_inner_join", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def j01(t: Tables) -> DataFrame:
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("j02_left_join", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def j02(t: Tables) -> DataFrame:
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return t.customer.select("c_custkey").join(o, "c_custkey", "left").fillna(0)


@query("j03_full_join", "WITH c AS (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer WHERE c_nationkey < 20 GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier WHERE s_nationkey > 3 GROUP BY 1) SELECT coalesce(c.k, s.k) AS k, coalesce(n_customers, 0) AS n_customers, coalesce(n_suppliers, 0) AS n_suppliers FROM c FULL JOIN s ON c.k = s.k")
def j03(t: Tables) -> DataFrame:
    c = t.customer.where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_customers"))
    s = t.supplier.where("s_nationkey > 3").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    return c.join(s, "k", "full").fillna(0)


@query("j04_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j04(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("j05_semi_join", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def j05(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part.where("p_size < 10").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("j06_aligned_matrix", "WITH a AS (SELECT l_suppkey AS k, sum(l_quantity) AS q FROM lineitem WHERE l_suppkey > 2 GROUP BY 1), b AS (SELECT l_suppkey AS k, count(*) AS d FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS n_aligned, count(*) FILTER (a.k IS NULL OR b.k IS NULL) AS n_mismatch, round(sum(CASE WHEN b.k IS NOT NULL THEN q END), 3) AS total FROM a FULL JOIN b ON a.k = b.k")
def j06(t: Tables) -> DataFrame:
    a = t.lineitem.where("l_suppkey > 2").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("q"))
    b = t.lineitem.where("l_linestatus = 'F'").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("d"))
    j = a.join(b, "k", "full")
    both = F.col("q").isNotNull() & F.col("d").isNotNull()
    return j.agg(F.count_if(both).alias("n_aligned"), F.count_if(~both).alias("n_mismatch"), r(F.sum(F.when(both, F.col("q"))), 3).alias("total"))


@query("j07_residual_join", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND ((o_orderstatus = 'F' AND l_returnflag = 'R') OR (o_orderstatus <> 'F' AND l_quantity > 40))")
def j07(t: Tables) -> DataFrame:
    cond = ((F.col("o_orderstatus") == "F") & (F.col("l_returnflag") == "R")) | ((F.col("o_orderstatus") != "F") & (F.col("l_quantity") > 40))
    return t.orders.join(t.lineitem, (F.col("o_orderkey") == F.col("l_orderkey")) & cond).select("o_orderkey", "l_linenumber")


@query("j08_checked_join", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def j08(t: Tables) -> DataFrame:
    n = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return C.checked_join(t.supplier, n, ["s_nationkey"], validate="many_to_one").select("s_suppkey", "n_name")


@query("j09_lookup", "SELECT p_partkey, coalesce(v, 'none') AS v FROM part LEFT JOIN (VALUES (1, 'one'), (2, 'two'), (3, 'three')) AS m(k, v) ON p_size = k")
def j09(t: Tables) -> DataFrame:
    m = t.spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "p_size int, v string")
    return t.part.join(F.broadcast(m), "p_size", "left").select("p_partkey", F.coalesce("v", F.lit("none")).alias("v"))


@query("j11_aligned_pairs", "WITH a AS (SELECT doc_id, quality FROM labels WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, toxic AS quality FROM labels WHERE doc_id % 7 <> 0) SELECT count(*) FILTER (b.doc_id IS NULL) AS left_only, count(*) FILTER (a.doc_id IS NULL) AS right_only, count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.quality IS DISTINCT FROM b.quality) AS different FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def j11(t: Tables) -> DataFrame:
    return C.aligned_pairs(t.labels.where("doc_id % 5 <> 0").select("doc_id", "quality"), t.labels.where("doc_id % 7 <> 0").select("doc_id", F.col("toxic").alias("quality")), "doc_id", ["quality"])


@query(
    "j12_best_hit",
    "WITH h AS (SELECT l_orderkey AS q, l_partkey AS t, l_extendedprice AS s, l_tax AS e FROM lineitem), b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, e, t) AS k FROM h), p AS (SELECT avg(CAST(p_size > 25 AS DOUBLE)) AS prev FROM part WHERE p_size % 3 <> 0) SELECT o_orderkey AS q, round(coalesce(CAST(p_size > 25 AS DOUBLE), prev), 9) AS pred FROM orders CROSS JOIN p LEFT JOIN (SELECT q, t FROM b WHERE k = 1) b ON o_orderkey = q LEFT JOIN (SELECT * FROM part WHERE p_size % 3 <> 0) x ON t = p_partkey",
)
def j12(t: Tables) -> DataFrame:
    best = M.first_by(t.lineitem, ["l_orderkey"], F.desc("l_extendedprice"), F.col("l_tax"), F.col("l_partkey")).select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("p_partkey"))
    train = t.part.where("p_size % 3 <> 0").select("p_partkey", (F.col("p_size") > 25).cast("double").alias("y"))
    j = t.orders.select(F.col("o_orderkey").alias("q")).join(best, "q", "left").join(train, "p_partkey", "left").crossJoin(F.broadcast(train.agg(F.avg("y").alias("prev"))))
    return j.select("q", r(F.coalesce("y", "prev")).alias("pred"))


@query("j13_key_reconciliation", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0) SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS common, count(*) FILTER (a.k IS NULL) AS missing, count(*) FILTER (b.k IS NULL) AS extra FROM a FULL JOIN b ON a.k = b.k")
def j13(t: Tables) -> DataFrame:
    return C.reconcile_keys(t.orders.select(F.col("o_custkey").alias("k")), t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k")), "k")


@query("j15_null_safe_join", "WITH c AS (SELECT CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS b, p_type AS ty FROM part), q AS (SELECT b, ty, count(*) AS quota FROM c GROUP BY b, ty) SELECT c.b, c.ty, quota, count(*) AS n FROM c JOIN q ON c.b IS NOT DISTINCT FROM q.b AND c.ty = q.ty GROUP BY 1, 2, 3")
def j15(t: Tables) -> DataFrame:
    c = t.part.select(F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("b"), F.col("p_type").alias("ty"))
    q = c.groupBy("b", "ty").agg(F.count(F.lit(1)).alias("quota"))
    j = c.alias("c").join(q.alias("q"), F.col("c.b").eqNullSafe(F.col("q.b")) & (F.col("c.ty") == F.col("q.ty")))
    return j.groupBy("c.b", "c.ty", "quota").agg(F.count(F.lit(1)).alias("n"))


@query("u01_union_tagged", "SELECT 'customer' AS tag, c_custkey AS k FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier")
def u01(t: Tables) -> DataFrame:
    return t.customer.select(F.lit("customer").alias("tag"), F.col("c_custkey").alias("k")).unionByName(t.supplier.select(F.lit("supplier").alias("tag"), F.col("s_suppkey").alias("k")))


@query("u02_union_by_name", "SELECT s_suppkey AS k, s_name AS name, NULL::DOUBLE AS price FROM supplier UNION ALL SELECT p_partkey, NULL, p_retailprice FROM part")
def u02(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")).unionByName(t.part.select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("price")), allowMissingColumns=True)


@query("u03_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u03(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select(F.col("s_nationkey").alias("k")))


@query("u04_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def u04(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.select(F.col("o_custkey").alias("k")))


@query("u05_assembly", "SELECT CASE WHEN p_size < 20 THEN 'core' ELSE 'remainder' END AS source, count(*) AS n, count(DISTINCT p_partkey) AS n_ids FROM part GROUP BY 1")
def u05(t: Tables) -> DataFrame:
    core, rest = t.part.where("p_size < 20"), t.part.where("p_size >= 20")
    both = core.select("p_partkey", F.lit("core").alias("source")).unionByName(rest.select("p_partkey", F.lit("remainder").alias("source")))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_partkey").alias("n_ids"))


@query("u06_distinct_pairs", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def u06(t: Tables) -> DataFrame:
    return t.lineitem.select("l_partkey", "l_suppkey").dropDuplicates()


@query("t01_sorted_output", "SELECT s_suppkey, s_name FROM supplier")
def t01(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", "s_name").orderBy("s_name", "s_suppkey")


@query("t02_ordered_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def t02(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("t03_top_values", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 3")
def t03(t: Tables) -> DataFrame:
    return t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_type").limit(3)


@query("t04_largest", "SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY l_orderkey ORDER BY size DESC, l_orderkey LIMIT 10")
def t04(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "l_orderkey").limit(10)


@query("t05_probe", "SELECT event_id FROM events ORDER BY event_id LIMIT 100")
def t05(t: Tables) -> DataFrame:
    return t.events.select("event_id").orderBy("event_id").limit(100)


_H = "sha256('11:' || CAST({k} AS VARCHAR))"
_NUM = "CAST('0x' || substr({h}, 1, 16) AS UBIGINT)"


@query(
    "f11_hashes",
    f"SELECT c_custkey, sha256(CAST(c_custkey AS VARCHAR)) AS plain, {_H.format(k='c_custkey')} AS seeded, CAST({_NUM.format(h='sha256(CAST(c_custkey AS VARCHAR))')} % 32 AS INTEGER) AS bucket, round(CAST({_NUM.format(h=_H.format(k='c_custkey'))} AS DOUBLE) / 18446744073709551616.0, 12) AS u64, round(CAST(CAST('0x' || substr({_H.format(k='c_custkey')}, 1, 8) AS UBIGINT) AS DOUBLE) / 4294967295.0, 12) AS u32, 'GROUP_' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 16) AS gid FROM customer",
)
def f11(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", H.stable_hash(k).alias("plain"), H.stable_hash(k, 11).alias("seeded"), H.bucket(k, 32).alias("bucket"), r(H.uniform(H.stable_hash(k, 11)), 12).alias("u64"), r(H.uniform32(H.stable_hash(k, 11)), 12).alias("u32"), H.group_id(k).alias("gid"))


@query(
    "f01_scalars",
    "SELECT c_custkey, lower(trim(' ' || c_name || ' ')) AS f1, coalesce(nullif(substr(c_name, 1, 3), 'Cus'), 'none') AS f2, replace(c_name, '#', '::') AS f3, starts_with(c_name, 'Cust') AS f4, contains(c_name, '9') AS f5, string_split(c_name, '#')[2] AS f6, round(ln(1 + abs(c_acctbal)), 9) AS f7, round(sqrt(abs(c_acctbal)), 6) AS f8, greatest(c_acctbal, 0.0) AS f9, round(c_acctbal / nullif(c_nationkey, 0), 6) AS f10, TRY_CAST(string_split(c_name, '#')[2] AS DOUBLE) AS f12 FROM customer",
)
def f01(t: Tables) -> DataFrame:
    n, b = F.col("c_name"), F.col("c_acctbal")
    part = F.try_element_at(F.split(n, "#"), F.lit(2))
    return t.customer.select(
        "c_custkey", F.lower(F.trim(F.concat(F.lit(" "), n, F.lit(" ")))).alias("f1"), F.coalesce(F.nullif(F.substring(n, 1, 3), F.lit("Cus")), F.lit("none")).alias("f2"), F.replace(n, F.lit("#"), F.lit("::")).alias("f3"),
        n.startswith("Cust").alias("f4"), n.contains("9").alias("f5"), part.alias("f6"), r(F.log1p(F.abs(b))).alias("f7"), r(F.sqrt(F.abs(b)), 6).alias("f8"), F.greatest(b, F.lit(0.0)).alias("f9"), r(F.try_divide(b, F.col("c_nationkey")), 6).alias("f10"),
        part.try_cast("double").alias("f12"),
    )


@query("w02_first_by_rank", "SELECT l_suppkey, l_returnflag, min(l_partkey) AS first_part FROM lineitem GROUP BY 1, 2")
def w02(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("l_suppkey", "l_returnflag").orderBy("l_partkey"))
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_partkey").distinct().withColumn("place", place).where("place = 1").select("l_suppkey", "l_returnflag", F.col("l_partkey").alias("first_part"))
