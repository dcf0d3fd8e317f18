"""Many-to-many keys: pairs, canonical assignment, cluster statistics, modal values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import MISSING, present


def link_pairs(rows: DataFrame, unit: str, cluster: str, representative: Column) -> DataFrame:
    """One row for each (unit, cluster): its rows, and whether any is the representative.  A null cluster is ''."""
    keyed = rows.select(F.col(unit), F.coalesce(F.col(cluster).cast("string"), F.lit("")).alias(cluster), representative.alias("__rep"))
    return keyed.groupBy(unit, cluster).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bool_or("__rep"), F.lit(False)).alias("has_representative"))


def cardinality(pairs: DataFrame, unit: str, cluster: str, tokens: tuple[str, ...] = MISSING) -> DataFrame:
    """One row: units with no, one and several clusters, and the most."""
    n = pairs.groupBy(unit).agg(F.count_distinct(F.when(present(F.col(cluster), tokens), F.col(cluster))).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("n") == 1).alias("n_unique"), F.count_if(F.col("n") > 1).alias("n_multi"), F.count_if(F.col("n") == 0).alias("n_missing"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))


def canonical(pairs: DataFrame, unit: str, cluster: str, tokens: tuple[str, ...] = MISSING) -> DataFrame:
    """One cluster for each unit: representative first, then most rows, then the smallest id; with the reason."""
    valid = present(F.col(cluster), tokens)
    by = Window.partitionBy(unit)
    best = Window.partitionBy(unit).orderBy(F.col("__valid").desc(), F.col("has_representative").desc(), F.col("n_rows").desc(), F.col(cluster))
    reps = F.sum(F.when(F.col("__valid") & F.col("has_representative"), 1).otherwise(0)).over(by)
    p = pairs.withColumn("__valid", valid).withColumns({"__reps": reps, "__top": F.max(F.when(F.col("__valid"), F.col("n_rows"))).over(by), "__rank": F.row_number().over(best)})
    p = p.withColumn("__ties", F.sum(F.when(F.col("__valid") & (F.col("n_rows") == F.col("__top")), 1).otherwise(0)).over(by)).where("__rank = 1")
    reason = F.when(~F.col("__valid"), "missing_cluster").when(F.col("__reps") == 1, "representative_row").when(F.col("__reps") > 1, "representative_tiebreak").when(F.col("__ties") == 1, "largest_support").otherwise("lexical_tiebreak")
    return p.select(unit, F.when(F.col("__valid"), F.col(cluster)).otherwise("").alias("canonical"), reason.alias("reason"))


def cluster_statistics(pairs: DataFrame, units: DataFrame, unit: str, cluster: str, known: str, unknown: str, category: str) -> DataFrame:
    """Rows, canonical units, flag counts, modal category and ratios of each cluster with any row."""
    rows = pairs.where(present(F.col(cluster))).groupBy(cluster).agg(F.sum("n_rows").alias("n_rows"))
    chosen = canonical(pairs, unit, cluster).where("canonical <> ''").join(units, unit, "left")
    stats = chosen.groupBy(F.col("canonical").alias(cluster)).agg(
        F.count(F.lit(1)).alias("n_units"),
        F.count_if(F.col(known)).alias("n_known"),
        F.count_if(F.col(unknown)).alias("n_unknown"),
        stable_mode(F.col(category)).alias("category"),
    )
    out = rows.join(stats, cluster, "left").fillna(0, ["n_units", "n_known", "n_unknown"]).fillna("", ["category"])
    return out.withColumns({"unit_ratio": F.try_divide(F.col("n_units"), F.col("n_rows")), "unknown_share": F.try_divide(F.col("n_unknown"), F.col("n_units"))})


def stable_mode(c: Column) -> Column:
    """Most frequent non-blank value, ties to the smallest; '' where there is none."""
    return F.coalesce(F.mode(F.when(F.trim(c) != "", c), True), F.lit(""))


def modal_columns(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """By group and column: the modal value, its share of the filled rows (purity), and the filled share (coverage)."""
    long = df.select(group, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.nullif(F.trim(F.col(c)), F.lit("")).alias("value")) for c in columns))).alias("x")).select(group, "x.*")
    counts = long.groupBy(group, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group, "column")
    filled = F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)
    ranked = counts.withColumns({"n_rows": F.sum("n").over(w), "n_filled": F.sum(filled).over(w), "place": F.row_number().over(w.orderBy(F.col("value").isNull(), F.desc("n"), "value"))}).where("place = 1")
    return ranked.select(group, "column", F.col("value").alias("modal"), (F.col("n_filled") / F.col("n_rows")).alias("coverage"), F.when(F.col("value").isNotNull(), F.col("n") / F.col("n_filled")).alias("purity"))


def group_taxonomy(df: DataFrame, group: str, ranks: list[str], flags: dict[str, Column]) -> DataFrame:
    """One row for each group: n, of each rank the modal value, its coverage and purity, and the mean of each flag."""
    modal = modal_columns(df, group, ranks)
    at = lambda rank, c: F.max(F.when(F.col("column") == rank, F.col(c))).alias(f"{rank}_{c}")
    wide = modal.groupBy(group).agg(*(at(k, c) for k in ranks for c in ("modal", "coverage", "purity")))
    means = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c.cast("int")).alias(k) for k, c in flags.items()))
    return means.join(wide, group)


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a full order."""
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__place = 1").drop("__place")


def universes(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row of set arithmetic on two key sets."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    both = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), key, "full")
    return both.agg(F.count(F.lit(1)).alias("n_union"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_common"), F.count_if(F.col("r").isNull()).alias("n_left_only"), F.count_if(F.col("l").isNull()).alias("n_right_only"))
