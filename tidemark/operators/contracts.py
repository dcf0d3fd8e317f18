"""Checked joins, key reconciliation and audits that return their findings as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same(left: list[str], right: list[str]) -> Column:
    """Null-safe equality of columns."""
    return reduce(Column.__and__, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)), F.lit(True))


class ContractError(ValueError):
    """Data breaks a stated contract."""


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ContractError(f"missing columns: {missing}")
    return df


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "one_to_one") -> DataFrame:
    """A join whose ``one`` sides must have unique keys."""
    a, b = validate.split("_to_")
    for side, kind, name in ((left, a, "left"), (right, b, "right")):
        if kind == "one" and repeated_keys(side, on).limit(1).count():
            raise ContractError(f"keys {on} repeat on the {name} side")
    return left.join(right, on, how)


def reconcile_keys(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """One row: keys on both sides, missing ones and extra ones."""
    a = found.select(key).where(F.col(key).isNotNull()).distinct().withColumn("in_found", F.lit(True))
    b = expected.select(key).where(F.col(key).isNotNull()).distinct().withColumn("in_expected", F.lit(True))
    both = a.join(b, key, "full")
    return both.agg(
        F.count_if(F.col("in_found") & F.col("in_expected")).alias("common"),
        F.count_if(F.col("in_found").isNull()).alias("missing"),
        F.count_if(F.col("in_expected").isNull()).alias("extra"),
    )


def checks(df: DataFrame, tests: dict[str, tuple[Column, int | None]]) -> DataFrame:
    """One row for each test: an aggregate that counts, and the value it should have."""
    one = df.agg(*(c.cast("long").alias(k) for k, (c, _) in tests.items()))
    entries = [F.struct(F.lit(k).alias("check"), F.col(k).alias("observed"), F.lit(e).cast("long").alias("expected"), (F.col(k) == F.lit(e)).alias("passed")) for k, (_, e) in tests.items()]
    return one.select(F.inline(F.array(*entries)))


def key_crossings(df: DataFrame, keys: list[str], part: str) -> DataFrame:
    """For each key column: its values, and how many of them are in several parts."""
    long = df.select(part, F.explode(F.array(*(F.struct(F.lit(k).alias("column"), F.col(k).cast("string").alias("value")) for k in keys))).alias("x")).select(part, "x.*")
    by_value = long.where("value IS NOT NULL").groupBy("column", "value").agg(F.countDistinct(part).alias("parts"))
    return by_value.groupBy("column").agg(F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("parts") > 1).alias("n_crossing"))


def aligned_pairs(left: DataFrame, right: DataFrame, key: str, same: list[str]) -> DataFrame:
    """One row: keys of either side alone, and rows that differ in a column that should be equal."""
    both = left.withColumn("__l", F.lit(1)).alias("l").join(right.withColumn("__r", F.lit(1)).alias("r"), key, "full")
    differ = reduce(Column.__or__, (~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in same))
    return both.agg(
        F.count_if(F.col("__r").isNull()).alias("left_only"),
        F.count_if(F.col("__l").isNull()).alias("right_only"),
        F.count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull() & differ).alias("different"),
    )


def vector_contract(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """One row of facts on a vector table: rows, ids, widths, zero and non-finite vectors."""
    from tidemark.functions.vectors import all_finite, norm

    return vectors.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(key).alias("n_ids"),
        F.min(F.size(vector)).cast("long").alias("least_width"),
        F.max(F.size(vector)).cast("long").alias("largest_width"),
        F.count_if(~F.coalesce(all_finite(F.col(vector)), F.lit(False))).alias("n_not_finite"),
        F.count_if(norm(F.col(vector)) == 0).alias("n_zero"),
    )


def label_audit(rows: DataFrame, annotated: str, known: tuple[str, str], unknown: tuple[str, str], broad: str) -> DataFrame:
    """One row on recomputed and stored flags (pairs of columns): rows that differ, rows in both classes, and breaches of the subset rules."""
    n = lambda c: F.count_if(c)
    (k, k_stored), (u, u_stored) = ([F.col(c) for c in pair] for pair in (known, unknown))
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        n(~k.eqNullSafe(k_stored)).alias("known_differs"),
        n(~u.eqNullSafe(u_stored)).alias("unknown_differs"),
        n(k & u).alias("in_both"),
        n(k & ~F.col(annotated)).alias("known_without_annotation"),
        n(u & ~F.col(broad)).alias("unknown_outside_broad"),
        n(k_stored & u_stored).alias("stored_in_both"),
        n(u_stored & ~F.col(broad)).alias("stored_outside_broad"),
    )


def contiguity(df: DataFrame, shard: str, index: str) -> DataFrame:
    """By shard: rows, and rows whose index isn't their place 0..n-1."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(shard).orderBy(index)) - 1
    return df.withColumn("__place", place).groupBy(shard).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("__place") != F.col(index)).alias("n_out_of_place"))


def table_digest(df: DataFrame) -> DataFrame:
    """Order-independent digest of a table: rows and the sum of row hashes."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.xxhash64(F.struct(*df.columns)).cast("decimal(38,0)")).alias("digest"))


def _counted(found: dict[str, DataFrame]) -> DataFrame:
    """check, observed, passed: how many rows each table of breaches has."""
    each = [d.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("observed")) for name, d in found.items()]
    return reduce(DataFrame.unionByName, each).withColumn("passed", F.col("observed") == 0)


def metric_table(results: DataFrame, task: str, method: str, seed: str, metric: str, *, tasks: list[str], seeds: int, predictions: DataFrame, cohort: DataFrame, key: str) -> DataFrame:
    """check, observed, passed of a table of results (task, method, seed, metric), its predictions (task, method, key) and the cohort (task, key).

    Each result has ``seeds`` different seeds, once each; metrics are finite; the tasks are those named,
    for each method; a method has one prediction for each key of a task's cohort and no others.
    """
    by = [task, method]
    bad = F.col(metric).isNull() | F.isnan(metric) | (F.abs(F.col(metric)) == float("inf"))
    wanted = results.select(method).distinct().crossJoin(F.broadcast(results.sparkSession.createDataFrame([(t,) for t in tasks], f"{task} string")))
    every = results.select(*by).distinct().join(cohort.select(task, key).distinct(), task)
    return _counted({
        "other_seeds": results.groupBy(*by).agg(F.countDistinct(seed).alias("d"), F.count(F.lit(1)).alias("n")).where((F.col("d") != seeds) | (F.col("n") != seeds)),
        "not_finite": results.where(bad),
        "missing_tasks": wanted.join(results.select(*by).distinct(), by, "left_anti"),
        "unknown_tasks": results.where(~F.col(task).isin(tasks)),
        "repeated_predictions": predictions.groupBy(*by, key).count().where("count > 1"),
        "missing_predictions": every.join(predictions, [*by, key], "left_anti"),
        "unknown_predictions": predictions.join(every, [*by, key], "left_anti"),
    })


def published_numbers(funnel: DataFrame, stages: list[str], intervals: DataFrame, group: str, required: list[str]) -> DataFrame:
    """check, observed, passed: stages of a funnel that are not positive or larger than the one before, intervals (low, estimate, high) that don't hold their estimate inside, required groups without an interval."""
    falls = F.col(stages[-1]) <= 0
    for a, b in zip(stages, stages[1:], strict=False):
        falls = falls | (F.col(b) > F.col(a))
    wanted = intervals.sparkSession.createDataFrame([(g,) for g in required], f"{group} string")
    inside = (F.col("low") < F.col("estimate")) & (F.col("estimate") < F.col("high"))
    return _counted({
        "funnel_order": funnel.where(F.coalesce(falls, F.lit(True))),
        "estimate_outside": intervals.where(~F.coalesce(inside, F.lit(False))),
        "missing_groups": wanted.join(intervals, group, "left_anti"),
    })
