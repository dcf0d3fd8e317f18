"""Deterministic sampling, matching and splitting by stable hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import stable_hash, uniform, uniform32
from tidemark.operators.contracts import same
from tidemark.operators.ranges import quantiles
from tidemark.operators.shared import reliable


def hash_order(seed: int, key: str) -> list[Column]:
    return [stable_hash(F.col(key), seed), F.col(key)]


def placed(df: DataFrame, strata: list[str], key: str, seed: int, cap: int | Column | None = None) -> DataFrame:
    """Adds ``place``, the rank of a row in its stratum by hash order, from 1.

    A stratum is dealt out by the first digits of the hash: their counts are summed up first, then
    rows are ranked inside, so a large stratum is many tasks.  Nulls in strata are a value.  With a
    ``cap``, rows whose digits all stand beyond it go before they are ranked, and rows beyond it after.
    """
    rows = df.withColumn("__h", stable_hash(F.col(key), seed)).withColumn("__lead", F.substring("__h", 1, 3))
    sums = rows.groupBy(*strata, "__lead").agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(*strata).orderBy("__lead").rowsBetween(Window.unboundedPreceding, -1)
    names = [*(f"__s{i}" for i in range(len(strata))), "__l"]
    before = sums.withColumn("__before", F.coalesce(F.sum("__n").over(over), F.lit(0))).select(*(F.col(c).alias(n) for c, n in zip([*strata, "__lead"], names, strict=True)), "__before")
    joined = rows.join(before, same([*strata, "__lead"], names))
    if cap is not None:
        joined = joined.where(F.col("__before") < cap)
    inside = F.row_number().over(Window.partitionBy(*strata, "__lead").orderBy("__h", key))
    out = joined.withColumn("place", (F.col("__before") + inside).cast("int")).drop(*names, "__before", "__h", "__lead")
    return out if cap is None else out.where(F.col("place") <= cap)


def capped(df: DataFrame, strata: list[str], key: str, cap: int | Column, seed: int) -> DataFrame:
    """At most ``cap`` rows of each stratum, the first in hash order."""
    return placed(df, strata, key, seed, cap)


def split_of(group: Column, seed: int, train: float = 0.70, validation: float = 0.85) -> Column:
    """Train, validation or test by the hash of the group, so a group is never split."""
    u = uniform32(stable_hash(group, seed))
    return F.when(u < train, "train").when(u < validation, "validation").otherwise("test")


def quantile_bins(df: DataFrame, column: str, bins: int, into: str) -> DataFrame:
    """Right-closed quantile bins with repeated edges dropped; nulls get the median; one value gives bin 0."""
    probs = [i / bins for i in range(bins + 1)]
    names = {f"__q{i}": p for i, p in enumerate(probs)}
    edges = quantiles(df, [], column, {**names, "__m": 0.5}).select(F.array(*names).alias("__e"), "__m")
    inner = lambda e: F.slice(F.array_distinct(e), 2, F.greatest(F.size(F.array_distinct(e)) - 2, F.lit(0)))
    x = F.coalesce(F.col(column), F.col("__m"))
    return df.crossJoin(F.broadcast(edges)).withColumn(into, F.size(F.filter(inner(F.col("__e")), lambda e: e < x)).cast("int")).drop("__e", "__m")


def matched(df: DataFrame, cell: list[str], label: str, values: tuple[str, str], key: str, seed: int) -> DataFrame:
    """Coarsened exact matching: in each cell as many rows of either label as the rarer one has, first by hash.  Missing cell values are a value of their own."""
    rows = df.where(F.col(label).isin(*values))
    names = [f"__c{i}" for i in range(len(cell))]
    quotas = rows.groupBy(*(F.col(c).alias(n) for c, n in zip(cell, names, strict=True))).agg(F.least(*(F.count_if(F.col(label) == v) for v in values)).alias("quota"))
    return placed(rows, [*cell, label], key, seed).join(quotas, same(cell, names)).where("place <= quota").drop(*names)


def quota_sample(df: DataFrame, quotas: DataFrame, strata: list[str], key: str, seed: int) -> DataFrame:
    """Rows of each stratum up to its quota, in hash order."""
    return placed(df, strata, key, seed).join(quotas, strata).where("place <= quota")


def split_quotas(total: Column) -> dict[str, Column]:
    """70/15/15 with integer floors, the rest to the test split."""
    train, validation = F.floor(total * 0.70).cast("long"), F.floor(total * 0.15).cast("long")
    return {"train": train, "validation": validation, "test": total - train - validation}


def largest_feasible(counts: DataFrame, split: str, n: str, cap: int) -> DataFrame:
    """The greatest stratum size up to the cap whose split quotas all strata can fill; counts has one row for each (stratum, split)."""
    least = counts.groupBy(split).agg(F.min(n).alias("least"))
    totals = counts.sparkSession.range(0, cap + 1).withColumnRenamed("id", "total")
    need = totals.select("total", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("train", "validation", "test"))), F.array(*split_quotas(F.col("total")).values()))).alias(split, "need"))
    return need.join(F.broadcast(least), split).groupBy("total").agg(F.bool_and(F.col("least") >= F.col("need")).alias("fits")).where("fits").agg(F.max("total").alias("largest"))


def exact_selection(groups: DataFrame, key: str, size: str, targets: list[int], seed: int, rounds: int = 200) -> DataFrame:
    """Groups that fill nested exact sizes, first fit in hash order: key, size, level.

    The loop over groups is a few rounds of prefix sums: after the last accepted place, groups that
    still fit are added up in order and the longest prefix within the room is accepted.  Each round
    reduces to one row at the driver; a target that no set of groups reaches raises.
    """
    ordered = reliable(groups.withColumn("h", stable_hash(F.col(key), seed)).select(key, size, "h"))
    chosen, have = [], 0
    for level, target in enumerate(targets):
        # what a level takes is at or before its last place, so only earlier levels have to be left out
        open_ = ordered if not chosen else reliable(ordered.join(reduce(DataFrame.union, chosen), key, "left_anti"))
        last = None
        for _ in range(rounds):
            room = target - have
            if room == 0:
                break
            left = open_.where((F.col(size) <= room) & (F.col(size) > 0))
            if last is not None:
                left = left.where((F.col("h") > last[0]) | ((F.col("h") == last[0]) & (F.col(key) > last[1])))
            took = reliable(_fitting_prefix(left, key, size, room))
            summary = took.agg(F.sum(size).alias("s"), F.max(F.struct("h", key)).alias("last")).first()
            if summary["s"] is None:
                break
            chosen.append(took.select(key, size, F.lit(level).alias("level")))
            have, last = have + summary["s"], tuple(summary["last"])
        if have != target:
            raise ValueError(f"groups can't fill {target}: {have}")
    none = ordered.select(key, size, F.lit(0).alias("level")).where(F.lit(False))
    return reduce(DataFrame.union, chosen, none)


def _fitting_prefix(left: DataFrame, key: str, size: str, room: int) -> DataFrame:
    """The longest prefix in (h, key) order whose sizes add up to no more than the room: sums by leading hash digits first, so no single task orders all groups."""
    lead = F.substring("h", 1, 3)
    sums = left.groupBy(lead.alias("lead")).agg(F.sum(size).alias("s"))
    before = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = left.withColumn("lead", lead).join(F.broadcast(before.where(F.col("before") < room).select("lead", "before")), "lead")
    running = F.col("before") + F.sum(size).over(Window.partitionBy("lead").orderBy("h", key).rowsBetween(Window.unboundedPreceding, 0))
    # a prefix ends at the first group that doesn't fit: all sums before it are smaller, so the test is on the sum itself
    return within.withColumn("running", running).where(F.col("running") <= room).select(key, size, "h")


def class_holdout(rows: DataFrame, label: str, least: int, seed: int) -> DataFrame:
    """Class partition: id, validation_ood or test_ood by hash order of the classes that are large enough (70/15/15, half-even, at least one each)."""
    classes = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    w = Window.orderBy("u", label)
    ranked = classes.withColumn("u", uniform(stable_hash(F.col(label), seed))).withColumn("place", F.row_number().over(w))
    k = F.lit(classes.count())
    n_id = F.least(F.greatest(F.bround(k * 0.70), F.lit(1)), k - 2)
    n_validation = F.least(F.greatest(F.bround(k * 0.15), F.lit(1)), k - n_id - 1)
    part = F.when(F.col("place") <= n_id, "id").when(F.col("place") <= n_id + n_validation, "validation_ood").otherwise("test_ood")
    return ranked.select(label, "n", part.alias("part"))


def group_safe(rows: DataFrame, group: str, part: str) -> DataFrame:
    """Adds the reason why a row goes: its group spans several parts."""
    spans = rows.groupBy(group).agg((F.count_distinct(part) > 1).alias("__spans"))
    return rows.join(spans, group, "left").withColumn("reason", F.when(F.coalesce("__spans", F.lit(False)), "group_spans_parts")).drop("__spans")


def role_of(group: Column, seed: int) -> Column:
    u = uniform(stable_hash(group, seed + 1))
    return F.when(u < 0.70, "train").when(u < 0.85, "calibration").otherwise("test")
