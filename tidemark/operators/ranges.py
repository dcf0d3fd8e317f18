"""Running sums, ranks and exact quantiles of groups of any size.

Rows are dealt out in ranges of (group, order), so a large group is many tasks and a task has many
small groups.  Sums of whole ranges are added up first, then those inside.  Only a group that goes on
from one range into the next needs more than its own range; at each of the bounds between ranges
there is one such group at most, so what is known of them is broadcast and has two rows a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.contracts import same
from tidemark.operators.shared import reliable

#: Groups whose totals are broadcast at most.
FEW = 500_000


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, str], *, descending: bool = False) -> DataFrame:
    """Adds running sums of columns within ``by`` in the order of others, under the names given, and each column's next value (``n`` gives ``n1``).

    Rows of a group should differ in the order columns: equal ones stand together in one task, in any order.
    """
    put = [F.desc(c) if descending else F.asc(c) for c in order]
    ranged = reliable(df.repartitionByRange(*(F.asc(c) for c in by), *put).withColumn("__part", F.spark_partition_id()))
    place = F.struct(*order)
    ends = F.max_by if descending else F.min_by
    parts = ranged.groupBy(*by, "__part").agg(*(F.sum(c).alias(f"__sum{c}") for c in sums), *(ends(c, place).alias(f"__first{c}") for c in sums))
    group = Window.partitionBy(*by)
    over = group.orderBy("__part")
    names = [f"__g{i}" for i in range(len(by))]
    going_on = parts.withColumn("__n", F.count(F.lit(1)).over(group)).where("__n > 1")
    before = going_on.select(
        *(F.col(c).alias(n) for c, n in zip(by, names, strict=True)), F.col("__part").alias("__of_part"),
        *(F.sum(f"__sum{c}").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias(f"__before{c}") for c in sums), *(F.lead(f"__first{c}").over(over).alias(f"__next{c}") for c in sums),
    )
    inside = Window.partitionBy(*by, "__part").orderBy(*put)
    upto = lambda c: F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    out = ranged.withColumns({name: upto(c) for c, name in sums.items()} | {f"{c}1": F.lead(c).over(inside) for c in sums})
    out = out.join(F.broadcast(before), same([*by, "__part"], [*names, "__of_part"]), "left")
    out = out.withColumns({name: F.coalesce(F.col(f"__before{c}") + F.col(name), F.col(name)) for c, name in sums.items()} | {f"{c}1": F.coalesce(f"{c}1", f"__next{c}") for c in sums})
    return out.drop("__part", "__of_part", *names, *(f"__{k}{c}" for k in ("before", "next") for c in sums))


def ranked(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the place of a row in its group, from 1."""
    return running(df.withColumn("__one", F.lit(1).cast("long")), by, order, {"__one": name}).drop("__one", "__one1")


def quantiles(df: DataFrame, by: list[str], value: str | Column, probs: dict[str, float]) -> DataFrame:
    """One row for each group that has values: exact quantiles under the names given, between two values in proportion.

    Nulls don't count.  Equal values are counted first, so a group has a row for each different value.
    """
    x = F.col(value) if isinstance(value, str) else value
    counts = reliable(df.select(*by, x.alias("__x")).where("__x IS NOT NULL").groupBy(*by, "__x").agg(F.count(F.lit(1)).alias("__n")))
    totals = counts.groupBy(*by).agg(F.sum("__n").alias("__total"))
    upto = running(counts, by, ["__x"], {"__n": "__upto"})
    if not by:
        held = upto.crossJoin(F.broadcast(totals))
    else:
        names = [f"__t{i}" for i in range(len(by))]
        of = totals.select(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True)), "__total")
        held = upto.join(F.broadcast(of) if of.limit(FEW + 1).count() <= FEW else of, same(by, names)).drop(*names)

    def at(k: Column) -> Column:
        return F.max(F.when((F.col("__upto") - F.col("__n") <= k) & (k < F.col("__upto")), F.col("__x").cast("double")))

    def between(p: float) -> Column:
        k = F.lit(float(p)) * (F.col("__total") - 1)
        low, high = F.floor(k), F.ceil(k)
        exact = F.max(k) == F.max(low)
        return F.when(exact, at(low)).otherwise((F.max(high) - F.max(k)) * at(low) + (F.max(k) - F.max(low)) * at(high))

    return held.groupBy(*by).agg(*(between(p).alias(name) for name, p in probs.items()))
