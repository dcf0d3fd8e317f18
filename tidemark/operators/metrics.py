"""Exact ranking and classification metrics, with ties and weights, in windowed aggregates.

The curve is made of one row for each distinct score of a group, so running sums go over distinct
scores only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.contracts import same
from tidemark.operators.ranges import FEW, running


def curve(df: DataFrame, group: list[str], score: str, label: str, weight: Column | None = None) -> DataFrame:
    """tp, fp at each distinct score from high to low, the totals, and tp and fp of the score before and after.

    The scores are summed up in ranges, so no task holds a group.
    """
    w = F.lit(1.0) if weight is None else weight
    by_score = df.where(F.col(score).isNotNull()).groupBy(*group, score).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("__p"), F.sum(F.when(F.col(label) == 1, 0.0).otherwise(w)).alias("__n"))
    out = running(by_score, group, [score], {"__p": "tp", "__n": "fp"}, descending=True)
    totals = by_score.groupBy(*group).agg(F.sum("__p").alias("pos"), F.sum("__n").alias("neg"))
    if group:
        names = [f"__t{i}" for i in range(len(group))]
        totals = totals.select(*(F.col(c).alias(n) for c, n in zip(group, names, strict=True)), "pos", "neg")
        out = out.join(F.broadcast(totals) if totals.limit(FEW + 1).count() <= FEW else totals, same(group, names)).drop(*names)
    else:
        out = out.crossJoin(F.broadcast(totals))
    before = {"tp0": F.col("tp") - F.col("__p"), "fp0": F.col("fp") - F.col("__n"), "tp1": F.col("tp") + F.col("__p1"), "fp1": F.col("fp") + F.col("__n1")}
    return out.withColumns(before).drop("__p1", "__n1")


def running_sums(df: DataFrame, order: str, sums: dict[str, str], *, descending: bool = False) -> DataFrame:
    """Adds running sums of columns in the order of another (of distinct values), under the names given, and each column's next value (``__p`` gives ``__p1``)."""
    return running(df, [], [order], sums, descending=descending)


def ranking(df: DataFrame, group: list[str], score: str, label: str, weight: Column | None = None, recall: float = 0.95) -> DataFrame:
    """AUROC, average precision, and the false positive rate where the recall is reached.

    For the last one, points in line with both neighbours are left out, as usual ROC curves do.
    """
    c = curve(df, group, score, label, weight)
    area = F.try_divide(F.sum((F.col("fp") - F.col("fp0")) * (F.col("tp") + F.col("tp0")) / 2), F.max("pos") * F.max("neg"))
    precision = F.try_divide(F.sum((F.col("tp") - F.col("tp0")) * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))), F.max("pos"))
    first = (F.col("tp0") == 0) & (F.col("fp0") == 0)
    bent = F.coalesce((F.col("tp1") - F.col("tp") != F.col("tp") - F.col("tp0")) | (F.col("fp1") - F.col("fp") != F.col("fp") - F.col("fp0")), F.lit(True))
    kept = c.withColumn("kept", first | bent)
    reached = F.min(F.when(F.col("kept") & (F.col("tp") >= recall * F.col("pos")), F.try_divide("fp", "neg")))
    return kept.groupBy(*group).agg(area.alias("auroc"), precision.alias("average_precision"), F.coalesce(reached, F.lit(1.0)).alias("fpr_at_recall"))


def best_threshold(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """The score with the largest TPR - FPR, the higher one on ties."""
    c = curve(df, group, score, label)
    j = F.try_divide("tp", "pos") - F.try_divide("fp", "neg")
    return c.groupBy(*group).agg(F.max_by(score, F.struct(j.alias("j"), F.col(score).alias("s"))).alias("threshold"), F.max(j).alias("youden"))


def thresholded(df: DataFrame, group: list[str], truth: Column, guess: Column, weight: Column | None = None) -> DataFrame:
    """Accuracy, balanced accuracy, F1, MCC, false reject and false accept rates of 0/1 labels."""
    w = F.lit(1.0) if weight is None else weight
    cell = lambda t, g: F.sum(F.when((truth == t) & (guess == g), w).otherwise(0.0))
    c = df.groupBy(*group).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        *group,
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0)).alias("mcc"),
        F.try_divide(fp, fp + tn).alias("false_reject"),
        F.try_divide(fn, fn + tp).alias("false_accept"),
    )


def macro_f1(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Mean F1 over the classes of either column."""
    both = df.select(F.explode(F.array(F.struct(F.col(truth).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("g"), (F.col(truth) == F.col(guess)).cast("int").alias("hit")), F.struct(F.col(guess).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("g"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    per = both.groupBy("c").agg((2 * F.sum("hit") / (F.sum("t") + F.sum("g"))).alias("f1"))
    return per.agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_classes"))


def brier(p: Column, y: Column, weight: Column | None = None) -> Column:
    e = (p - y) * (p - y)
    return F.avg(e) if weight is None else F.try_divide(F.sum(weight * e), F.sum(weight))
