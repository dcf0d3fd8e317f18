"""Regression tables, rank tests, and bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.metrics import running_sums
from tidemark.operators.shared import reliable


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """(a d) / (b c) of counts; 0.5 is added to all cells only if one is 0."""
    add = F.when((a == 0) | (b == 0) | (c == 0) | (d == 0), 0.5).otherwise(0.0)
    return (a + add) * (d + add) / ((b + add) * (c + add))


def rank_sum(df: DataFrame, value: str, group: str, names: tuple[str, str]) -> DataFrame:
    """Mann-Whitney U of two groups with average ranks, normal p with tie correction, and Cliff's delta."""
    by_value = df.where(F.col(value).isNotNull() & F.col(group).isin(*names)).groupBy(value).agg(F.count_if(F.col(group) == names[0]).cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("t"))
    ranked = running_sums(by_value, value, {"t": "upto"}).withColumn("rank", F.col("upto") - F.col("t") + (F.col("t") + 1) / 2)
    s = ranked.agg(F.sum("a").alias("n1"), F.sum(F.col("t") - F.col("a")).alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.abs(u - n1 * n2 / 2) - 0.5, sd)
    return s.select(n1.alias("n1"), n2.alias("n2"), u.alias("u"), (2 * u / (n1 * n2) - 1).alias("cliffs_delta"), z.alias("z"))


def two_sided_p(z: float) -> float:
    return math.erfc(max(z, 0.0) / math.sqrt(2))


def ols(df: DataFrame, target: str, features: list[str]) -> dict[str, dict[str, float]]:
    """Least squares from one aggregate of normal-equation sums; coefficients, standard errors and normal 95 % limits."""
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    y = F.col(target).cast("double")
    names = ["intercept", *features]
    k = len(x)
    sums = [F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(a * y).alias(f"y{i}") for i, a in enumerate(x)]
    r = df.dropna(subset=[target, *features]).agg(F.count(F.lit(1)).alias("n"), F.sum(y * y).alias("yy"), *sums).first()
    if (free := r["n"] - k) <= 0:
        raise ValueError("too few rows for the model")
    xx = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    xy = np.array([r[f"y{i}"] for i in range(k)])
    beta = np.linalg.solve(xx, xy)
    variance = max(0.0, r["yy"] - beta @ xy) / free
    se = np.sqrt(np.diag(np.linalg.inv(xx)) * variance)
    return {name: {"beta": float(b), "se": float(s), "low": float(b - 1.959964 * s), "high": float(b + 1.959964 * s)} for name, b, s in zip(names, beta, se, strict=True)}


def variance_inflation(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Diagonal of the (pseudo-)inverse correlation matrix, from one aggregate of pairs."""
    k = len(features)
    r = df.agg(*(F.corr(features[i], features[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i + 1, k))).first()
    m = np.eye(k)
    for i in range(k):
        for j in range(i + 1, k):
            m[i, j] = m[j, i] = r[f"c{i}_{j}"]
    return dict(zip(features, np.diag(np.linalg.pinv(m)).tolist(), strict=True))


def logistic(df: DataFrame, target: str, numeric: list[str], categorical: list[str] = ()):
    """Binomial GLM; rows of (term, beta, se, odds ratio, limits, p) on complete cases, first categories as reference."""
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import GeneralizedLinearRegression

    complete = df.dropna(subset=[target, *numeric, *categorical])
    formula = RFormula(formula=f"{target} ~ {' + '.join([*numeric, *categorical])}", stringIndexerOrderType="alphabetDesc", featuresCol="__features", labelCol="__label")
    data = formula.fit(complete).transform(complete)
    model = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="__features", labelCol="__label", maxIter=50).fit(data)
    attrs = data.schema["__features"].metadata["ml_attr"]["attrs"]
    names = [a["name"] for a in sorted((a for kind in attrs.values() for a in kind), key=lambda a: a["idx"])] + ["intercept"]
    beta = [*model.coefficients.toArray().tolist(), model.intercept]
    se, p = model.summary.coefficientStandardErrors, model.summary.pValues
    rows = [(n, float(b), float(s), math.exp(b), math.exp(b - 1.959964 * s), math.exp(b + 1.959964 * s), float(q)) for n, b, s, q in zip(names, beta, se, p, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, beta double, se double, odds_ratio double, low double, high double, p double")


def nested_models(df: DataFrame, target: str, specs: dict[str, tuple[list[str], list[str]]], *, category: str, top: int = 20, sensitivity: Column | None = None) -> DataFrame:
    """A ladder of logistic models on one set of complete cases: model, n and the rows of ``logistic``.

    The cases are complete in all numeric and categorical columns of the ladder.  Two more models
    follow the last one given: with the ``top`` most frequent values of ``category`` (the rest are
    'other'), and that on the rows of the ``sensitivity`` condition.
    """
    numeric, categorical = specs[list(specs)[-1]]
    needed = sorted({target, category, *(c for n, k in specs.values() for c in (*n, *k))})
    rows = df.dropna(subset=needed)
    frequent = [r[0] for r in rows.groupBy(category).count().orderBy(F.desc("count"), category).limit(top).collect()]
    rows = rows.withColumn(category, F.when(F.col(category).isin(frequent), F.col(category)).otherwise("other")).persist()
    try:
        ladder = [(name, n, k, False) for name, (n, k) in specs.items()]
        ladder.append((f"M{len(specs)}", numeric, [*categorical, category], False))
        if sensitivity is not None:
            ladder.append((f"M{len(specs) + 1}", numeric, [*categorical, category], True))
        return _fitted_together(rows, target, ladder, F.lit(False) if sensitivity is None else F.coalesce(sensitivity, F.lit(False)))
    finally:
        rows.unpersist()


def _fitted_together(rows: DataFrame, target: str, ladder: list[tuple[str, list[str], list[str], bool]], sensitivity: Column, rounds: int = 50) -> DataFrame:
    """Logistic models (name, numeric, categorical, whether on the sensitive rows alone) by Newton steps; one pass of the rows is a step of all models that still move."""
    numbers = list(dict.fromkeys(c for _, n, _, _ in ladder for c in n))
    kinds = list(dict.fromkeys(c for _, _, k, _ in ladder for c in k))
    values = {k: sorted(((str(r[0]), r[1]) for r in rows.groupBy(k).agg(F.max(sensitivity)).collect()), reverse=True) for k in kinds}  # a row for each value
    terms = [*((c, None) for c in numbers), *((k, v) for k in kinds for v, _ in values[k])]
    names, columns = {}, {}
    for name, n, k, only in ladder:
        held = [*((c, None) for c in n), *((c, v) for c in k for v in [v for v, there in values[c] if there or not only][:-1])]
        names[name] = [c if v is None else f"{c}_{v}" for c, v in held] + ["intercept"]
        columns[name] = [*(terms.index(t) for t in held), len(terms)]
    only = {name: o for name, _, _, o in ladder}
    data = rows.select(F.col(target).cast("double").alias("y"), sensitivity.alias("s"), *(F.col(c).cast("double").alias(f"n{i}") for i, c in enumerate(numbers)), *(F.array_position(F.array(*(F.lit(v) for v, _ in values[k])), F.col(k).cast("string")).cast("int").alias(f"k{i}") for i, k in enumerate(kinds)))

    def sums(beta: dict[str, np.ndarray]) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
        """By model: rows, gradient and information at its coefficients."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = {m: [0, np.zeros(len(b)), np.zeros((len(b), len(b)))] for m, b in beta.items()}
            for batch in batches:
                at = lambda c: batch[c].to_numpy(zero_copy_only=False)  # noqa: B023, E731
                hot = [at(f"k{i}")[:, None] == np.arange(1, len(values[k]) + 1) for i, k in enumerate(kinds)]
                whole = np.column_stack([*(at(f"n{i}") for i in range(len(numbers))), *hot, np.ones(batch.num_rows)]).astype(float)
                target_of, sensitive = at("y"), at("s")
                for m, b in beta.items():
                    x, y = whole[:, columns[m]], target_of
                    if only[m]:
                        x, y = x[sensitive], y[sensitive]
                    mu = 1 / (1 + np.exp(-np.clip(x @ b, -700, 700)))
                    found[m][0] += len(y)
                    found[m][1] += x.T @ (y - mu)
                    found[m][2] += x.T @ (x * (mu * (1 - mu))[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([n for n, _, _ in found.values()], pa.int64()), pa.array([np.append(g, h).tolist() for _, g, h in found.values()], pa.list_(pa.float64()))], ["model", "n", "sums"])

        size = max(map(len, beta.values()))
        parts = data.mapInArrow(run, "model string, n long, sums array<double>")
        added = parts.groupBy("model").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", i)).alias(f"s{i}") for i in range(size * (size + 1)))).collect()
        out = {}
        for r in added:
            k = len(beta[r["model"]])
            flat = np.array([r[f"s{i}"] for i in range(k * (k + 1))])
            out[r["model"]] = (r["n"], flat[:k], flat[k:].reshape(k, k))
        return out

    beta, moving, done = {m: np.zeros(len(c)) for m, c in columns.items()}, set(columns), {}
    for _ in range(rounds):
        for m, (n, gradient, information) in sums({m: beta[m] for m in columns if m in moving}).items():
            inverse = np.linalg.pinv(information, hermitian=True)
            step = inverse @ gradient
            done[m] = (n, np.sqrt(np.maximum(0, np.diag(inverse))))
            if np.abs(step).max() <= 1e-9 * (1 + np.abs(beta[m]).max()):
                moving.discard(m)
            beta[m] = beta[m] + step
        if not moving:
            break
    out = []
    for m in columns:
        n, errors = done[m]
        for term, b, e in zip(names[m], beta[m].tolist(), errors.tolist(), strict=True):
            p = math.erfc(abs(b) / e / math.sqrt(2)) if e else float("nan")
            out.append((term, b, e, math.exp(b), math.exp(b - 1.959964 * e), math.exp(b + 1.959964 * e), p, m, n))
    return rows.sparkSession.createDataFrame(out, "term string, beta double, se double, odds_ratio double, low double, high double, p double, model string, n long")


def bootstrap_mean(df: DataFrame, value: str, replicates: int = 500, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean of the finite values.

    A row's weight in a replicate is Poisson(1), so n rows of one value weigh Poisson(n): each
    distinct value draws one number for each replicate, seeded by its hash, and a task adds them up.
    """
    x = F.col(value).cast("double")
    counts = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("v", F.lit(seed)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, total = np.zeros(replicates), np.zeros(replicates)
        for b in batches:
            for v, n, h in zip(b["v"], b["n"], b["h"], strict=True):
                w = np.random.Generator(np.random.Philox(h & 0x7FFFFFFFFFFFFFFF)).poisson(n, replicates)
                weight += w
                total += w * v
        yield pd.DataFrame({"r": np.arange(replicates), "w": weight, "s": total})

    means = counts.mapInPandas(run, "r long, w double, s double").groupBy("r").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.count("m").alias("replicates"))


#: Rows whose weights in all replicates are held at once.
TOGETHER = 256


def weighted_auroc(df: DataFrame, group: str, score: str, label: str, replicates: int, seed: int = 0) -> DataFrame:
    """r, auroc: the AUROC of each replicate, in which a group weighs Poisson(1), seeded by its hash; null where one class has no weight.

    Rows are counted by group and score and sorted by score once, in ranges.  A task walks its range
    with one running sum of weights for each replicate and sends on one row: the weights of both
    classes, and the pairs that are in order within the range.  The ranges are then put together in
    order, so no row is written for a score and a replicate.
    """

    def weights(h: np.ndarray, drawn: dict) -> np.ndarray:
        """Rows of Poisson draws; those of some thousand groups are kept for the next rows."""
        if len(drawn) >= 4_096:
            drawn.clear()
        for x in set(h.tolist()) - drawn.keys():
            drawn[x] = np.random.Generator(np.random.Philox(x & 0x7FFFFFFFFFFFFFFF)).poisson(1, replicates).astype(np.float64)
        return np.stack([drawn[x] for x in h.tolist()])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, drawn, zero = None, {}, np.zeros(replicates)
        positive, negative, ordered, tie, tie_p, tie_n = zero.copy(), zero.copy(), zero.copy(), None, zero.copy(), zero.copy()
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                rows = batch.iloc[at : at + TOGETHER]
                part = int(rows["part"].iloc[0])
                w, x = weights(rows["h"].to_numpy(), drawn), rows["score"].to_numpy()
                starts = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1])
                p = np.add.reduceat(w * rows["pos"].to_numpy()[:, None], starts)
                n = np.add.reduceat(w * rows["neg"].to_numpy()[:, None], starts)
                if tie == x[0]:
                    p[0] += tie_p
                    n[0] += tie_n
                elif tie is not None:
                    p, n = np.vstack([tie_p, p]), np.vstack([tie_n, n])
                # the last score may go on in the next rows
                tie, tie_p, tie_n, p, n = x[-1], p[-1], n[-1], p[:-1], n[:-1]
                if len(p):
                    before = negative + np.cumsum(n, axis=0) - n
                    ordered += (p * (before + n / 2)).sum(0)
                    positive, negative = positive + p.sum(0), negative + n.sum(0)
        if part is not None:
            ordered += tie_p * (negative + tie_n / 2)
            yield pd.DataFrame({"part": [part], "positive": [positive + tie_p], "negative": [negative + tie_n], "ordered": [ordered]})

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        positive, negative, ordered = np.zeros(replicates), np.zeros(replicates), np.zeros(replicates)
        for batch in batches:
            for p, n, u in zip(batch["positive"], batch["negative"], batch["ordered"], strict=True):
                ordered += np.asarray(u) + np.asarray(p) * negative
                positive, negative = positive + np.asarray(p), negative + np.asarray(n)
        both = positive * negative
        yield pd.DataFrame({"r": np.arange(replicates), "auroc": [float(u / b) if b > 0 else None for u, b in zip(ordered, both, strict=True)]})

    counts = df.where(F.col(score).isNotNull()).groupBy(F.xxhash64(group, F.lit(seed)).alias("h"), F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    ranged = counts.repartitionByRange("score").sortWithinPartitions("score", "h").withColumn("part", F.spark_partition_id())
    parts = reliable(ranged.mapInPandas(walk, "part int, positive array<double>, negative array<double>, ordered array<double>"))
    # one row for each range, in order, through one task that holds a row
    return parts.repartition(1).sortWithinPartitions("part").mapInPandas(together, "r long, auroc double")


def paired_bootstrap(df: DataFrame, group: str, left: str, right: str, label: str, replicates: int, seed: int = 0, least: int = 0) -> DataFrame:
    """Replicates of the AUROC of two scores on the same resampled groups: r, left, right, delta.

    A group's weight in a replicate is the same for both scores.  Replicates of one class are skipped;
    fewer than ``least`` valid ones raise.
    """
    side = lambda score, name: weighted_auroc(df, group, score, label, replicates, seed).where("auroc IS NOT NULL").select("r", F.col("auroc").alias(name))
    out = side(left, "left").join(side(right, "right"), "r").withColumn("delta", F.col("left") - F.col("right"))
    if least and (valid := out.count()) < least:
        raise ValueError(f"{valid} valid replicates, {least} are needed")
    return out


def run_summary(runs: DataFrame, run: str, keys: list[str], value: str, replicates: int = 1_000) -> DataFrame:
    """By key over at least two runs: runs, mean, deviation, least, most, and the bootstrap interval of the mean.

    All runs must have the same keys, once each.  A replicate draws as many runs as there are, by
    hash, the same ones for every key.
    """
    names = runs.select(run).distinct()
    k = names.count()
    if k < 2:
        raise ValueError("fewer than two runs")
    if runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(run).alias("d")).where((F.col("n") != k) | (F.col("d") != k)).limit(1).count():
        raise ValueError("runs differ in their keys")
    by = Window.orderBy(run)
    placed = runs.join(F.broadcast(names.withColumn("__place", F.row_number().over(by) - 1)), run)
    values = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__place", F.col(value).alias("v")))).alias("__v"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"))
    draws = lambda r: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.get("__v", F.pmod(F.xxhash64(r, j), F.lit(k)).cast("int"))["v"])
    means = values.withColumn("__m", F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda r: F.aggregate(draws(r), F.lit(0.0), lambda a, x: a + x) / k))
    at = lambda q: F.get(F.array_sort("__m"), F.lit(int(q * (replicates - 1))))
    return means.select(*keys, F.lit(k).alias("runs"), "mean", "sd", "least", "most", at(0.025).alias("low"), at(0.975).alias("high"))


def delta_summary(replicates: DataFrame, by: list[str], delta: str = "delta") -> DataFrame:
    d = F.col(delta)
    return replicates.groupBy(*by).agg(F.avg(d).alias("mean"), F.percentile(delta, F.lit(0.5)).alias("median"), F.percentile(delta, F.lit(0.025)).alias("low"), F.percentile(delta, F.lit(0.975)).alias("high"), F.avg((d > 0).cast("double")).alias("p_positive"), F.count(delta).alias("valid"))
