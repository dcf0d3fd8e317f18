"""Feature preparation and models: cohorts, scaling, PCA, selection on validation, null controls."""

from __future__ import annotations

import hashlib
import json
import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import stable_hash
from tidemark.operators.contracts import ContractError, checked_join
from tidemark.operators.metrics import ranking
from tidemark.operators.ranges import ranked


def scaled(df: DataFrame, columns: list[str], train) -> DataFrame:
    """Mean 0 and population deviation 1 by the train rows, applied to all; a constant column becomes 0."""
    stats = df.where(train).agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.crossJoin(F.broadcast(stats))
    return out.withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")), F.lit(0.0)) for c in columns}).select(*df.columns)


def scaled_vectors(df: DataFrame, vector: str, train, into: str) -> DataFrame:
    """The same for an array column, by one aggregate over (place, value)."""
    stats = df.where(train).select(F.posexplode(vector).alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    one = stats.agg(F.array_sort(F.collect_list(F.struct("p", "m", "s"))).alias("__st"))
    z = F.zip_with(vector, "__st", lambda x, t: F.coalesce(F.try_divide(x.cast("double") - t["m"], t["s"]), F.lit(0.0)))
    return df.crossJoin(F.broadcast(one)).withColumn(into, z).drop("__st")


def pca(df: DataFrame, vector: str, train, components: int, into: str):
    """Principal components fitted on the train rows (already centred vectors); the frame and the explained shares."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    with_v = df.withColumn("__v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = PCA(k=components, inputCol="__v", outputCol="__pc").fit(with_v.where(train))
    return model.transform(with_v).withColumn(into, vector_to_array("__pc")).drop("__v", "__pc"), model.explainedVariance.toArray().tolist()


def fused(left: DataFrame, right: DataFrame, key: str, vector: str) -> DataFrame:
    """One vector of two modalities, one to one on the key."""
    both = checked_join(left.select(key, F.col(vector).alias("__a")), right.select(key, F.col(vector).alias("__b")), [key])
    return both.select(key, F.concat("__a", "__b").alias(vector))


def fusion_variants(left: DataFrame, right: DataFrame, key: str, vector: str, train, components: int) -> DataFrame:
    """key, variant, embedding: native (concatenated), each modality's components concatenated, joint components, and balanced ones.

    Scaling and components are fitted on the train rows (a condition on the key).  In the balanced
    variant both modalities weigh the same: each is divided by the root of its width first.
    """
    one = lambda df, name: pca(scaled_vectors(df.select(key, vector), vector, train, "__z"), "__z", train, components, name)[0].select(key, F.col("__z").alias(f"{name}_z"), name)
    a, b = one(left, "__a"), one(right, "__b")
    if left.join(right.select(key), key, "left_anti").limit(1).count() or right.join(left.select(key), key, "left_anti").limit(1).count():
        raise ValueError("the modalities have different keys")
    native = fused(left, right, key, vector).withColumnRenamed(vector, "native")
    both = checked_join(checked_join(a, b, [key]), native, [key])
    share = lambda c: F.transform(c, lambda x: x / F.sqrt(F.size(c)))
    both = both.withColumns({"__joint": F.concat("__a_z", "__b_z"), "__balanced": F.concat(share("__a_z"), share("__b_z"))})
    both = pca(both, "__joint", train, components, "joint")[0]
    both = pca(both, "__balanced", train, components, "balanced")[0]
    both = both.withColumns({"separate": F.concat("__a", "__b"), "native": F.transform("native", lambda x: x.cast("double"))})
    names = ["native", "separate", "joint", "balanced"]
    out = both.select(key, F.inline(F.array(*(F.struct(F.lit(n).alias("variant"), F.col(n).alias(vector)) for n in names))))
    widths = out.groupBy("variant").agg(F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b")).where("a <> b")
    if widths.limit(1).count():
        raise ValueError("a variant has vectors of several widths")
    return out


def aligned_features(cohort: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """The cohort's rows with their features; a row without features, or features of repeated keys, are an error."""
    out = checked_join(cohort, features, [key], "left", "many_to_one")
    extra = [c for c in features.columns if c != key]
    without = features.select(key).withColumn("__found", F.lit(True))
    if n := cohort.join(without, key, "left_anti").count():
        raise ContractError(f"{n} rows of the cohort have no features")
    return out.select(*cohort.columns, *extra)


def selected_logistic(df: DataFrame, features: str, label: str, split: str, grid=(0.01, 0.1, 1.0, 10.0, 100.0)):
    """Logistic regression whose C has the best average precision on validation; its predictions on all rows, and C.

    The penalties share one cached training frame, and one query ranks all of their validation scores.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = df.withColumn("__f", array_to_vector(F.transform(features, lambda x: x.cast("double")))).withColumn("__y", F.col(label).cast("double"))
    train = data.where(F.col(split) == "train").select("__f", "__y").persist()
    try:
        n = train.count()
        fit = lambda c: LogisticRegression(featuresCol="__f", labelCol="__y", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=50, predictionCol="__g", rawPredictionCol="__r", probabilityCol="__p").fit(train)
        models = {c: fit(c) for c in grid}
    finally:
        train.unpersist()
    probability = vector_to_array("__p")[1]
    held = data.where(F.col(split) == "validation").select("__f", label)
    scored = reduce(DataFrame.unionByName, (m.transform(held).select(F.lit(c).alias("__c"), label, probability.alias("__s")) for c, m in models.items()))
    found = {r["__c"]: r["average_precision"] or 0.0 for r in ranking(scored, ["__c"], "__s", label).select("__c", "average_precision").collect()}
    best = max(grid, key=lambda c: (found.get(c, 0.0), -grid.index(c)))
    out = models[best].transform(data).withColumn("probability", probability).drop("__f", "__y", "__g", "__r", "__p")
    return out, best


def multiclass(df: DataFrame, features: str, label: str, train, into: str = "logits", penalty: float = 1e-3) -> DataFrame:
    """Multinomial regression with balanced class weights, fitted on the train rows; adds the array of class scores and ``predicted``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = df.withColumn("__f", array_to_vector(F.transform(features, lambda x: x.cast("double"))))
    known = data.where(train)
    index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc", handleInvalid="error").fit(known)
    weighted = index.transform(known).join(F.broadcast(class_weights(known, label)), label)
    model = LogisticRegression(family="multinomial", featuresCol="__f", labelCol="__y", weightCol="weight", regParam=penalty, maxIter=100, predictionCol="__g", rawPredictionCol="__r", probabilityCol="__p").fit(weighted)
    names = F.array(*map(F.lit, index.labels))
    return model.transform(data).withColumns({into: vector_to_array("__r"), "predicted": F.get(names, F.col("__g").cast("int"))}).drop("__f", "__g", "__r", "__p")


def predictions(scored: DataFrame, key: str, group: str, label: str, probability: str, split: str, *, task: str, representation: str, config: dict) -> DataFrame:
    """The table of predictions: key, group, task, split, truth, representation, probability, predicted label, and hashes of the configuration and of the split.

    The split's hash is a sum of row hashes over (key, split), so the order of rows doesn't matter.
    """
    digest = scored.agg(F.sum(F.xxhash64(F.col(key).cast("string"), F.col(split)).cast("decimal(38,0)")).cast("string").alias("d"), F.count(F.lit(1)).alias("n"))
    split_hash = digest.select(F.sha2(F.concat_ws(":", "n", "d"), 256).alias("split_hash"))
    named = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()
    p = F.col(probability)
    rows = scored.select(key, F.col(group).alias("homology_group"), F.lit(task).alias("task"), split, F.col(label).cast("int").alias("y_true"), F.lit(representation).alias("representation"), p.alias("probability_positive"), (p >= 0.5).cast("int").alias("predicted_label"), F.lit(named).alias("config_hash"))
    return rows.crossJoin(F.broadcast(split_hash))


def canonical_results(sources: dict[str, DataFrame], keys: list[str], metric: str) -> DataFrame:
    """Sources (scope to table) stacked, one row for each key (the first scope by name wins), finite metrics only."""
    stacked = reduce(DataFrame.unionByName, (d.select(*keys, F.col(metric).cast("double").alias(metric)).withColumn("scope", F.lit(scope)) for scope, d in sources.items()))
    finite = stacked.where(F.col(metric).isNotNull() & ~F.isnan(metric) & (F.abs(metric) < float("inf")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("scope"))
    return finite.withColumn("__place", place).where("__place = 1").drop("__place")


def master_table(results: DataFrame, by: list[str], method: str, metric: str, classical: list[str], support: DataFrame) -> DataFrame:
    """One row for each ``by``: the best method and metric, the best classical one, the margin between them, and the support columns joined where there are any."""
    best = lambda rows, name: rows.groupBy(*by).agg(F.max_by(method, F.struct(F.col(metric), F.col(method))).alias(f"{name}_method"), F.max(metric).alias(f"{name}_{metric}"))
    out = best(results, "best").join(best(results.where(F.col(method).isin(classical)), "classical"), by, "left")
    out = out.withColumn("margin", F.col(f"best_{metric}") - F.col(f"classical_{metric}"))
    return checked_join(out, support, by, "left")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k n_c)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    total = counts.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(total)).select(label, (F.col("n") / (F.col("k") * F.col("n_c"))).alias("weight"))


def permuted_labels(df: DataFrame, key: str, label: str, by: str, seed: int, *, keep: str | None = None) -> DataFrame:
    """Labels dealt anew within ``by``: the i-th row by key gets the label of the i-th row by hash; ``keep`` names a column for the old one.

    Rows are placed in ranges, so a large ``by`` is many tasks.  Those in hash order are the digest's bytes
    and the label only.
    """
    a = ranked(df, [by], [key], "__i")
    b = ranked(df.select(by, label, F.unhex(stable_hash(F.col(key), seed)).alias("__h")), [by], ["__h"], "__i").select(by, "__i", F.col(label).alias("__new"))
    both = a.join(b, [by, "__i"]).drop("__i")
    return (both.drop(label) if keep is None else both.withColumnRenamed(label, keep)).withColumnRenamed("__new", label)


def random_features(df: DataFrame, key: str, width: int, seed: int, into: str) -> DataFrame:
    """A null control: standard normal features by the hash of the key and the place (Box and Muller), which know nothing else of the row."""
    uniform = lambda i, part: (F.pmod(F.xxhash64(key, F.lit(seed), i, F.lit(part)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = lambda i: F.sqrt(-2 * F.log(uniform(i, 0))) * F.cos(2 * math.pi * uniform(i, 1))
    return df.withColumn(into, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), normal))


def near_chance(metrics: DataFrame, prevalence: float, within: float = 0.1) -> DataFrame:
    """Adds whether AUROC and average precision are those of a guess."""
    return metrics.withColumn("near_chance", (F.abs(F.col("auroc") - 0.5) <= within) & (F.abs(F.col("average_precision") - prevalence) <= within))


def cohort(df: DataFrame, tasks: dict[str, object]) -> DataFrame:
    """Rows of each task (a condition) with the task's name."""
    return reduce(DataFrame.unionByName, (df.where(c).withColumn("task", F.lit(name)) for name, c in tasks.items()))
