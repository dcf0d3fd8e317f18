"""Open-set scores; a larger score is more out of distribution."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vectors import cosine, logsumexp, softmax_max
from tidemark.operators.shared import reliable

#: Classes whose state is broadcast at most; rows of a block of vectors, and of a tile of one.
CLASSES, BLOCK, TILE = 2_000, 8_192, 1_024


def msp(logits: Column) -> Column:
    """1 - the largest softmax; a single logit z becomes [-z, z]."""
    z = F.when(F.size(logits) == 1, F.array(-logits[0], logits[0])).otherwise(logits)
    return 1 - softmax_max(z)


def max_logit(logits: Column) -> Column:
    return -F.array_max(logits)


def energy(logits: Column, temperature: float = 1.0) -> Column:
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    return -temperature * logsumexp(F.transform(logits, lambda z: z / temperature))


def distance_state(train: DataFrame, label: str, vector: str, floor: float = 1e-4) -> DataFrame:
    """One row for each class: its mean, the global mean and the pooled within-class variance (ddof 1)."""
    long = train.select(label, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    means = long.groupBy(label, "dim").agg(F.avg("x").alias("m"), F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    joined = long.join(means.select(label, "dim", "m"), [label, "dim"])
    pooled = joined.groupBy("dim").agg((F.sum((F.col("x") - F.col("m")) ** 2) / (F.count(F.lit(1)) - 1)).alias("v"))
    whole = means.groupBy("dim").agg((F.sum("s") / F.sum("n")).alias("g"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("dim", F.col(c).alias("x")))), lambda t: t["x"])
    flat = means.join(pooled, "dim").join(whole, "dim").withColumn("v", F.greatest("v", F.lit(floor)))
    return flat.groupBy(label).agg(ordered("m").alias("mean"), ordered("g").alias("global_mean"), ordered("v").alias("variance"), F.max("n").alias("n"))


def mahalanobis(x: Column, mean: Column, variance: Column) -> Column:
    d = F.zip_with(x, mean, lambda a, b: (a - b) * (a - b))
    return F.aggregate(F.zip_with(d, variance, lambda a, v: a / v), F.lit(0.0), lambda s, t: s + t)


def distance_scores(df: DataFrame, key: str, vector: str, state: DataFrame, label: str) -> DataFrame:
    """Diagonal Mahalanobis, its relative form, and prototype cosine; the state is one row for each class."""
    x = F.transform(vector, lambda v: v.cast("double"))
    # classes against rows: the state is small in any sane problem, and beyond that Spark has to shuffle it
    both = df.select(key, x.alias("__x")).crossJoin(F.broadcast(state) if state.count() <= CLASSES else state)
    d = mahalanobis(F.col("__x"), F.col("mean"), F.col("variance"))
    g = mahalanobis(F.col("__x"), F.col("global_mean"), F.col("variance"))
    return both.groupBy(key).agg(F.min(d).alias("mahalanobis"), F.min(d - g).alias("relative_mahalanobis"), (1 - F.max(cosine(F.col("__x"), F.col("mean")))).alias("prototype_cosine"))


def nearest_cosine(queries: DataFrame, train: DataFrame, key: str, vector: str, k: int = 10, block: int = BLOCK) -> DataFrame:
    """1 - mean of the k largest cosines, exactly.

    Both sides are dealt out in blocks, whose rows are stored side by side as one value, so a block that
    meets all blocks of the other side is copied as bytes and not row by row.  A task meets pairs of
    blocks in tiles of rows; of a tile only what exceeds the k-th best so far is looked at.
    """
    n_train, n_query = (max(1, -(-d.count() // block)) for d in (train, queries))
    kind = queries.schema[key].dataType.simpleString()

    def packed(df: DataFrame, seed: int, n: int, into: str) -> DataFrame:
        """A row for each block: its place, its keys, and its unit vectors as bytes."""

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            m = np.stack(rows["v"].to_numpy()).astype(float)
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            return pd.DataFrame({"b": [rows["b"].iloc[0]], "k": [rows["k"].to_numpy()], "m": [m.tobytes()]})

        placed = df.select(F.col(key).alias("k"), F.col(vector).alias("v")).withColumn("b", F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(n)).cast("int"))
        return placed.repartition(n, "b").groupBy("b").applyInPandas(one, f"b int, k array<{kind}>, m binary").select(*(F.col(c).alias(f"{into}{c}") for c in "bkm"))

    q, t = reliable(packed(queries, 42, n_query, "q")), reliable(packed(train, 1, n_train, "t").drop("tk"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch["qk"][i].values
                a, b = (np.frombuffer(batch[c][i].as_buffer()) for c in ("qm", "tm"))
                a = a.reshape(len(keys), -1)
                b = b.reshape(-1, a.shape[1])
                tops = np.full((len(keys), min(k, len(b))), -np.inf)
                for x in range(0, len(a), TILE):
                    top = tops[x : x + TILE]
                    for y in range(0, len(b), TILE):
                        c = a[x : x + TILE] @ b[y : y + TILE].T
                        rows = np.flatnonzero(c.max(1) > top[:, 0])
                        if len(rows):
                            both = np.concatenate([top[rows], c[rows]], axis=1)
                            both = np.partition(both, both.shape[1] - top.shape[1], axis=1)[:, -top.shape[1] :]
                            top[rows] = np.sort(both, axis=1)
                ends = np.arange(len(keys) + 1, dtype=np.int32) * tops.shape[1]
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends), pa.array(tops.ravel()))], ["q", "c"])

    # every partition of the one side with every one of the other: a task for a few pairs of blocks, nothing broadcast or shuffled
    local = q.crossJoin(t.hint("shuffle_replicate_nl")).select("qk", "qm", "tm").mapInArrow(best, f"q {kind}, c array<double>")
    top = F.slice(F.sort_array(F.flatten(F.collect_list("c")), asc=False), 1, k)
    mean = F.aggregate("c", F.lit(0.0), lambda s, x: s + x) / F.size("c")
    return local.groupBy("q").agg(top.alias("c")).select(F.col("q").alias(key), (1 - mean).alias("knn_cosine"))
