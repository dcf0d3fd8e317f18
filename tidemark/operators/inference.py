"""Batch inference with a pluggable backend, pooling, windowed inference, and vector indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import bucket
from tidemark.operators.sequences import windows


def embed(df: DataFrame, key: str, text: str, backend: Callable[[], Callable[[list[str]], list[list[float]]]], *, shards: int, done: DataFrame | None = None, batch: int = 64) -> DataFrame:
    """key, shard, embedding.  Rows are dealt to hash shards and sorted by length; the backend is made once in a task; keys in ``done`` are skipped."""
    left = df if done is None else df.join(done.select(key), key, "left_anti")
    dealt = left.select(key, text, bucket(F.col(key), shards).alias("shard")).repartition("shard").sortWithinPartitions("shard", F.length(text), key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend()
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                yield pd.DataFrame({key: part[key], "shard": part["shard"], "embedding": model(part[text].fillna("").tolist())})

    return dealt.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, shard int, embedding array<float>")


def mock_embedding(key: Column, width: int) -> Column:
    """Deterministic vector of a key, uniform in [-1, 1)."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (F.pmod(F.xxhash64(key.cast("string"), i), F.lit(1 << 24)) / float(1 << 23) - 1).cast("float"))


def pooled(tokens: DataFrame, key: str, position: str, vector: str, mask: str) -> DataFrame:
    """Masked mean and last masked vector of token rows."""
    valid = tokens.where(F.col(mask))
    mean = valid.select(key, F.posexplode(vector).alias("d", "x")).groupBy(key, "d").agg(F.avg("x").alias("x")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda t: t["x"]).alias("mean"))
    return mean.join(valid.groupBy(key).agg(F.max_by(vector, position).alias("last")), key)


def weighted_windows(windows: DataFrame, key: str, vector: str, length: str) -> DataFrame:
    """Length-weighted mean of a record's window vectors."""
    d = windows.select(key, length, F.posexplode(vector).alias("d", "x")).groupBy(key, "d").agg((F.sum(F.col(length) * F.col("x")) / F.sum(length)).alias("x"))
    return d.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda t: t["x"]).alias(vector))


def embed_windowed(df: DataFrame, key: str, text: str, backend, *, width: int, shards: int, batch: int = 64) -> DataFrame:
    """key, windows, embedding: each window of a text is embedded by itself, and a text gets the mean of its windows weighted by their lengths.  A null or empty text has no windows and no row."""
    parts = windows(df.where(F.col(text).isNotNull()), key, text, width).withColumn("__id", F.concat_ws("#", key, "window"))
    found = embed(parts, "__id", "part", backend, shards=shards, batch=batch)
    rows = parts.select("__id", key, F.length("part").alias("__length")).join(found.select("__id", "embedding"), "__id")
    mean = weighted_windows(rows, key, "embedding", "__length")
    return mean.join(parts.groupBy(key).agg(F.count(F.lit(1)).alias("windows")), key).select(key, "windows", "embedding")


def vector_index(spark: SparkSession, path: str, key: str, vector: str, *, representation: str, revision: str) -> DataFrame:
    """key, representation, revision, shard, row, dimension, dtype: where each vector of the Parquet shards under a path is.

    ``shard`` is the file below the path and ``row`` the place in that file, as its readers count, so
    a vector is found again without its key.  Vectors aren't read, but for their lengths.
    """
    stored = spark.read.parquet(path)
    bare = path.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    shard = F.regexp_replace(F.substring_index(F.col("_metadata.file_path"), f"{bare}/", -1), "^/+", "")
    dtype = stored.schema[vector].dataType.elementType.simpleString()
    return stored.select(key, F.lit(representation).alias("representation"), F.lit(revision).alias("revision"), shard.alias("shard"), F.col("_metadata.row_index").alias("row"), F.size(vector).alias("dimension"), F.lit(dtype).alias("dtype"))


def looked_up(spark: SparkSession, path: str, index: DataFrame, key: str, vector: str) -> DataFrame:
    """key, stored_key, vector: the vectors that an index points at, by file and row."""
    bare = path.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    shard = F.regexp_replace(F.substring_index(F.col("_metadata.file_path"), f"{bare}/", -1), "^/+", "")
    stored = spark.read.parquet(path).select(shard.alias("shard"), F.col("_metadata.row_index").alias("row"), F.col(key).alias("stored_key"), vector)
    return index.select(key, "shard", "row").join(stored, ["shard", "row"]).select(key, "stored_key", vector)
