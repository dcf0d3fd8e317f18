"""Sinks: Parquet, delimited and JSON tables, sequences in subsets, resumable vector shards."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vectors import all_finite


def parquet(df: DataFrame, path: str, rows_per_file: int = 500_000) -> DataFrame:
    """Writes zstd Parquet to a new path (an existing one raises); returns rows and bytes of each part."""
    from tidemark.sources.scans import part_rows

    df.write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return part_rows(df.sparkSession, path)


def published(df: DataFrame, staging: str, path: str, valid: Column) -> None:
    """Writes to a staging path, checks every row there, then renames that to its path, which must not exist."""
    spark = df.sparkSession
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    source, target = paths(staging), paths(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(f"{path} exists")
    df.write.mode("errorifexists").parquet(staging)
    if bad := spark.read.parquet(staging).where(~F.coalesce(valid, F.lit(False))).count():
        raise ValueError(f"{bad} rows of {staging} break the contract")
    if target.getParent() is not None:
        fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"{staging} can't be renamed to {path}")


def tsv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").options(sep="\t", header=True).csv(path)


def jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, keys in name order."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").json(path)


def fasta_subsets(records: DataFrame, members: DataFrame, path: str) -> DataFrame:
    """Records (id, seq) to the subsets that members (id, subset) name; a record may be in several.  Returns subset, records; a member without a record is an error."""
    rows = records.join(members, "id").select("subset", F.concat(F.lit(">"), "id", F.lit("\n"), "seq").alias("value"))
    rows.write.mode("errorifexists").partitionBy("subset").text(path)
    written = records.sparkSession.read.option("lineSep", "\n>").text(path).groupBy("subset").agg(F.count(F.lit(1)).alias("records"))
    named = members.distinct().groupBy("subset").agg(F.count(F.lit(1)).alias("named"))
    differ = named.withColumn("subset", F.col("subset").cast("string")).join(written.withColumn("subset", F.col("subset").cast("string")), "subset", "left").where(~F.col("named").eqNullSafe(F.col("records")))
    if (bad := differ.first()) is not None:
        raise ValueError(f"subset {bad['subset']} names {bad['named']} records and has {bad['records']}")
    return written


def vector_shards(vectors: DataFrame, path: str, shard: str = "shard", key: str = "id", vector: str = "embedding") -> int:
    """Appends the vectors whose key isn't there yet and whose numbers are finite; returns how many.

    Beside the shards, at ``path`` + "_ledger", each shard that was written gets a row: rows, width,
    checksum of keys and vectors, excluded (rows without a finite vector), status DONE.
    """
    spark = vectors.sparkSession
    try:
        there = spark.read.parquet(path).select(key)
    except AnalysisException as e:  # the first write
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = vectors.select(key).limit(0)
    sound = F.coalesce(all_finite(F.col(vector)), F.lit(False))
    new = vectors.join(there, key, "left_anti").withColumn("__sound", sound).persist()
    try:
        counts = new.groupBy(shard).agg(F.count_if("__sound").alias("n"), F.count_if(~F.col("__sound")).alias("excluded"))
        left_out = {r[shard]: r["excluded"] for r in counts.collect()}
        n = sum(r["n"] for r in counts.collect())
        if n:
            new.where("__sound").drop("__sound").write.mode("append").partitionBy(shard).parquet(path)
    finally:
        new.unpersist()
    if left_out:
        excluded = spark.createDataFrame(list(left_out.items()), f"{shard} {vectors.schema[shard].dataType.simpleString()}, excluded long")
        ledger = shard_ledger(spark.read.parquet(path), shard, key, vector).join(excluded, shard).withColumn("status", F.lit("DONE")) if n else excluded
        ledger.write.mode("append").option("mergeSchema", True).parquet(f"{path}_ledger")
    return n


def shard_ledger(stored: DataFrame, shard: str, key: str, vector: str) -> DataFrame:
    """By shard: rows, width, and a checksum of keys and vectors that doesn't depend on their order."""
    checksum = F.sum(F.xxhash64(key, vector).cast("decimal(38,0)")).cast("string")
    return stored.groupBy(shard).agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(vector)).alias("width"), checksum.alias("checksum"))
