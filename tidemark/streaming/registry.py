"""Incremental form of the registry: new files of an append-only table go through the same stateless plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def append_available(spark: SparkSession, source: str, sink: str, checkpoint: str, plan: Callable[[DataFrame], DataFrame]) -> None:
    """Processes the source files not yet seen, each once, and appends the result as Parquet."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)
    query = plan(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
