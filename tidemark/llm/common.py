"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.shared import reliable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that spark.checkpoint.dir names."""
    return reliable(df)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Some rows of the batches at a time, so that few of their long texts are Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """mapInPandas over slices of the batches."""

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(x.to_pandas() for x in slices(batches)):
            if len(out):
                yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return df.mapInArrow(through, schema)


def over_texts(run: Callable[..., list], kind: str, arrow: pa.DataType):
    """An Arrow UDF of one result for each row: ``run`` gets lists of the values of some rows at a time."""

    @F.arrow_udf(kind)
    def through(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            parts = [pa.array(run(*(c.slice(start, 500).to_pylist() for c in columns)), arrow) for start in range(0, len(columns[0]), 500)]
            yield pa.concat_arrays(parts) if parts else pa.array([], arrow)

    return through


def keyed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the key columns __id and __th of a document row: its id (null as the largest long) and its text's hash.

    Repeated rows share a key and so a decision; rows of one id with other texts have keys of their own.
    """
    return df.withColumns({"__id": F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)), "__th": F.xxhash64(F.col(text_col))})


def apart(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later lambdas read again and again.

    A Generate over one row stands between, so the optimizer cannot paste their expressions into the lambdas.
    """
    tmp = "__apart"
    one = df.withColumn(tmp, F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))
    return one.select(*(df[c] for c in df.columns if c not in columns), f"{tmp}.*")
