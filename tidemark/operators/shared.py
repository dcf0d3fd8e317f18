"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task of a dealt table takes.
ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Only a local master gets a folder of its own where it is unset; elsewhere that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def reliable(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def filled(df: DataFrame) -> int:
    """Tasks that a table's rows fill; dealt out in so many, a task's memory doesn't grow with the table."""
    return 1 + df.count() // ROWS
