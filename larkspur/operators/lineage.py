"""Cutting lineage through the folder that driver and executors share; joins of derived tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="larkspur-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint: computed once, with a short plan."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def joined(left: DataFrame, right: DataFrame, on: str | Column | list[str] | list[Column], how: str = "inner") -> DataFrame:
    """A join by shuffle and merge, never a broadcast: Spark takes the size of a derived table from its
    input's compressed files, before words are exploded, and would send millions of rows to the driver."""
    return left.join(right.hint("merge"), on, how)
