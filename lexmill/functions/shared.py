"""Frames that are kept in the folder which driver and executors share, and broadcasts that are counted first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.plans.registry import shared_folder

#: Rows that few_or_all() sends to all tasks.
FEW = 500_000


def ensure_checkpoints(spark: SparkSession) -> None:
    """Spark's checkpoint folder is the one that spark.checkpoint.dir names; a folder of our own only where a local session has none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, so that lost executors don't repeat what led to them."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like cut(), as a compressed table in the shared checkpoint folder: for many rows, or rows read in part later."""
    ensure_checkpoints(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_or_all(df: DataFrame, limit: int = FEW) -> DataFrame:
    """A frame that was cut() or stored(), to be broadcast in a join if it is counted to have few rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
