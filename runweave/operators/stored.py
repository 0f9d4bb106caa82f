"""Rows of a loop's step, kept so that the next steps don't compute them again."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to spark.checkpoint.dir, which cuts lineage and survives lost executors. Without that setting, as in a small session, they are only cached."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist(StorageLevel.MEMORY_AND_DISK)
