"""Operators over the ordered rows of a run; all share the run's partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.exprs import finite


def centred(keys: list[str], order: str, size: int) -> WindowSpec:
    half = (size + 1 - size % 2) // 2
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)


def rolling_rms(value: str, w: WindowSpec) -> Column:
    """Of the finite samples of the window; 0 without any."""
    return F.coalesce(F.sqrt(F.avg(F.when(finite(F.col(value)), F.pow(F.col(value), 2))).over(w)), F.lit(0.0))


def rolling_median(value: str, w: WindowSpec) -> Column:
    return F.percentile(value, 0.5).over(w)


def median_gap(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    gap = F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(time))
    return df.withColumn("gap", gap).where("gap > 0").groupBy(*keys).agg(F.percentile("gap", 0.5).alias("median_gap"), F.count(F.lit(1)).alias("gaps"))


def run_starts(keys: list[str], order: str, flag: str, length: int) -> Column:
    """Whether `length` flags in a row begin here."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, length - 1)
    return (F.sum(F.col(flag).cast("int")).over(w) == length) & (F.count(F.lit(1)).over(w) == length)


def first_run_of(df: DataFrame, keys: list[str], order: str, flag: str, length: int) -> DataFrame:
    """Where `length` flags in a row begin first."""
    return df.withColumn("starts", run_starts(keys, order, flag, length)).groupBy(*keys).agg(F.min(F.when(F.col("starts"), F.col(order))).alias("first"))


def islands(df: DataFrame, keys: list[str], order: str, flag: str, value: str) -> DataFrame:
    """Stretches of flagged rows (order counts up by 1): first, last, and the value of the largest magnitude."""
    some = df.where(flag)
    group = F.col(order) - F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    peak = F.min(F.struct((-F.abs(value)).alias("m"), F.col(order).alias("o"), F.col(value).alias("v")))["v"]
    return some.withColumn("island", group).groupBy(*keys, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), peak.alias("peak"))


def sessions(df: DataFrame, keys: list[str], time: str, value: str, gap: int) -> DataFrame:
    """Events chained while gaps are at most `gap`, each chain with its largest magnitude."""
    w = Window.partitionBy(*keys).orderBy(time)
    new = F.coalesce((F.col(time) - F.lag(time).over(w) > gap).cast("int"), F.lit(0))
    chained = df.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    peak = F.min(F.struct((-F.abs(value)).alias("m"), F.col(time).alias("t"), F.col(value).alias("v")))["v"]
    return chained.groupBy(*keys, "session").agg(F.min(time).alias("begin"), F.max(time).alias("end"), F.count(F.lit(1)).alias("events"), peak.alias("peak"))


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank from the largest, ties sharing the mean of their places."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(value))) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2.0


def newest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """All rows of the newest configuration of each key."""
    return df.withColumn("age", F.dense_rank().over(Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order)))).where("age = 1").drop("age")


def change_points(df: DataFrame, keys: list[str], order: str, value: str, tolerance: float = 1e-12) -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("before", before).where(F.col("before").isNull() | (F.abs(F.col(value) - F.col("before")) > tolerance)).drop("before")
