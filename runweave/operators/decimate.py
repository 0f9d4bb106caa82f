"""Decimation of runs to a rate: every so many samples from the first whole period on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds by which a sample may miss the first period.
EPS = 1e-12


def plan(df: DataFrame, keys: list[str], time: str, rate: float) -> DataFrame:
    """Rows from the first period on, with `pos`, `block` and `picked` (the first of its block). Runs not faster than the rate keep every row, in blocks of one; runs without two different times give none."""
    own = Window.partitionBy(*keys)
    ordered = own.orderBy(time)
    gap = F.col(time) - F.lag(time).over(ordered)
    rows = df.where(F.col(time).isNotNull() & ~F.isnan(time)).withColumn("pos", F.row_number().over(ordered) - 1).withColumn("__gap", gap)
    base = F.try_divide(F.lit(1.0), F.percentile(F.when(F.col("__gap") > 0, F.col("__gap")), 0.5).over(own))
    begin = F.count_if(F.col(time) < 1 / rate - EPS).over(own)
    rows = rows.withColumn("__base", base).withColumn("__begin", begin).where("__base IS NOT NULL")
    slow = F.lit(rate) >= F.col("__base")
    stride = F.when(slow, 1).otherwise(F.greatest(F.lit(1), F.floor(F.col("__base") / rate + 0.5)))
    place = F.col("pos") - F.when(slow, 0).otherwise(F.col("__begin"))
    placed = rows.withColumn("__place", place).withColumn("__stride", stride.cast("long")).where("__place >= 0")
    return placed.withColumn("block", F.floor(F.col("__place") / F.col("__stride"))).withColumn("picked", F.col("__place") % F.col("__stride") == 0).drop("__gap", "__base", "__begin", "__place", "__stride")


def signed_peaks(planned: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Of each block its first place and its signed value of the largest magnitude, the first of equal ones."""
    usable = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.struct((-F.abs(value)).alias("m"), F.col("pos").alias("p"), F.col(value).alias("v")))
    return planned.groupBy(*keys, "block").agg(F.min("pos").alias("pos"), F.min(usable)["v"].alias(value))
