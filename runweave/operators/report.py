"""Scores, consolidation over seeds and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_table(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"), F.count(value).alias("n"))


def gain(df: DataFrame, keys: list[str], by: str, base: str, target: str, value: str) -> DataFrame:
    """Mean at the target less mean at the base, where both exist."""
    both = df.groupBy(*keys).agg(F.avg(F.when(F.col(by) == base, F.col(value))).alias("base"), F.avg(F.when(F.col(by) == target, F.col(value))).alias("target"))
    return both.dropna(subset=["base", "target"]).withColumn("gain", F.col("target") - F.col("base"))


def complete_families(df: DataFrame, keys: list[str], member: str, expected: list) -> DataFrame:
    """Families that have every expected member."""
    have = df.groupBy(*keys).agg(F.collect_set(member).alias("have"), F.count(F.lit(1)).alias("rows"))
    return have.withColumn("missing", F.size(F.array_except(F.array(*(F.lit(x) for x in expected)), "have"))).drop("have")


def best_by(df: DataFrame, keys: list[str], name: str, score: str) -> DataFrame:
    """The name with the highest score, the smallest of equal ones."""
    return df.groupBy(*keys).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(name).alias("name"))).alias("b")).select(*keys, F.col("b.name").alias("best"), (-F.col("b.s")).alias("score"))
