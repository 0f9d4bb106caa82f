"""Losses of candidate trajectories against a target, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import align
from ..functions.exprs import finite


def continuous(target: DataFrame, candidate: DataFrame, keys: list[str], time: str, scale: DataFrame) -> DataFrame:
    """(keys, loss): mean square of the candidate, interpolated at the target's times, less the target, as a share of the signal's scale (signal, scale). A target counts `weight` times if it has such a column, else once."""
    wanted = target.select(*keys, time, F.col("value").alias("wanted"), (F.col("weight") if "weight" in target.columns else F.lit(1)).cast("double").alias("weight"))
    at = align.at_times(candidate, wanted, keys, time, "value").join(scale, "signal")
    square = F.pow((F.col("value") - F.col("wanted")) / F.col("scale"), 2)
    weight = F.when(finite(square), F.col("weight"))
    return at.groupBy(*keys).agg(F.try_divide(F.sum(square * weight), F.sum(weight)).alias("loss"))


def trajectory(losses: DataFrame, baseline: DataFrame | None, run: str) -> DataFrame:
    """(run, loss): the sum of the signals' losses; with those of the baseline (signal, base_loss), the mean of the ratios to them, which count 1e-6 at least."""
    if baseline is None:
        return losses.groupBy(run).agg(F.sum("loss").alias("loss"))
    ratio = F.col("loss") / F.greatest(F.col("base_loss"), F.lit(1e-6))
    return losses.join(baseline, "signal").groupBy(run).agg(F.avg(ratio).alias("loss"))


def stopped(losses: DataFrame, keys: list[str], baseline: str, share: float = 0.01) -> DataFrame:
    """(keys, stop): whether no candidate's loss departs from the baseline's by more than a share of it."""
    near = F.abs(F.col("loss") - F.col(baseline)) <= share * F.abs(F.col(baseline))
    return losses.groupBy(*keys).agg(F.bool_and(F.coalesce(near, F.lit(False))).alias("stop"))


def chosen(grid: DataFrame, search: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, loss, by): the better of a coarse grid's best point and a bounded search's optimum; the grid wins ties. Both have keys, value, loss."""
    every = grid.withColumn("by", F.lit("grid")).unionByName(search.withColumn("by", F.lit("search"))).where(finite(F.col("loss")))
    return every.groupBy(*keys).agg(F.min(F.struct("loss", "by", "value")).alias("m")).select(*keys, F.col("m.value").alias("value"), F.col("m.loss").alias("loss"), F.col("m.by").alias("by"))


def best_other(losses: DataFrame, keys: list[str], candidate: str, truth: Column) -> DataFrame:
    """(keys, candidate, loss): the candidate with the least loss that isn't the true one."""
    rows = losses.where(F.col(candidate) != truth)
    return rows.groupBy(*keys).agg(F.min(F.struct("loss", candidate)).alias("m")).select(*keys, F.col(f"m.{candidate}").alias(candidate), F.col("m.loss").alias("loss"))
