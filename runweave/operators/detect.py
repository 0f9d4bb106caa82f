"""Where, and how strongly, an intervention shows in a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import EPS, finite, half_srd, srd
from .windows import run_starts


def against_baseline(runs: DataFrame, family: str) -> DataFrame:
    """Each child's rows beside those of its family's baseline, the run with the smallest id."""
    base_ids = runs.groupBy(family).agg(F.min("run_id").alias("base_id"))
    with_base = runs.join(base_ids, family)
    base = with_base.where("run_id = base_id").select(family, "pos", F.col("value").alias("base"))
    return with_base.where("run_id <> base_id").join(base, [family, "pos"]).select(family, "run_id", "pos", "value", "base")


def scan(pairs: DataFrame, keys: list[str], threshold: float, start: int, steps: int, eps: float = EPS) -> DataFrame:
    """Largest distance, first place where it is exceeded `steps` times in a row from `start` on, and Euclidean distance."""
    both = pairs.where(finite(F.col("value")) & finite(F.col("base"))).withColumn("srd", srd(F.col("value"), F.col("base"), eps))
    flagged = both.withColumn("flag", (F.col("srd") >= threshold) & (F.col("pos") >= start))
    # the window and the totals share the keys' partitioning: one shuffle
    starts = flagged.withColumn("starts_", run_starts(keys, "pos", "flag", steps))
    first = F.min(F.when(F.col("starts_"), F.col("pos"))).alias("first")
    return starts.groupBy(*keys).agg(F.max("srd").alias("max_srd"), F.sqrt(F.sum(F.pow(F.col("value") - F.col("base"), 2))).alias("euclid"), F.sqrt(F.sum(F.pow(F.col("base"), 2))).alias("norm"), first)


def decide(scanned: DataFrame, factor: float) -> DataFrame:
    """Detectable: seen at all, and further away than a multiple of the baseline's norm."""
    return scanned.withColumn("detectable", F.col("first").isNotNull() & (F.col("euclid") > factor * F.col("norm")))


def first_places(pairs: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """First place with a distance of the tolerance (-1: none), and first with any difference."""
    a, b = F.col("value"), F.col("base")
    return pairs.groupBy(*keys).agg(F.coalesce(F.min(F.when(srd(a, b) >= tolerance, F.col("pos"))), F.lit(-1)).alias("first_seen"), F.min(F.when(half_srd(a, b) > 0, F.col("pos"))).alias("first_differs"))


def normalised_before(runs: DataFrame, keys: list[str], until: int) -> DataFrame:
    """Values as z-scores by mean and spread of the places before `until`, where runs of a family are alike; a spread under 1e-6 counts as 1."""
    own = Window.partitionBy(*keys)
    early = F.when(F.col("pos") < until, F.col("value"))
    spread = F.stddev_pop(early).over(own)
    return runs.withColumn("value", (F.col("value") - F.avg(early).over(own)) / F.when(spread < 1e-6, 1.0).otherwise(spread))
