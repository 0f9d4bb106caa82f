"""Alignment and resampling. Bands and as-of lookups become bin numbers, so every join is an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["run_id", "signal"]
#: Rows of a table that a shuffle deals into one part where its keys compress well, so that bytes say little of them.
PART_ROWS = 500_000


def parts(*tables: DataFrame) -> int:
    """Parts for a shuffle of the tables, of PART_ROWS rows or so and one for each core at least. Counts the rows."""
    rows = sum(t.count() for t in tables)
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS))


def collapse_by_time(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    return df.groupBy(*keys, time).agg(F.avg(value).alias(value))


def grid(df: DataFrame, keys: list[str], time: str, step: int) -> DataFrame:
    """Regular targets step, 2 step, ... that end before the last sample; none for shorter runs."""
    ends = df.groupBy(*keys).agg((F.floor(F.max(time) / step) - 1).alias("n")).where("n >= 1")
    return ends.select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("bin"))


def binned(df: DataFrame, time: str, step: int) -> DataFrame:
    """The bin (T - step, T] of each sample; the first bin takes all before it."""
    return df.withColumn("bin", F.greatest(F.lit(1), F.ceil(F.col(time) / step)).cast("long"))


def resample_last(df: DataFrame, keys: list[str], time: str, value: str, step: int) -> DataFrame:
    """The last sample of each bin of the grid, NULL where it is empty: a backward as-of join within a step."""
    last = binned(df, time, step).groupBy(*keys, "bin").agg(F.max(F.struct(time, value))[value].alias(value))
    return grid(df, keys, time, step).join(last, [*keys, "bin"], "left")


def resample_largest(df: DataFrame, keys: list[str], time: str, value: str, step: int) -> DataFrame:
    """The signed value of the largest magnitude of each bin, the first of equal ones."""
    best = binned(df, time, step).groupBy(*keys, "bin").agg(F.min(F.struct((-F.abs(value)).alias("m"), F.col(time).alias("t"), F.col(value).alias("v")))["v"].alias(value))
    return grid(df, keys, time, step).join(best, [*keys, "bin"], "left")


def interpolate(df: DataFrame, keys: list[str], time: str, value: str, step: int) -> DataFrame:
    """Linear interpolation on the grid, held at the edges."""
    targets = grid(df, keys, time, step).select(*keys, (F.col("bin") * step).alias(time), "bin")
    return at_times(df, targets, keys, time, value).select(*keys, "bin", value)


def at_times(df: DataFrame, targets: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """targets (keys, time, ...) with the value of df at their times, interpolated and held at the edges: one window over targets and samples together."""
    more = [c for c in targets.columns if c not in (*keys, time)]
    wanted = targets.select(*keys, time, F.lit(None).cast("double").alias(value), F.struct(F.lit(1).alias("one_"), *more).alias("target_"))
    every = collapse_by_time(df, keys, time, value).withColumn("target_", F.lit(None).cast(wanted.schema["target_"].dataType)).unionByName(wanted)
    point = F.when(F.col("target_").isNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    w = Window.partitionBy(*keys).orderBy(time, F.col("target_").isNotNull())
    before = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(point, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc(time), F.col("target_").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    around = every.select(*keys, "target_", F.col(time).alias("at_"), before.alias("b_"), after.alias("a_")).where("target_ IS NOT NULL")
    blend = F.col("b_.v") + (F.col("a_.v") - F.col("b_.v")) * (F.col("at_") - F.col("b_.t")) / F.nullif(F.col("a_.t") - F.col("b_.t"), F.lit(0))
    return around.select(*keys, F.col("at_").alias(time), *(F.col(f"target_.{c}").alias(c) for c in more), F.coalesce(blend, F.col("b_.v"), F.col("a_.v")).alias(value))


def align_exact(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of equal keys, and whether a whole run has a partner for each of its rows."""
    return a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), keys, "full_outer").withColumn("both", F.col("in_a").isNotNull() & F.col("in_b").isNotNull())


def nearest(df: DataFrame, keys: list[str], time: str, at: int) -> DataFrame:
    """The row nearest to a time, the first of equal ones."""
    return df.groupBy(*keys).agg(F.min(F.struct(F.abs(F.col(time) - at).alias("gap"), F.col(time).alias("t"), F.col("value").alias("v"))).alias("n")).select(*keys, F.col("n.t").alias("t"), F.col("n.gap").alias("gap"), F.col("n.v").alias("value"))


def block_mean(df: DataFrame, keys: list[str], pos: str, value: str, factor: int, keep_short: bool = False) -> DataFrame:
    """Means of whole blocks of `factor` rows. keep_short: a run shorter than a block keeps its first row."""
    blocks = df.groupBy(*keys, F.floor(F.col(pos) / factor).alias("block")).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n"), F.min(F.struct(pos, value))[value].alias("first_"))
    if not keep_short:
        return blocks.where(F.col("n") == factor).drop("n", "first_")
    short = (F.col("block") == 0) & (F.col("n") < factor)
    return blocks.where((F.col("n") == factor) | short).withColumn(value, F.when(short, F.col("first_")).otherwise(F.col(value))).drop("n", "first_")


def standardise(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """z-scores; a spread under 1e-6 counts as 1."""
    w = Window.partitionBy(*keys)
    spread = F.stddev_pop(value).over(w)
    return df.withColumn("z", (F.col(value) - F.avg(value).over(w)) / F.when(spread < 1e-6, 1.0).otherwise(spread))
