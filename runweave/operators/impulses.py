"""Impulses: samples that jump, the events they form, thinning that keeps them, and the verdict on candidate parameters.

All of it is windows over a run and equi-joins; a run's rows meet in one partition, never on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

#: Scales the median absolute deviation to the spread of a normal. Fixed value.
NORMAL_MAD = 1.4826


def jumps(df: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """df with `jump`: how far each difference to the sample before lies from the run's median one, in robust spreads. 0 for the first, and where all differences are alike."""
    own = Window.partitionBy(*keys)
    d = F.coalesce(F.col(value) - F.lag(value).over(own.orderBy(order)), F.lit(0.0))
    off = F.abs(F.col("__d") - F.percentile("__d", 0.5).over(own))
    spread = NORMAL_MAD * F.percentile("__off", 0.5).over(own)
    found = df.withColumn("__d", d).withColumn("__off", off).withColumn("__spread", spread)
    return found.withColumn("jump", F.coalesce(F.try_divide("__off", "__spread"), F.lit(0.0))).drop("__d", "__off", "__spread")


def kept_around(df: DataFrame, keys: list[str], order: str, flag: Column, half: float) -> DataFrame:
    """df with `keep`: the first and last sample of a run, and those at most `half` from a flagged one."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = F.when(flag, F.col(order))
    before, after = F.max(marked).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.min(marked).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = F.coalesce(F.col(order) - before <= half, F.lit(False)) | F.coalesce(after - F.col(order) <= half, F.lit(False))
    ends = F.lag(order).over(w).isNull() | F.lead(order).over(w).isNull()
    return df.withColumn("keep", near | ends)


def bucket_head(rank: Column, size: Column, buckets: Column) -> Column:
    """Whether the row of this rank (from 0) begins one of `buckets` parts, as even as can be, the larger ones first, of `size` rows."""
    k = F.greatest(buckets, F.lit(1))
    short, longer = F.floor(size / k), size % k
    cut = longer * (short + 1)
    inside = F.when(rank < cut, rank % (short + 1) == 0).otherwise((rank - cut) % F.greatest(short, F.lit(1)) == 0)
    return F.when(buckets <= 0, False).when(size <= buckets, True).otherwise(inside)


def thin(df: DataFrame, keys: list[str], order: str, length: int) -> DataFrame:
    """`length` rows of each run (fewer only where it has less than half as many): those with `keep`, thinned if they are too many, and others evenly over the run. Rows of a shorter run repeat from the first on; none is made up."""
    own = Window.partitionBy(*keys)
    w = own.orderBy(order)

    def numbered(frame: DataFrame, name: str, flag: str) -> DataFrame:
        upto = F.sum(F.col(flag).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
        return frame.withColumn(f"{name}_rank", upto).withColumn(f"{name}_n", F.sum(F.col(flag).cast("long")).over(own))

    placed = numbered(df.withColumn("__all", F.lit(True)), "__all", "__all")
    placed = numbered(placed, "__keep", "keep").withColumn("__left", length - F.col("__keep_n"))
    step = F.try_divide(F.col("__all_n") - 1, F.col("__left") + 1)
    j = F.floor(F.try_divide("__all_rank", step))
    lands = [F.coalesce(F.rint((j + i) * step) == F.col("__all_rank"), F.lit(False)) & (j + i >= 1) & (j + i <= F.col("__left")) for i in (0, 1)]
    placed = placed.withColumn("__hit", ~F.col("keep") & (lands[0] | lands[1]))
    placed = numbered(placed, "__hit", "__hit").withColumn("__pool", ~F.col("keep") & ~F.col("__hit"))
    placed = numbered(placed, "__pool", "__pool")
    few = F.col("keep") | F.col("__hit") | F.col("__pool") & bucket_head(F.col("__pool_rank"), F.col("__pool_n"), F.col("__left") - F.col("__hit_n"))
    many = F.col("keep") & bucket_head(F.col("__keep_rank"), F.col("__keep_n"), F.lit(length))
    times = F.when(F.col("__all_n") <= length, F.when(F.col("__all_rank") < length - F.col("__all_n"), 2).otherwise(1)).otherwise(F.when(F.col("__left") <= 0, many).otherwise(few).cast("int"))
    chosen = placed.withColumn("__times", times).where("__times > 0").withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return chosen.select(*df.columns)


def peaks(df: DataFrame, keys: list[str], order: str, share: float, value: str = "value") -> DataFrame:
    """(keys, place, peak): the largest magnitude of each stretch of rows over a share of the run's largest. order counts up by 1."""
    own = Window.partitionBy(*keys)
    over = df.withColumn("__most", F.max(F.abs(value)).over(own)).where(F.abs(value) > share * F.col("__most"))
    island = F.col(order) - F.row_number().over(own.orderBy(order))
    best = F.min(F.struct((-F.abs(value)).alias("m"), F.col(order).alias("o"), F.col(value).alias("v"))).alias("__b")
    return over.withColumn("__island", island).groupBy(*keys, "__island").agg(best).select(*keys, F.col("__b.o").alias("place"), F.col("__b.v").alias("peak"))


def rebounds(found: DataFrame, rows: DataFrame, keys: list[str], order: str, value: str, reach: int) -> DataFrame:
    """The peaks about which another signal turns: its median is negative over the `reach` places up to the peak, and positive from it on. Each peak looks at 2 reach + 1 places, by an equi-join."""
    at = found.withColumn("__k", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("__at", F.col("place") + F.col("__k"))
    near = at.join(rows.select(*keys, F.col(order).alias("__at"), F.col(value).alias("__v")), [*keys, "__at"])
    median = lambda side: F.percentile(F.when(side, F.col("__v")), F.lit(0.5))
    turns = near.groupBy(*keys, "place", "peak").agg(median(F.col("__k") <= 0).alias("__a"), median(F.col("__k") >= 0).alias("__b"))
    return turns.where("__a < 0 AND __b > 0").drop("__a", "__b")


def verdicts(candidates: DataFrame, child: str, least_gain: float, least_gap: float, eps: float = 1e-12) -> DataFrame:
    """Of each child, from (child, parameter, loss, truth, baseline): best parameter, place of the true one, gain over the baseline's loss, gap to the next best, and whether the truth is found clearly. Candidates without a finite loss don't count."""
    finite = candidates.where(X.finite(F.col("loss")))
    k = F.row_number().over(Window.partitionBy(child).orderBy("loss", "parameter"))
    at = lambda c, n: F.max(F.when(F.col("__k") == n, F.col(c)))
    found = finite.withColumn("__k", k).groupBy(child).agg(at("parameter", 1).alias("best"), at("loss", 1).alias("__best"), at("loss", 2).alias("__next"), F.min(F.when(F.col("parameter") == F.col("truth"), F.col("__k"))).alias("rank"), F.max("truth").alias("__truth"), F.max("baseline").alias("__base"))
    gain = F.when(F.col("__base") > eps, (F.col("__base") - F.col("__best")) / F.greatest("__base", F.lit(eps))).otherwise(0.0)
    gap = (F.col("__next") - F.col("__best")) / F.greatest(F.abs("__next"), F.lit(eps))
    clear = (F.col("best") == F.col("__truth")) & (F.col("gain") >= least_gain) & (F.col("gap") >= least_gap)
    return found.withColumn("gain", gain).withColumn("gap", gap).select(child, "best", F.col("rank").cast("long").alias("rank"), "gain", "gap", F.coalesce(clear, F.lit(False)).alias("is_match"))
