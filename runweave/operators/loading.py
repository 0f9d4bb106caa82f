"""Runs as they come: their time and signal columns, coercion, checks, and how they reach a regular grid."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import finite
from . import align

#: Columns that are never signals. Fixed values.
NOT_SIGNALS = ("time", "timestamp", "index", "idx")


def signal_columns(columns: list[str], signal_types: dict[str, str] | None = None) -> list[str]:
    """The signals among the columns: with a type for each of k signals the first k columns, else all but time and index columns."""
    if signal_types:
        return columns[: len(signal_types)]
    return [c for c in columns if c.lower() not in NOT_SIGNALS]


def time_column(columns: list[str], n_signals: int | None = None) -> str | None:
    """The first of time and timestamp that there is; else the last column, if it alone is left beside the signals."""
    found = next((c for name in ("time", "timestamp") for c in columns if c.lower() == name), None)
    return found or (columns[-1] if n_signals is not None and len(columns) == n_signals + 1 else None)


def anonymise(df: DataFrame) -> DataFrame:
    """Columns renamed to col1, col2, ... in their order, time included."""
    return df.toDF(*(f"col{k}" for k in range(1, len(df.columns) + 1)))


def flat_names(names: list[str | tuple]) -> list[str]:
    """Headers of one level: the parts of a tuple (or of its text) joined by " - ", names that begin with time become time, repeats get (2), (3), ..."""
    out: list[str] = []
    for name in names:
        if isinstance(name, str) and re.fullmatch(r"\(.*,.*\)", name.strip()):
            name = tuple(name.strip()[1:-1].split(","))
        parts = [str(p).strip().strip("'\"") for p in name] if isinstance(name, tuple) else [str(name).strip()]
        flat = " - ".join(p for p in parts if p)
        flat = "time" if flat.lower().startswith("time") else flat
        n = sum(o == flat or re.fullmatch(re.escape(flat) + r" \(\d+\)", o) is not None for o in out)
        out.append(f"{flat} ({n + 1})" if n else flat)
    return out


def time_first(df: DataFrame) -> DataFrame:
    """df with flat column names, time before all others."""
    flat = df.toDF(*flat_names(df.columns))
    return flat.select(*sorted(flat.columns, key=lambda c: c != "time")) if "time" in flat.columns else flat


def number(column: str) -> Column:
    """The column as a double; NULL where it is no number."""
    return F.col(column).try_cast("double")


def numeric_runs(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The runs whose every time is a finite number, with time as a double; a run with any other is left out whole."""
    own = Window.partitionBy(*keys)
    checked = df.withColumn(time, number(time))
    return checked.withColumn("bad_", F.count_if(~F.coalesce(finite(F.col(time)), F.lit(False))).over(own)).where("bad_ = 0").drop("bad_")


def coerced_runs(df: DataFrame, time: str, values: list[str]) -> DataFrame:
    """Strict reading: time and values as numbers, rows without one of them left out, values as FLOAT."""
    rows = df.withColumns({time: number(time), **{v: number(v) for v in values}}).dropna(subset=[time, *values])
    return rows.withColumns({v: F.col(v).cast("float") for v in values})


def validated_frames(df: DataFrame, keys: list[str], time: str, signals: list[str], tie: list[str], least: int = 12) -> DataFrame:
    """Frames of time and the required signals: numbers only, one row for each time (the first by `tie`), at least `least` rows; other runs are left out."""
    missing = [c for c in (time, *signals) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    rows = df.select(*keys, *tie, number(time).alias(time), *(number(s).alias(s) for s in signals)).where(F.forall(F.array(time, *signals), lambda x: F.coalesce(finite(x), F.lit(False))))
    first = rows.withColumn("k_", F.row_number().over(Window.partitionBy(*keys, time).orderBy(*tie))).where("k_ = 1").drop("k_", *[t for t in tie if t not in keys])
    return first.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("rows") >= least)


def from_time(df: DataFrame, keys: list[str], time: str, start: Column) -> DataFrame:
    """The rows of each run from a time on; all rows of a run that has none there."""
    later = F.col(time) >= start
    return df.withColumn("later_", F.count_if(later).over(Window.partitionBy(*keys))).where(later | (F.col("later_") == 0)).drop("later_")


def regular_sampling(df: DataFrame, keys: list[str], time: str, rate: float) -> DataFrame:
    """(keys, rows, step, increasing, even, at_rate, regular): whether a run's times increase by equal steps of 1 / rate. Steps may depart by max(1e-9, 1e-6 of the step)."""
    gap = F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy("pos" if "pos" in df.columns else time))
    steps = df.withColumn("gap", gap)
    medians = steps.groupBy(*keys).agg(F.percentile("gap", 0.5).alias("step"), F.count(F.lit(1)).alias("rows"))
    near = F.greatest(F.lit(1e-9), 1e-6 * F.abs("step"))
    each = steps.where("gap IS NOT NULL").join(medians, keys).groupBy(*keys, "rows", "step").agg(F.bool_and(F.col("gap") > 0).alias("increasing"), F.bool_and(F.abs(F.col("gap") - F.col("step")) <= near).alias("even"))
    at_rate = F.abs(F.col("step") - 1 / rate) <= near
    return each.withColumn("at_rate", at_rate).withColumn("regular", F.col("increasing") & F.col("even") & at_rate)


def grid_faults(df: DataFrame, keys: list[str], time: str, values: list[str], step: float, least: int = 50) -> DataFrame:
    """(keys, rows, faults): what is wrong with a resampled run, of few_rows, not_finite, wrong_start, uneven; no faults if it is good."""
    own = Window.partitionBy(*keys).orderBy(time)
    near = max(1e-9, 1e-6 * step)
    rows = df.withColumn("gap_", F.col(time) - F.lag(time).over(own))
    bad = ~F.forall(F.array(time, *values), lambda x: F.coalesce(finite(x.cast("double")), F.lit(False)))
    faults = {
        "few_rows": F.count(F.lit(1)) < least,
        "not_finite": F.count_if(bad) > 0,
        "wrong_start": F.abs(F.min(time) - step) > near,
        "uneven": F.count_if(F.abs(F.col("gap_") - step) > near) > 0,
    }
    named = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in faults.items())), lambda x: x.isNotNull())
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), named.alias("faults"))


#: How empty bins of a grid are filled, and how a bin's value comes about. Fixed values.
FILLINGS, BINNINGS = ("validate_only", "interpolation", "zero_filling"), ("decimation", "abs_max_pooling")
#: Most signals of a model that have strategies; each worker holds them.
MOST_SIGNALS = 10_000


def resample(df: DataFrame, strategies: DataFrame, step: int, time: str = "t", value: str = "value") -> DataFrame:
    """(run_id, signal, bin, value) on the grid: each signal by its own strategy.

    strategies: (signal, binning, filling), one row for each signal. Bins without a sample are interpolated between
    samples (held at the ends), 0, or stay NULL (validate_only). Signals without a strategy are left out; more than
    MOST_SIGNALS with one are an error.
    """
    keys = align.KEYS
    if strategies.limit(MOST_SIGNALS + 1).count() > MOST_SIGNALS:
        raise ValueError(f"at most {MOST_SIGNALS} signals have strategies")
    strategies = F.broadcast(strategies)  # few signals: a join by shuffling would put all rows of one into one task
    own = df.join(strategies, "signal").where(F.col("binning").isin(*BINNINGS) & F.col("filling").isin(*FILLINGS))
    binned = [f(own.where(F.col("binning") == b), keys, time, value, step) for f, b in ((align.resample_last, "decimation"), (align.resample_largest, "abs_max_pooling"))]
    between = align.interpolate(own.where(F.col("filling") == "interpolation"), keys, time, value, step).withColumnRenamed(value, "between")
    rows = binned[0].unionByName(binned[1]).join(F.broadcast(strategies.select("signal", "filling")), "signal").join(between, [*keys, "bin"], "left")
    filled = F.coalesce(value, F.when(F.col("filling") == "zero_filling", 0.0).when(F.col("filling") == "interpolation", F.col("between")))
    return rows.select(*keys, "bin", filled.alias(value))


def fixed_length(df: DataFrame, keys: list[str], pos: str, value: str, length: int) -> DataFrame:
    """(keys, k, value): each run at `length` even places from its first row to its last, interpolated; a run of one row is held."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(pos, value)))[value].alias("own"))
    at = F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("k")
    rows = rows.select(*keys, "own", at).withColumn("x", F.col("k") * (F.size("own") - 1) / max(1, length - 1))
    low = F.floor("x").cast("int")
    before, after = F.get("own", low), F.get("own", F.least(low + 1, F.size("own") - 1))
    return rows.select(*keys, "k", (before + (after - before) * (F.col("x") - low)).alias(value))


def prepared(df: DataFrame, keys: list[str], pos: str, value: str, factor: int, length: int, standard: bool = True) -> DataFrame:
    """(keys, k, value): gaps become the mean of the run (a run without numbers is an error), then block means, a fixed length and z-scores."""
    mean = F.avg(F.when(finite(F.col(value)), F.col(value))).over(Window.partitionBy(*keys))
    whole = F.when(mean.isNull(), F.raise_error(F.lit("a run has no number")).cast("double")).otherwise(F.when(finite(F.col(value)), F.col(value)).otherwise(mean))
    blocks = align.block_mean(df.withColumn(value, whole), keys, pos, value, factor, keep_short=True)
    out = fixed_length(blocks, keys, "block", value, length)
    return align.standardise(out, keys, value).drop(value).withColumnRenamed("z", value) if standard else out


def strided(df: DataFrame, keys: list[str], pos: str, most: int) -> DataFrame:
    """Every ceil(n / most)-th row of each run, from the first on."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(pos)) - 1
    return df.withColumn("n_", n).withColumn("place_", place).where(F.col("place_") % F.ceil(F.col("n_") / most) == 0).drop("n_", "place_")


def aligned_runs(a: DataFrame, b: DataFrame, keys: list[str], time: str, near: float = 0.0) -> DataFrame:
    """(keys, rows_a, rows_b, aligned): whether both have as many rows, and the k-th times of both are equal (but for `near`)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(time)).alias("place")
    a, b = (x.select(*keys, place, F.col(time).alias(n)) for x, n in ((a, "a_"), (b, "b_")))
    both = a.join(b, [*keys, "place"], "full_outer").groupBy(*keys)
    equal = F.bool_and(F.coalesce(F.abs(F.col("a_") - F.col("b_")) <= near, F.lit(False)))
    return both.agg(F.count("a_").alias("rows_a"), F.count("b_").alias("rows_b"), equal.alias("aligned"))


def overlap(a: DataFrame, b: DataFrame, keys: list[str], time: str, digits: int = 9) -> DataFrame:
    """(keys, time, a, b): rows of both at times that are equal when rounded; the first of each rounded time counts."""
    def first(x: DataFrame, name: str) -> DataFrame:
        return x.groupBy(*keys, F.round(time, digits).alias("at")).agg(F.min(F.struct(time, "value"))["value"].alias(name))

    return first(a, "a").join(first(b, "b"), [*keys, "at"])


def around(df: DataFrame, keys: list[str], time: str, at: Column, before: int = 10, after: int = 30) -> DataFrame:
    """The rows from `before` rows before the one nearest to a time to `after` rows after it, clipped to the run; `offset` counts from it."""
    own = Window.partitionBy(*keys)
    placed = df.withColumn("place_", F.row_number().over(own.orderBy(time)))
    nearest = F.min(F.struct(F.abs(F.col(time) - at), F.col("place_").alias("p"))).over(own)["p"]
    return placed.withColumn("offset", F.col("place_") - nearest).where(F.col("offset").between(-before, after)).drop("place_")


def quantified(df: DataFrame, keys: list[str], time: str, at: Column, before: int = 10, after: int = 30) -> DataFrame:
    """(keys, global_db, local_db): level of `dirty - clean` to `clean` of the whole run, and around a time. NULL if a level is 0 or missing."""
    noise, signal = (F.sqrt(F.avg(F.when(finite(F.col("clean")) & finite(F.col("dirty")), F.pow(x, 2)))) for x in (F.col("dirty") - F.col("clean"), F.col("clean")))
    db = 20 * F.log10(F.when((signal > 0) & (noise > 0), noise / signal))
    whole = df.groupBy(*keys).agg(db.alias("global_db"))
    return whole.join(around(df, keys, time, at, before, after).groupBy(*keys).agg(db.alias("local_db")), keys, "left")


def abs_correlation(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """(keys, r): absolute correlation of columns a and b from the first row on where one isn't 0; NULL without such a row or with a missing value, 1 if both are flat, 0 if one is."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("seen_", F.max(((F.col("a") != 0) | (F.col("b") != 0)).cast("int")).over(w)).where("seen_ = 1")
    n, sums = F.count(F.lit(1)), {x: F.sum(F.expr(x)) for x in ("a", "b", "a * b", "a * a", "b * b")}
    ab = sums["a * b"] - sums["a"] * sums["b"] / n
    aa, bb = (F.var_pop(x) * n for x in "ab")
    flat_a, flat_b = (F.max(x) == F.min(x) for x in "ab")
    whole = F.bool_and(F.coalesce(finite(F.col("a")) & finite(F.col("b")), F.lit(False)))
    r = F.when(~whole, None).when(flat_a & flat_b, 1.0).when(flat_a | flat_b, 0.0).otherwise(F.least(F.lit(1.0), F.abs(F.try_divide(ab, F.sqrt(aa * bb)))))
    return df.select(*keys).distinct().join(rows.groupBy(*keys).agg(r.alias("r")), keys, "left")


def against_two(runs: DataFrame, family: list[str], run: str, own_time: DataFrame, thresholds: DataFrame, start: Column) -> DataFrame:
    """(family, run, vs_baseline, vs_time0): whether a run is told from its baseline, and from the baseline whose change came at time 0.

    runs: family, run, kind ('baseline', 'child', 'time0'), signal, t, value. own_time: (run, child): the child of each time0 run.
    thresholds: (signal, least): the root mean square of differences over which a signal tells runs apart. A child
    without rows in common with the reference, or with other times, has 'error'.
    """
    child = runs.where("kind = 'child'").select(*family, F.col(run).alias("child"), "signal", "t", F.col("value").alias("own"))
    base = runs.where("kind = 'baseline'").select(*family, "signal", "t", F.col("value").alias("ref"), F.lit("vs_baseline").alias("against"))
    zero = runs.where("kind = 'time0'").join(own_time, run).select(*family, "child", "signal", "t", F.col("value").alias("ref"), F.lit("vs_time0").alias("against"))
    every = child.select(*family, "child").distinct()
    base = base.join(every, family)
    wanted = every.select(*family, "child", F.explode(F.array(F.lit("vs_baseline"), F.lit("vs_time0"))).alias("against"))
    refs = base.unionByName(zero)
    both = child.join(every, [*family, "child"]).withColumn("against", F.explode(F.array(F.lit("vs_baseline"), F.lit("vs_time0")))).join(refs, [*family, "child", "signal", "t", "against"], "full_outer")
    square = F.when((F.col("t") >= start), F.pow(F.col("own") - F.col("ref"), 2))
    apart = both.groupBy(*family, "child", "against", "signal").agg(F.sqrt(F.avg(square)).alias("rms"), F.bool_and(F.col("own").isNotNull() & F.col("ref").isNotNull()).alias("aligned"))
    told = apart.join(thresholds, "signal").groupBy(*family, "child", "against").agg(F.when(~F.bool_and("aligned"), "error").when(F.bool_or(F.col("rms") > F.col("least")), "yes").otherwise("no").alias("told"))
    out = wanted.join(told, [*family, "child", "against"], "left").groupBy(*family, "child")
    return out.agg(*(F.coalesce(F.max(F.when(F.col("against") == a, F.col("told"))), F.lit("error")).alias(a) for a in ("vs_baseline", "vs_time0")))


#: Similarity from which a run lies over its reference, and the Euclidean distance up to which it does. Fixed values.
OVERLAY_LEAST, OVERLAY_NEAR = 0.99, 0.01


def overlays(pearson: Column, cosine: Column, euclid: Column) -> Column:
    """Whether a run lies over its reference by all its signals: least correlation and cosine, or mean distance; operands that aren't finite don't count."""
    alike = finite(pearson) & finite(cosine) & (pearson >= OVERLAY_LEAST) & (cosine >= OVERLAY_LEAST)
    return F.coalesce(alike, F.lit(False)) | F.coalesce(finite(euclid) & (euclid <= OVERLAY_NEAR), F.lit(False))


def skip_reason(vs_baseline: Column, vs_time0: Column) -> Column:
    """Why a child isn't used: NULL if it is told from both references."""
    no_base, no_zero = (~F.coalesce(x == "yes", F.lit(False)) for x in (vs_baseline, vs_time0))
    return F.when(no_base & no_zero, "not told from baseline and time0").when(no_base, "not told from baseline").when(no_zero, "not told from time0")
