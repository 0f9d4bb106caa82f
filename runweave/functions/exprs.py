"""Column expressions: no UDFs, so that all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-3


def scaled(x: Column) -> Column:
    """x in ten-thousandths, rounded half up: equal in any engine."""
    return F.floor(x * 10_000 + 0.5).cast("long")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def exact_avg(x: Column) -> Column:
    """The mean of finite values under 1e23 by the sum of their decimal digits (15 places), so that it doesn't hang on the rows' order; with others, the plain mean."""
    usable = finite(x) & (F.abs(x) < 1e22)
    total = F.sum(F.when(usable, x).cast("decimal(38,15)")).cast("double")
    return F.when(F.count_if(x.isNotNull() & ~usable) > 0, F.avg(x)).otherwise(F.try_divide(total, F.count(x)))


def srd(a: Column, b: Column, eps: float = EPS) -> Column:
    """Symmetric relative distance, 0 to 2; NULL where both are 0 and eps is 0."""
    return F.try_divide(2 * F.abs(a - b), F.abs(a) + F.abs(b) + eps)


def half_srd(a: Column, b: Column, eps: float = EPS) -> Column:
    return srd(a, b, eps) / 2


def parameter_srd(a: Column, b: Column) -> Column:
    total = F.abs(a) + F.abs(b)
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.when(total <= 0, 0.0).otherwise(F.try_divide(2 * F.abs(a - b), total)))


def ratio_to_db(r: Column) -> Column:
    """20 log10, -inf for 0, NULL for what has no level."""
    return F.when(~finite(r) | (r < 0), None).when(r == 0, float("-inf")).otherwise(20 * F.log10(r))


def db_to_multiplier(db: Column) -> Column:
    return F.pow(F.lit(10.0), -db / 20)


def relative_change(now: Column, before: Column, floor: float) -> Column:
    change = F.abs(now - before) / F.greatest(F.abs(before), F.abs(now), F.lit(floor))
    return F.when(finite(change), change).otherwise(0.0)


def odd_window(seconds: Column, dt: Column, least: int = 3, most: int = 101, fallback: int = 9) -> Column:
    """Samples that cover a duration: odd, within bounds."""
    n = F.greatest(F.lit(least), F.least(F.lit(most), F.bround(F.try_divide(seconds, dt)).cast("int")))
    return F.when(dt > 0, n + (1 - n % 2)).otherwise(fallback).cast("int")


def quantise(t: Column, step: float) -> Column:
    return F.bround(t / step) * step


def sampled_points(end: Column, rate: float) -> Column:
    return F.greatest(F.lit(0), F.floor(end * rate) - 1).cast("long")


def normal_label(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(x), r"\s+", " "))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_|_$", "")


def file_component(x: Column, default: str = "item") -> Column:
    clean = F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(clean, "_+", "_"), F.lit("")), F.lit(default))


def seed_of(slug_col: Column) -> Column:
    return F.nullif(F.regexp_extract(slug_col, r"_(\d+)$", 1), F.lit("")).cast("long")


def shortlist_score(predictions: Column, truth: Column) -> Column:
    """One over the number of distinct predictions if the truth is among them."""
    distinct = F.array_distinct(predictions)
    return F.when(F.array_contains(distinct, truth), 1.0 / F.size(distinct)).otherwise(0.0)


def chance_corrected(accuracy: Column, classes: Column) -> Column:
    return F.when(classes <= 1, accuracy).otherwise((accuracy - 1 / classes) / (1 - 1 / classes))


def earliest(times: Column) -> Column:
    """The least finite member that is not negative."""
    return F.array_min(F.filter(times, lambda x: finite(x) & (x >= 0)))


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a over code points."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(4294967295)))


def _imul(a: Column, b: Column) -> Column:
    """Low 32 bits of a product, by halves so that nothing overflows."""
    low, high = b.bitwiseAND(F.lit(65535)), F.shiftrightunsigned(b, 16)
    return ((a * low) + ((a * high).bitwiseAND(F.lit(65535)) * 65536)).bitwiseAND(F.lit(4294967295))


def mulberry32(seed: Column, draw: Column) -> Column:
    """The uniform of draw 1, 2, ...: the state after k draws is seed + k * constant, so any draw is at hand."""
    mask = F.lit(4294967295)
    t = (seed + draw.cast("long") * 1831565813).bitwiseAND(mask)
    t = _imul(t.bitwiseXOR(F.shiftrightunsigned(t, 15)), t.bitwiseOR(F.lit(1).cast("long")))
    t = t.bitwiseXOR((t + _imul(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(mask))
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)).bitwiseAND(mask) / 4294967296.0


def normal(seed: Column, k: Column) -> Column:
    """The k-th normal (from 1) of a stream: two uniforms each, cosine branch."""
    u, v = mulberry32(seed, 2 * k - 1), mulberry32(seed, 2 * k)
    return F.sqrt(-2 * F.ln(F.greatest(u, F.lit(1e-300)))) * F.cos(v * 6.283185307179586)


def label_order(labels: DataFrame, label: str, preferred: list[str], last: str | None) -> DataFrame:
    """(label, place): distinct labels by a preferred order, then by name, and one of them last. Labels are few by contract."""
    rank = F.lit(len(preferred))
    for k, name in enumerate(preferred):
        rank = F.when(F.col(label) == name, k).otherwise(rank)
    if last is not None:
        rank = F.when(F.col(label) == last, len(preferred) + 1).otherwise(rank)
    return labels.select(label, (F.row_number().over(Window.orderBy(rank, label)) - 1).cast("long").alias("place"))


def first_seen(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value, first, place): the distinct values of each key in the order in which they come first."""
    first = df.groupBy(*keys, value).agg(F.min(order).alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("first", value)))


def chronological(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """df with each row's place by time, rows without one last, ties in the order of `tie`."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(time), tie)))
