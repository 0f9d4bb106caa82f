"""Samples and manifests: seeded by hashes, so that any row's draw follows from its key and nothing depends on partitions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contracts import list_hash
from .stored import cut


def seeded(seed: Column, *parts: Column) -> Column:
    """A hash to order by, of a seed and the parts of a key."""
    return F.md5(F.concat_ws("::", seed.cast("string"), *(p.cast("string") for p in parts)))


def shuffled(df: DataFrame, keys: list[str], value: str, seed: Column) -> DataFrame:
    """df with the place of each row of a key in a seeded order."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(seeded(seed, F.col(value)), value)) - 1)


def balanced_counts(labels: DataFrame, label: str, total: Column) -> DataFrame:
    """(label, n): a total over few labels, evenly, the rest to the first ones by name."""
    k, place = F.count(F.lit(1)).over(Window.partitionBy()), F.row_number().over(Window.orderBy(label)) - 1
    return labels.select(label).distinct().withColumn("k_", k).withColumn("p_", place).select(label, (F.floor(total / F.col("k_")) + (F.col("p_") < total % F.col("k_")).cast("int")).alias("n"))


def stratified(candidates: DataFrame, keys: list[str], label: str, value: str, seed: str, per_label: int, used: DataFrame | None = None) -> DataFrame:
    """`per_label` values of each label for each key, in a seeded order, without the used ones (columns of candidates)."""
    rows = candidates if used is None else candidates.join(used, used.columns, "left_anti")
    return first_seeded(rows, [*keys, label], value, F.col(seed), per_label)


#: Groups of draws up to which their bounds are broadcast.
FEW_GROUPS = 200_000


def near_front(rows: DataFrame, keys: list[str], value: str, seed: Column, n: int) -> DataFrame:
    """rows with their hashes (h_), without most of those that can't be among the first n of their key in a seeded order.

    Hashes are texts of hexadecimal digits, so those with more zeros in front come first. Counts of rows by zeros say how
    many zeros the first n have at least; only rows with as many are left, some 16 n of a key, whatever its size.
    """
    hashed = rows.withColumn("h_", seeded(seed, F.col(value))).withColumn("z_", F.length("h_") - F.length(F.ltrim("h_", F.lit("0"))))
    counts = hashed.groupBy(*keys, "z_").agg(F.count(F.lit(1)).alias("c_"))
    upto = F.sum("c_").over(Window.partitionBy(*keys).orderBy(F.desc("z_")))
    least = counts.withColumn("u_", upto).groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("u_") >= n, F.col("z_"))), F.lit(0)).alias("least_"))
    least = cut(least.select(*(F.col(c).alias(f"of_{c}") for c in keys), "least_"))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in keys))
    few = F.broadcast(least) if least.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else least
    return hashed.join(few, same & (F.col("z_") >= F.col("least_"))).select(*rows.columns, "h_")


def first_seeded(rows: DataFrame, keys: list[str], value: str, seed: Column, n: int) -> DataFrame:
    """The first n rows of each key in a seeded order."""
    near = near_front(rows, keys, value, seed, n)
    order = Window.partitionBy(*keys).orderBy("h_", value)
    return near.withColumn("k_", F.row_number().over(order)).where(F.col("k_") <= n).select(*rows.columns)


def matched(frame: pd.DataFrame) -> dict[str, int]:
    """A row of the frame (label, family, in order of preference) for each label, families all different; {} if there is none."""
    wants = {label: list(zip(own["family"], own.index, strict=True)) for label, own in frame.groupby("label", sort=True)}
    holder: dict[object, tuple[str, int]] = {}

    def give(label: str, tried: set) -> bool:
        for family, row in wants[label]:
            if family not in tried:
                tried.add(family)
                if family not in holder or give(holder[family][0], tried):
                    holder[family] = (label, row)
                    return True
        return False

    return {label: row for label, row in holder.values()} if all(give(label, set()) for label in wants) else {}


def unique_families(candidates: DataFrame, keys: list[str], label: str, family: str, value: str, seed: str, labels: int) -> DataFrame:
    """(keys, label, family, value): one candidate for each label of a key, no family twice; none for a key where that can't be.

    labels: how many labels a key has. A label with as many families as there are labels can always be served last, so
    no more of its families are looked at, and groups stay small whatever the number of candidates.
    """
    best = candidates.withColumn("k_", F.row_number().over(Window.partitionBy(*keys, label, family).orderBy(seeded(F.col(seed), F.col(value)), value))).where("k_ = 1")
    order = Window.partitionBy(*keys, label).orderBy(seeded(F.col(seed), F.col(family)), family)
    few = best.withColumn("k_", F.row_number().over(order)).where(F.col("k_") <= labels)
    few = few.select(*keys, F.col(label).cast("string").alias("label"), F.col(family).alias("family"), F.col(value).alias("value"), "k_")
    kinds = dict(few.dtypes)

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["label", "k_"], ignore_index=True)
        found = matched(frame) if frame["label"].nunique() == labels else {}
        return frame.loc[sorted(found.values())].drop(columns="k_")

    out = few.groupBy(*keys).applyInPandas(match, ", ".join(f"{c} {kinds[c]}" for c in (*keys, "label", "family", "value")))
    return out.withColumnsRenamed({"label": label, "family": family, "value": value})


def manifests(train: DataFrame, test: DataFrame, keys: list[str], value: str, attempt: str, accepted: DataFrame) -> DataFrame:
    """(keys, attempt, train, test, train_hash, test_hash) of each key's first accepted attempt: sorted ids and their hashes.

    train, test: (keys, attempt, value) of all attempts; accepted: (keys, attempt) of those that aren't rejected.
    """
    def ids(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys, attempt).agg(F.array_sort(F.collect_set(F.col(value).cast("string"))).alias(name))

    first = accepted.groupBy(*keys).agg(F.min(attempt).alias(attempt))
    both = first.join(ids(train, "train"), [*keys, attempt]).join(ids(test, "test"), [*keys, attempt])
    return both.withColumns({"train_hash": list_hash(F.col("train")), "test_hash": list_hash(F.col("test"))})


#: Attempts that a key has, and those of each wave. Attempts are a fixed value.
MOST_ATTEMPTS, WAVES = 500, (4, 16, 64)


#: Distances of pairs, or what gives those of the pairs (a_id, b_id) that are wanted.
Pairs = DataFrame | Callable[[DataFrame], DataFrame]


def accuracies(train: DataFrame, test: DataFrame, pairs: Pairs, keys: list[str], attempt: str, label: str, value: str) -> DataFrame:
    """(keys, attempt, nearest, correlated, centroid): the share of each key's test samples that three classifiers get right from each attempt's train samples.

    train: (keys, attempt, label, value); test: (keys, label, value); pairs: (a_id, b_id, mse, z_mse), each pair of samples
    once, or a function that gives those of the pairs that meet here, a_id < b_id, with the mean squared difference of their values, and of their values in units of their own mean and spread.
    The least mse is the nearest sample, the least z_mse the one with the highest correlation. A class's centroid needs
    no vectors: the distance to it is the mean distance to its samples less half the mean distance among them.
    Equal distances go to the first label. Pairs without a distance don't count.
    """
    own = train.select(*keys, attempt, F.col(label).alias("said"), F.col(value).alias("b_id"))
    asked = test.select(*keys, F.col(label).alias("truth"), F.col(value).alias("a_id"))
    mates = own.withColumnRenamed("b_id", "a_id").join(own, [*keys, attempt, "said"])
    if not isinstance(pairs, DataFrame):
        wanted = asked.join(own, keys).select("a_id", "b_id").unionByName(mates.select("a_id", "b_id")).where("a_id <> b_id")
        pairs = cut(pairs(cut(wanted.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).distinct())))
    both = pairs.select("a_id", "b_id", "mse", "z_mse")
    both = both.unionByName(both.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), "mse", "z_mse"))
    met = asked.join(own, keys).join(both, ["a_id", "b_id"])
    by_class = met.groupBy(*keys, attempt, "a_id", "truth", "said").agg(F.min("mse").alias("mse"), F.min("z_mse").alias("z_mse"), F.avg("mse").alias("mean"))
    inside = mates.join(pairs.select("a_id", "b_id", "mse"), ["a_id", "b_id"])
    n = own.groupBy(*keys, attempt, "said").agg(F.count(F.lit(1)).alias("n"))
    spread = inside.groupBy(*keys, attempt, "said").agg(F.sum("mse").alias("inside")).join(n, [*keys, attempt, "said"], "right")
    scored = by_class.join(spread, [*keys, attempt, "said"]).withColumn("mean", F.col("mean") - F.coalesce("inside", F.lit(0.0)) / (F.col("n") * F.col("n")))
    right = {"nearest": "mse", "correlated": "z_mse", "centroid": "mean"}
    best = scored.groupBy(*keys, attempt, "a_id", "truth").agg(*((F.min(F.struct(c, "said"))["said"] == F.col("truth")).alias(k) for k, c in right.items()))
    return best.groupBy(*keys, attempt).agg(*(F.avg(F.col(k).cast("double")).alias(k) for k in right))


def adversarial_manifests(pool: DataFrame, test: DataFrame, pairs: Pairs, keys: list[str], label: str, value: str, seed: str, per_label: int, margin: float = 0.1, attempts: int = MOST_ATTEMPTS, waves: tuple[int, ...] = WAVES) -> DataFrame:
    """(keys, attempt, best, train, test, train_hash, test_hash) of each key's first attempt whose train samples don't give the test samples away: the best of the three classifiers gets at most chance + margin (1 - chance) of them right. Keys without such an attempt are left out.

    pool: (keys, seed, label, value), what a key may draw from, without its test samples; test: (keys, label, value).
    An attempt draws `per_label` samples of each label in an order seeded by seed and attempt; an attempt that can't is
    none. Attempts are tried in waves, each over the keys that are still open, so most keys need few. Of the pairs only
    those of drawn and test samples are needed; as a function, pairs gives them wave by wave, however many samples there are.
    """
    names = pool.groupBy(*keys).agg(F.count_distinct(label).alias("labels"))
    open_, begin, out, turn = names, 0, None, 0
    while begin < attempts:
        end = min(attempts, begin + waves[min(turn, len(waves) - 1)])
        rows = pool.join(open_.select(*keys), keys, "left_semi").withColumn("attempt", F.explode(F.sequence(F.lit(begin), F.lit(end - 1))))
        rows = rows.withColumn("own_", F.concat_ws("::", F.col(seed).cast("string"), F.col("attempt").cast("string")))
        drawn = cut(stratified(rows, [*keys, "attempt"], label, value, "own_", per_label).select(*keys, "attempt", label, value))
        whole = drawn.groupBy(*keys, "attempt").agg(F.count(F.lit(1)).alias("n")).join(names, keys).where(F.col("n") == per_label * F.col("labels"))
        scores = accuracies(drawn, test, pairs, keys, "attempt", label, value).join(whole, [*keys, "attempt"])
        best = F.greatest("nearest", "correlated", "centroid")
        passed = scores.withColumn("best", best).where(best <= 1 / F.col("labels") + margin * (1 - 1 / F.col("labels")))
        first = cut(passed.groupBy(*keys).agg(F.min(F.struct("attempt", "best")).alias("m")).select(*keys, "m.attempt", "m.best"))
        found = manifests(drawn, test.join(first, keys), keys, value, "attempt", first.drop("best")).join(first, [*keys, "attempt"])
        found = found.select(*keys, "attempt", "best", "train", "test", "train_hash", "test_hash")
        out = found if out is None else out.unionByName(found)
        open_ = cut(open_.join(first, keys, "left_anti"))
        if open_.isEmpty():
            break
        begin, turn = end, turn + 1
    return out


def candidates(registry: DataFrame, eligibility: DataFrame, keys: list[str]) -> DataFrame:
    """registry (keys, status, skipped) with the reason why a child is no candidate (NULL: it is one), by its own state and its eligibility (keys, vs_baseline, vs_time0)."""
    rows = registry.join(eligibility, keys, "left")
    reason = (
        F.when(F.coalesce("skipped", F.lit(False)), "skipped")
        .when(~F.coalesce(F.lower(F.trim("status")) == "success", F.lit(False)), "not simulated")
        .when(F.col("vs_baseline").isNull() & F.col("vs_time0").isNull(), "not measured")
        .when(F.coalesce(F.col("vs_baseline"), F.lit("")) != "yes", "like its baseline")
        .when(F.coalesce(F.col("vs_time0"), F.lit("")) != "yes", "like its time0 run")
    )
    return rows.withColumn("reason", reason)
