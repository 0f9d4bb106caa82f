"""Families of runs: what their children cover, how they split, and how their identities chain."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite
from . import plugins


def covered(children: DataFrame, expected: DataFrame, family: str, parameter: str, least: int = 3) -> DataFrame:
    """(family, parameters, eligible): how many of the expected parameters a family's eligible children cover, and whether they are enough."""
    known = expected.select(F.col(parameter).alias("p_"), F.lit(True).alias("known_")).distinct()
    rows = children.join(known, F.col(parameter) == F.col("p_"), "left")
    n = F.count_distinct(F.when(F.col("eligible") & F.col("known_"), F.col(parameter)))
    return rows.groupBy(family).agg(n.alias("parameters"), (n >= least).alias("eligible"))


def one_child_each(children: DataFrame, expected: DataFrame, family: str, parameter: str, child: str) -> DataFrame:
    """(family, parameter, child): the first eligible child of each parameter, of the families whose parameters are exactly the expected ones."""
    first = children.where("eligible").groupBy(family, parameter).agg(F.min(child).alias(child))
    wanted = expected.agg(F.array_sort(F.collect_set(parameter)).alias("wanted_"))  # a row; parameters of a model are few
    own = first.groupBy(family).agg(F.array_sort(F.collect_set(parameter)).alias("own_"))
    whole = own.crossJoin(F.broadcast(wanted)).where("own_ = wanted_").select(family)
    return first.join(whole, family, "left_semi")


def expanded_folds(folds: DataFrame, children: DataFrame, family: str) -> DataFrame:
    """The children of each fold's families, each with its fold."""
    return children.join(folds, family)


def distinct_times(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """(keys, times): distinct finite times of a run over all its signals."""
    return df.where(finite(F.col(time).cast("double"))).groupBy(*keys).agg(F.count_distinct(time).alias("times"))


def collapsed(df: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """Means of the values at each time, times as FLOAT."""
    return df.groupBy(*keys, F.col(time).cast("float").alias(time)).agg(*(F.avg(v).alias(v) for v in values))


def others(selected: DataFrame, used: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value): all selected values that a key doesn't use, by a left anti-join of the keys' values and those they use. It has up to as many rows as keys times values."""
    every = used.select(*keys).distinct().crossJoin(selected.select(value).where(F.col(value).isNotNull()).distinct())
    own = used.select(*(F.col(c).alias(f"{c}_used") for c in (*keys, value))).distinct()
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"{c}_used")) for c in (*keys, value)))
    return every.join(own, same, "left_anti")


def set_verdicts(expected: Column, valid: Column, train: Column, test: Column) -> dict[str, Column]:
    """Whether the expected are all valid, and whether train and test have nothing in common."""
    return {"subset": F.size(F.array_except(expected, valid)) == 0, "disjoint": F.size(F.array_intersect(train, test)) == 0}


def with_truth(losses: DataFrame, truth: DataFrame, child: str, parameter: str) -> DataFrame:
    """(child, parameter, loss, is_truth): all candidates, and the true one with a NULL loss where it was not tried."""
    t = truth.select(child, F.col(parameter).alias("t_"))
    tried = losses.join(t, child).withColumn("is_truth", F.col(parameter) == F.col("t_")).drop("t_")
    missing = t.withColumnRenamed("t_", parameter).join(losses.select(child, parameter), [child, parameter], "left_anti")
    return tried.unionByName(missing.select(child, parameter, F.lit(None).cast("double").alias("loss"), F.lit(True).alias("is_truth")).select(tried.columns))


def runtime_rows(nodes: DataFrame) -> DataFrame:
    """(id, kind, label, policy, status) of a graph's nodes (id, kind, parameter) as runtime entries: what changes, and by which policy it is simulated."""
    kind = F.lower(F.trim("kind"))
    label = F.when(kind == "child", F.col("parameter")).when(kind == "time0", F.concat(F.col("parameter"), F.lit(" from the start"))).when(kind == "baseline", "no change")
    policy = F.when(kind == "child", "change_in_run").when(kind == "time0", "change_at_start").when(kind == "baseline", "unchanged")
    return nodes.select("id", kind.alias("kind"), label.alias("label"), policy.alias("policy"), F.lit("not_run").alias("status"))


def canonical_map(m: Column) -> Column:
    """A map as compact JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def identity(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def chained(baseline: Column, parameters: Column, start: Column) -> dict[str, Column]:
    """Hashes of a baseline's parameters, of a child of it, and of the child's time0 run."""
    base = identity(canonical_map(baseline))
    child = identity(F.concat_ws(":", base, canonical_map(parameters), start.cast("string")))
    return {"base_hash": base, "child_hash": child, "time0_hash": identity(F.concat(child, F.lit(":0")))}


def balanced_support(support: DataFrame, label: str) -> bool:
    """Whether all classes of a support set have as many runs."""
    n = support.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("a"), F.max("n").alias("b")).first()
    return n.a is not None and n.a == n.b


class Inferers:
    """Users' functions over runs by the name of the model that they are for."""

    def __init__(self):
        self.known: dict[str, tuple[Callable[..., object], frozenset[str]]] = {}

    def add(self, model: str, infer: Callable[..., object], required: tuple[str, ...] = ()) -> None:
        if model in self.known:
            raise ValueError(f"{model} has an inferer")
        self.known[model] = infer, frozenset(required)

    def apply(self, model: str, runs: DataFrame, keys: list[str], order: str, **options: object) -> DataFrame:
        """The answers of a model's function, as of a rule; unknown models and missing options are errors."""
        if model not in self.known:
            raise ValueError(f"no inferer for {model}")
        infer, required = self.known[model]
        if missing := sorted(required - options.keys()):
            raise ValueError(f"{model} needs {missing}")

        def one(run: pd.DataFrame) -> object:
            return infer(run, **options)

        return plugins.apply_rule(runs, keys, order, one)
