"""Draws of the sequential generators that published splits come from, stepped inside tasks, a key's ids at a time.

Only ids go through a generator. A key's ids must fit a task: they are the families or the names of one model. Hashes
of keys (`sampling`) have no such bound, but other draws.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def generator_seed(*parts: object) -> int:
    """The seed of a generator that is named by parts: the first eight bytes of a hash, most significant first."""
    return int.from_bytes(hashlib.sha256("::".join(map(str, parts)).encode()).digest()[:8], "big")


def _by_key(df: DataFrame, keys: list[str], columns: list[str], more: str, run: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, *columns]) + f", {more}"
    return df.select(*keys, *columns).groupBy(*keys).applyInPandas(run, schema)


def permuted(df: DataFrame, keys: list[str], value: str, seed: str | int) -> DataFrame:
    """(keys, value, place): each key's values, in ascending order before, by a NumPy generator's permutation. seed: a number, or the column of it."""
    seeded = df.withColumn("seed_", F.col(seed) if isinstance(seed, str) else F.lit(seed))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(value, ignore_index=True)
        order = np.random.default_rng(int(own["seed_"].iloc[0])).permutation(len(own))
        return own.iloc[order].drop(columns="seed_").assign(place=np.arange(len(own)))

    kinds = dict(seeded.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, value]) + ", place long"
    return seeded.select(*keys, value, "seed_").groupBy(*keys).applyInPandas(run, schema)


def folds(df: DataFrame, keys: list[str], family: str, cv: int, seed: int) -> DataFrame:
    """(keys, family, fold): families dealt whole to cv folds by a permutation; the first ones are larger by one where they must. Fewer families than folds are an error."""
    if cv < 2:
        raise ValueError("there are at least two folds")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        names = own[family].drop_duplicates().sort_values(ignore_index=True)
        if len(names) < cv:
            raise ValueError(f"{len(names)} families for {cv} folds")
        order = np.random.default_rng(seed).permutation(len(names))
        fold = np.empty(len(names), np.int64)
        for k, part in enumerate(np.array_split(order, cv)):
            fold[part] = k
        out = pd.DataFrame({family: names, "fold": fold})
        for c in keys:
            out[c] = own[c].iloc[0]
        return out[[*keys, family, "fold"]]

    return _by_key(df.select(*keys, family).distinct(), keys, [family], "fold long", run)


def shuffled(df: DataFrame, keys: list[str], value: str, order: str, seed: str | int) -> DataFrame:
    """(keys, value, place): each key's values, in the order of a column before, by Python's own shuffle."""
    seeded = df.withColumn("seed_", F.col(seed) if isinstance(seed, str) else F.lit(seed)).withColumn("order_", F.col(order))
    kinds = dict(seeded.dtypes)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("order_", ignore_index=True)
        places = list(range(len(own)))
        random.Random(int(own["seed_"].iloc[0])).shuffle(places)
        return own.iloc[places].drop(columns=["seed_", "order_"]).assign(place=np.arange(len(own)))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, value]) + ", place long"
    return seeded.select(*keys, value, "seed_", "order_").groupBy(*keys).applyInPandas(run, schema)


def chosen(pool: DataFrame, keys: list[str], label: str, value: str, per_label: int, *parts: str) -> DataFrame:
    """(keys, label, value): `per_label` values of each label without replacement, label after label in ascending order from one generator named by these columns; nothing where a label has too few."""
    kinds = dict(pool.dtypes)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(generator_seed(*(own[p].iloc[0] for p in parts)))
        found = []
        for _, of_label in own.sort_values([label, value]).groupby(label, sort=True):
            if len(of_label) < per_label:
                return own.iloc[:0][[*keys, label, value]]
            found.append(of_label.iloc[rng.choice(len(of_label), size=per_label, replace=False)])
        return pd.concat(found)[[*keys, label, value]]

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, label, value])
    return pool.select(*{c: None for c in (*keys, label, value, *parts)}).groupBy(*keys).applyInPandas(run, schema)
