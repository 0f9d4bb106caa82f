"""Users' functions over runs. They are passed as Python callables, never loaded from files, and see one run at a time.

A run is the unit of memory: it must fit a task.
"""

from __future__ import annotations

import inspect
import json
import math
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _schema(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in keys)


def answer_of(said: object, labels: set[str] | None) -> tuple[list[str], float | None]:
    """A rule's answer as a list of labels, with the time of change that it may name."""
    when = None
    if isinstance(said, dict):
        said, when = said["final_answer"], said.get("change_time")
    answers = [said] if isinstance(said, str) else list(said)
    if not answers or any(not isinstance(a, str) or not a.strip() for a in answers):
        raise ValueError("an answer is one label or a list of some")
    answers = [a.strip() for a in answers]
    if len(set(answers)) < len(answers):
        raise ValueError("a label repeats")
    if labels is not None and (unknown := sorted(set(answers) - labels)):
        raise ValueError(f"unknown labels: {unknown}")
    return answers, None if when is None else float(when)


def apply_rule(runs: DataFrame, keys: list[str], order: str, predict: Callable[[pd.DataFrame], object], labels: set[str] | None = None) -> DataFrame:
    """(keys, predictions, change_time, error) of each run; a rule that fails gives no predictions, and its error."""

    def one(key: tuple, run: pd.DataFrame) -> pd.DataFrame:
        try:
            answers, when = answer_of(predict(run.sort_values(order, kind="stable", ignore_index=True)), labels)
            row = [*key, answers, when, None]
        except Exception as e:  # noqa: BLE001 - whatever a user's rule raises is part of the result
            row = [*key, [], None, f"{type(e).__name__}: {e}"]
        return pd.DataFrame([row], columns=[*keys, "predictions", "change_time", "error"]).astype({"change_time": "float64"})

    return runs.groupBy(*keys).applyInPandas(one, f"{_schema(runs, keys)}, predictions array<string>, change_time double, error string")


def apply_features(runs: DataFrame, keys: list[str], order: str, compute: Callable[[pd.DataFrame], dict[str, float]]) -> DataFrame:
    """(keys, features) of each run; values that are not finite become null."""

    def one(key: tuple, run: pd.DataFrame) -> pd.DataFrame:
        found = {str(k): float(v) if v is not None and math.isfinite(v) else None for k, v in compute(run.sort_values(order, kind="stable", ignore_index=True)).items()}
        return pd.DataFrame([[*key, found]], columns=[*keys, "features"])

    return runs.groupBy(*keys).applyInPandas(one, f"{_schema(runs, keys)}, features map<string,double>")


def apply_beside(runs: DataFrame, references: DataFrame, keys: list[str], order: str, f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f(run, reference) of each key that has a run, without keys in its result: noise after a reference, or a test for a difference. A missing reference is an empty table."""

    columns = references.columns
    # columns of their own: where both sides come from one table, Spark 4.1 prunes the second's columns under a projection
    references = references.select(*(F.col(f"`{c}`").alias(c) for c in columns))

    def one(key: tuple, run: pd.DataFrame, reference: pd.DataFrame) -> pd.DataFrame:
        if run.empty:
            return pd.DataFrame(columns=[*keys, *(part.split()[0] for part in schema.split(","))])
        reference = reference.reindex(columns=columns)  # a side without rows comes without columns
        found = f(run.sort_values(order, kind="stable", ignore_index=True), reference.sort_values(order, kind="stable", ignore_index=True))
        for place, (name, value) in enumerate(zip(keys, key, strict=True)):
            found.insert(place, name, value)
        return found

    return runs.groupBy(*keys).cogroup(references.groupBy(*keys)).applyInPandas(one, f"{_schema(runs, keys)}, {schema}")


#: Noise profiles that a model's noise must know, and the scopes of their thresholds. Fixed values.
PROFILES, SCOPES = ("low", "high"), ("global", "local")


def checked_noise(model: str, exports: object) -> object:
    """A model's noise, a module or the like, after a check of what it must export.

    NOISE_DICT: settings by profile; SNR_THR_DICT: by profile and scope a list of thresholds;
    quantify_noise(clean, noisy, reference); add_noise(src, seed, noise_level, ref) -> (frame, analysis).
    """
    settings, thresholds = getattr(exports, "NOISE_DICT", None), getattr(exports, "SNR_THR_DICT", None)
    if not isinstance(settings, Mapping) or any(p not in settings for p in PROFILES):
        raise TypeError(f"{model}: NOISE_DICT must have the profiles {PROFILES}")
    if not isinstance(thresholds, Mapping) or not all(isinstance(thresholds.get(p), Mapping) and isinstance(thresholds[p].get(s), list) for p in PROFILES for s in SCOPES):
        raise TypeError(f"{model}: SNR_THR_DICT must have a list for each of {PROFILES} and {SCOPES}")
    for name, parameters in (("quantify_noise", ["clean", "noisy", "reference"]), ("add_noise", ["src", "seed", "noise_level", "ref"])):
        f = getattr(exports, name, None)
        if not callable(f) or list(inspect.signature(f).parameters) != parameters:
            raise TypeError(f"{model}: {name} must take {parameters}")
    return exports


def profile_of(said: str | None) -> str:
    """none, low or high, in any case; nothing said is none."""
    profile = (said or "none").strip().lower() or "none"
    if profile not in ("none", *PROFILES):
        raise ValueError(f"unknown noise profile: {said}")
    return profile


def apply_noise(runs: DataFrame, references: DataFrame, keys: list[str], order: str, models: dict[str, object], profile: str | None, seed: int, model: str = "model") -> DataFrame:
    """(keys, columns of the run, analysis) of each run after its model's noise: keys begin with the model's name, by which the noise is chosen.

    models: noise by model, checked here. analysis: what add_noise says of the run, as JSON with sorted keys, beside
    each of its rows. Profile none leaves runs as they are, without an analysis. A model without noise is an error.
    """
    profile = profile_of(profile)
    known = {name: checked_noise(name, m) for name, m in models.items()}
    columns = [c for c in runs.columns if c not in keys]
    kinds = dict(runs.dtypes)
    if profile == "none":
        return runs.select(*keys, *columns, F.lit(None).cast("string").alias("analysis"))
    tagged = runs.withColumn("model_", F.col(model))

    def noisy(run: pd.DataFrame, reference: pd.DataFrame) -> pd.DataFrame:
        name = run["model_"].iloc[0]
        if name not in known:
            raise KeyError(f"no noise for model {name}")
        given = known[name].add_noise(run[columns].copy(), seed=seed, noise_level=profile, ref=reference[columns].copy() if len(reference) else None)
        if not (isinstance(given, tuple) and len(given) == 2 and isinstance(given[0], pd.DataFrame) and isinstance(given[1], dict)):
            raise TypeError(f"{name}: add_noise must return a frame and a dict")
        return given[0][columns].assign(analysis=json.dumps(given[1], sort_keys=True))

    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", analysis string"
    return apply_beside(tagged, references, keys, order, noisy, schema)
