"""Reproducible noise: each run has a stream of normals of its own, so any row's noise follows from its place."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .windows import centred

#: Samples of the window of the local level, and the least share of the run's level that counts.
WINDOW, FLOOR = 11, 1e-4


@dataclass(frozen=True)
class Rules:
    """window: samples of the local level, an odd number; floor: the least share of the run's level that counts."""

    window: int = WINDOW
    floor: float = FLOOR


def rules_of(text: str | None, default: Rules = Rules()) -> Rules:
    """Rules from a JSON document. What it lacks, or what is no number, is the default's; windows under 1 too, and even ones are one larger."""
    try:
        given = json.loads(text or "")
    except ValueError:
        return default
    if not isinstance(given, dict):
        return default

    def number(name: str, kind: type, fallback: float) -> float:
        try:
            found = float(given.get(name))
            return kind(found) if math.isfinite(found) else fallback
        except (TypeError, ValueError):
            return fallback

    window = number("rolling_window_points", int, default.window)
    window = window if window >= 1 else default.window
    return Rules(int(window) + (int(window) % 2 == 0), number("sigma_floor_ratio", float, default.floor))


def levels(df: DataFrame, keys: list[str], order: str, value: str = "value", window: int = WINDOW) -> DataFrame:
    """df with the RMS of the finite samples of the window (__local) and of the run (__whole)."""
    square = F.when(X.finite(F.col(value)), F.pow(F.col(value), 2))
    rms = lambda w: F.coalesce(F.sqrt(F.avg(square).over(w)), F.lit(0.0))
    return df.withColumn("__local", rms(centred(keys, order, window))).withColumn("__whole", rms(Window.partitionBy(*keys)))


def adaptive_sigma(share: float, base: float = 0.0, absolute: float = 0.0, floor: float = FLOOR) -> Column:
    """Of the local level, the run's level and a constant, added as independent spreads."""
    local = share * F.greatest(F.col("__local"), floor * F.col("__whole"))
    return F.sqrt(F.pow(local, 2) + F.pow(base * F.col("__whole"), 2) + absolute**2)


def global_sigma(multiplier: float, scale: float = 0.03) -> Column:
    return multiplier * scale * F.col("__whole")


def stream_seed(key: Column, seed: Column) -> Column:
    """The seed of a named stream."""
    return X.fnv1a32(F.concat(key, F.lit(":"), seed.cast("string")))


def run_seed(base: int, run_id: Column) -> Column:
    return X.fnv1a32(run_id).bitwiseXOR(F.lit(base).cast("long"))


def place(keys: list[str], order: str, sigma: Column, value: str = "value") -> Column:
    """The number of a sample among those of its run where sample and sigma are usable, from 1; NULL where they aren't."""
    usable = X.finite(F.col(value)) & X.finite(sigma) & (sigma > 0)
    k = F.sum(usable.cast("long")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return F.when(usable, k)


def with_normals(df: DataFrame, out: str, seed: Column, k: Column) -> DataFrame:
    """df with the k-th normal of the stream of a seed, as of `exprs.normal`: two uniforms, cosine branch.

    Each step of the generator is a column: as one expression, a step names the one before several times, so that it is
    evaluated some hundred times over.
    """
    mask, one = F.lit(4294967295), F.lit(1).cast("long")
    word = df.withColumns({"__s": seed.cast("long"), "__n": k.cast("long")})
    word = word.withColumns({"__u": (F.col("__s") + (2 * F.col("__n") - 1) * 1831565813).bitwiseAND(mask), "__v": (F.col("__s") + 2 * F.col("__n") * 1831565813).bitwiseAND(mask)})
    right = F.shiftrightunsigned
    for shift, bits in ((15, one), (7, F.lit(61).cast("long"))):
        factors = {}
        for c in ("__u", "__v"):
            factors |= {f"{c}a": F.col(c).bitwiseXOR(right(c, shift)), f"{c}b": F.col(c).bitwiseOR(bits)}
        word = word.withColumns(factors)
        low = {f"{c}l": F.col(f"{c}a") * F.col(f"{c}b").bitwiseAND(F.lit(65535)) for c in ("__u", "__v")}
        high = {f"{c}h": (F.col(f"{c}a") * right(f"{c}b", 16)).bitwiseAND(F.lit(65535)) * 65536 for c in ("__u", "__v")}
        product = {c: (F.col(f"{c}l") + F.col(f"{c}h")).bitwiseAND(mask) for c in ("__u", "__v")}
        word = word.withColumns(low | high)
        if shift == 7:
            product = {c: F.col(c).bitwiseXOR((F.col(c) + p).bitwiseAND(mask)) for c, p in product.items()}
        word = word.withColumns(product)
    uniform = {c: F.col(c).bitwiseXOR(right(c, 14)).bitwiseAND(mask) / 4294967296.0 for c in ("__u", "__v")}
    normal = F.sqrt(-2 * F.ln(F.greatest("__u", F.lit(1e-300)))) * F.cos(F.col("__v") * 6.283185307179586)
    return word.withColumns(uniform).withColumn(out, normal).drop("__s", "__n", *(f"{c}{x}" for c in ("__u", "__v") for x in ("", "a", "b", "l", "h")))


def draw(df: DataFrame, keys: list[str], order: str, out: str, sigma: Column, seed: Column, value: str = "value") -> DataFrame:
    """df with the noise `out`: the next normal of the run's stream wherever sample and sigma are usable, else 0."""
    placed = df.withColumns({"__sigma": sigma, "__k": place(keys, order, sigma, value), "__seed": seed})
    noisy = with_normals(placed, "__normal", F.col("__seed"), F.col("__k"))
    return noisy.withColumn(out, F.when(F.col("__k").isNotNull(), F.col("__sigma") * F.col("__normal")).otherwise(0.0)).drop("__seed", "__k", "__sigma", "__normal")


def apply_profile(df: DataFrame, run: str, signal: str, order: str, share: float, base: float, absolute: float, seed: int, value: str = "value") -> DataFrame:
    """df with `noisy`: each signal of each run has its stream, seeded by the profile's seed and the run."""
    keys, run_id = [run, signal], F.col(run).cast("string")
    stream = stream_seed(F.concat(F.lit("signal:"), run_id, F.lit(":"), F.col(signal)), run_seed(seed, run_id))
    noisy = draw(levels(df, keys, order, value), keys, order, "__noise", adaptive_sigma(share, base, absolute), stream, value)
    return noisy.withColumn("noisy", F.col(value) + F.col("__noise")).drop("__noise", "__local", "__whole")


def apply_streams(df: DataFrame, run: str, signal: str, order: str, run_share: float = 0.0, signal_shares: dict[str, float] | None = None, seed: int = 0, rules: Rules = Rules(), value: str = "value") -> DataFrame:
    """df with `noisy`: the value, noise of all signals and noise of the single signal, from streams `run:` and `signal:` of the signal's name.

    signal_shares: shares by signal; others have no noise of their own. A share that is not finite is none.
    """
    keys, shares = [run, signal], {k: v for k, v in (signal_shares or {}).items() if math.isfinite(v)}
    one = F.coalesce(*(F.when(F.col(signal) == k, F.lit(float(v))) for k, v in shares.items()), F.lit(0.0))
    out = levels(df, keys, order, value, rules.window)
    for name, share in (("run", F.lit(run_share if math.isfinite(run_share) else 0.0)), ("signal", one)):
        sigma = share * F.greatest(F.col("__local"), rules.floor * F.col("__whole"))
        out = draw(out, keys, order, f"__{name}", sigma, stream_seed(F.concat(F.lit(f"{name}:"), F.col(signal)), F.lit(seed)), value)
    return out.withColumn("noisy", F.col(value) + F.col("__run") + F.col("__signal")).drop("__run", "__signal", "__local", "__whole")
