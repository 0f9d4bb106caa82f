"""Tables of runs out of folders: where they lie, which source wins, and how parts of them are given away."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import loading


@dataclass(frozen=True)
class Layout:
    """Where a model's files lie below a root."""

    root: str

    def model(self, model: str) -> str:
        return f"{self.root}/{model}"

    def runs(self, model: str) -> str:
        return f"{self.model(model)}/runs"

    def run(self, model: str, run_id: str) -> str:
        return f"{self.runs(model)}/{run_id}"

    def data(self, model: str, run_id: str, kind: str = "parquet") -> str:
        return f"{self.run(model, run_id)}/data.{kind}"

    def bundles(self, model: str) -> str:
        return f"{self.model(model)}/bundles"

    def metadata(self, model: str, run_id: str) -> str:
        return f"{self.run(model, run_id)}/metadata.json"


def run_id_of(path: Column) -> Column:
    """The run of a data file: its folder's name, or that of a bundle's file."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"/([^/]+)/data\.[^/.]+(?:/|$)", 1), F.lit("")), F.regexp_extract(path, r"/([^/]+)\.[^/.]+$", 1))


def load_run(spark: SparkSession, folder: str) -> DataFrame | None:
    """A run's data.parquet, else its data.csv; None without one that can be read, or with a time that is no number."""
    for kind in ("parquet", "csv"):
        try:
            df = getattr(spark.read.option("header", True), kind)(f"{folder}/data.{kind}")
            time = loading.time_column(df.columns)
            if time is None:
                return None
            bad = df.where(loading.number(time).isNull()).isEmpty()
            return df.withColumn(time, loading.number(time)) if bad else None
        except Exception:  # noqa: BLE001 - any failure to read means that there is no such run
            continue
    return None


def scan_runs(spark: SparkSession, runs: str, bundles: str | None = None, schema: str | None = None) -> DataFrame:
    """All runs of a folder of run folders (run_id, ...), and those of a folder of bundles that have no folder of their own."""
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", True)
    path = F.col("_metadata.file_path")
    own = reader.parquet(f"{runs}/*/data.parquet").select(run_id_of(path).alias("run_id"), "*")
    if bundles is None:
        return own
    more = reader.parquet(f"{bundles}/*.parquet").select(run_id_of(path).alias("run_id"), "*")
    return own.unionByName(more.join(own.select("run_id").distinct(), "run_id", "left_anti"), allowMissingColumns=True)


def preferred(df: DataFrame, keys: list[str], source: str, order: list[str]) -> DataFrame:
    """The rows of each key from the first source of the order that has it; unlisted sources come last, by name."""
    rank = F.lit(len(order))
    for k, name in enumerate(order):
        rank = F.when(F.col(source) == name, k).otherwise(rank)
    best = F.min(F.struct(rank.alias("r"), F.col(source).alias("s"))).over(Window.partitionBy(*keys))
    return df.withColumn("best_", best["s"]).where(F.col(source) == F.col("best_")).drop("best_")


def locate(runs: DataFrame, run_id: object, model: str = "model", key: str = "run_id") -> str | None:
    """The first model by name that holds a run."""
    found = runs.where(F.col(key) == run_id).select(F.min(model).alias("m")).first()
    return found.m if found else None


def lite(questions: DataFrame, parts: dict[str, DataFrame], key: str, n: int, seed: int, label: str) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """n questions in a seeded order, the rows of dependent tables that belong to them, and the counts of their labels."""
    order = F.md5(F.concat(F.lit(f"{seed}::"), F.col(key).cast("string")))
    chosen = questions.orderBy(order, key).limit(n)
    kept = {name: df.join(chosen.select(key), key, "left_semi") for name, df in parts.items()}
    return chosen, kept, chosen.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def write_json(value: object, path: str) -> None:
    """A small document with sorted keys, on a local path: written beside it first, then put in its place."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=folder, suffix=".part")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as file:
            json.dump(value, file, sort_keys=True, indent=2, ensure_ascii=False)
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def materialised(runs: DataFrame, noisy: Column | None = None, value: str = "value") -> DataFrame:
    """A sample as a solver sees it: the value (with its noise, if given), and all columns by anonymous names."""
    df = runs.withColumn(value, noisy) if noisy is not None else runs
    return loading.anonymise(df)
