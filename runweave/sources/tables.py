"""Sources: runs as long tables of samples, and readers by suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet unless the suffix says CSV, JSON lines or ORC."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return spark.read.option("header", True).csv(path)
    if suffix in ("json", "jsonl"):
        return spark.read.option("mode", "FAILFAST").json(path)
    return spark.read.orc(path) if suffix == "orc" else spark.read.parquet(path)


def vector_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, label, pos, value): each vector as a regular run of one signal."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("run_id"), "label", F.posexplode("embedding").alias("pos", "v")).select("run_id", "label", "pos", F.col("v").cast("double").alias("value"))


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, signal, t, value): irregular samples of each user, in microseconds since the first of 2024."""
    t = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("signal"), t.alias("t"), "value")


def evenly_spaced(df: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """At most `most` rows of each key, at evenly spaced places from the first to the last."""
    own = Window.partitionBy(*keys)
    n, pos = F.count(F.lit(1)).over(own), F.row_number().over(own.orderBy(order)) - 1
    # a place is picked if it is the floor of k (n - 1) / (most - 1) for a whole k
    placed = df.withColumn("n_rows", n).withColumn("place", pos)
    k = F.ceil(F.col("place") * (most - 1) / F.greatest(F.col("n_rows") - 1, F.lit(1)))
    return placed.where((F.col("n_rows") <= most) | (F.floor(k * (F.col("n_rows") - 1) / (most - 1)) == F.col("place")))


def write_runs(df: DataFrame, path: str, keys: tuple[str, ...] = ("run_id", "signal", "pos")) -> None:
    """Samples as FLOAT in zstd Parquet, sorted within files; values beyond FLOAT are an error."""
    value = F.when(F.abs("value") > 3.4028235e38, F.raise_error(F.lit("a value does not fit a FLOAT")).cast("float")).otherwise(F.col("value").cast("float"))
    have = [k for k in keys if k in df.columns]
    df.withColumn("value", value).sortWithinPartitions(*have).write.option("compression", "zstd").parquet(path)


#: Rows that a reader gets of a run if it doesn't say, and at most. Fixed values.
ROWS, MOST_ROWS = 50_000, 200_000


def fetched(df: DataFrame, keys: list[str], order: str, rows: int | None = None) -> DataFrame:
    """Evenly spaced rows of each run, as many as asked for (ROWS without a number), MOST_ROWS at most."""
    return evenly_spaced(df, keys, order, max(1, min(rows or ROWS, MOST_ROWS)))
