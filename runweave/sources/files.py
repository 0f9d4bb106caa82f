"""Files around the runs: JSON lines, prediction and metadata folders, grids, metrics, bundles, descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, anything else is an error when it is read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    stop = F.raise_error(F.concat(F.lit("not an object: "), F.substring("value", 1, 80)))
    whole = F.when(F.trim("value").startswith("{"), F.col("value")).otherwise(stop.cast("string"))
    return lines.select(F.from_json(whole, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def canonical(df: DataFrame) -> Column:
    """Rows as compact JSON with sorted keys, nulls kept."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(canonical(df).alias("value")).write.text(path)


def read_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """All prediction tables of a folder as text, with `epoch` and `split` from their names `epoch_<number or best>_<split>`."""
    name = r"epoch_(best|\d+)_(train|val|test)"
    rows = spark.read.option("header", True).option("mergeSchema", True).csv(f"{folder}/predictions/*.csv")
    file = F.col("_metadata.file_name")
    return rows.where(file.rlike(name)).select("*", F.regexp_extract(file, name, 1).alias("epoch"), F.regexp_extract(file, name, 2).alias("split"))


def read_run_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of a run's folder, or where it has none the entries of its errors/<split>_errors.json, in the same columns; documents that are no lists of objects are skipped."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    if not listed.where(F.col("path").rlike(r"/predictions/[^/]*\.csv$")).isEmpty():
        return read_predictions(spark, folder)
    names = ("dataset_index", "sample_id", "scenario", "true_label", "pred_label", "true_choice", "pred_choice")
    schema = ", ".join(f"{n} string" for n in names)
    if listed.where(F.col("path").rlike(r"/errors/(train|val|test)_errors\.json$")).isEmpty():
        return spark.createDataFrame([], schema + ", epoch string, split string")
    texts = spark.read.option("wholetext", True).text(f"{folder}/errors").select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(train|val|test)_errors\.json$", 1).alias("split"))
    rows = texts.where("split <> ''").select("split", F.explode(F.from_json("value", f"array<struct<{', '.join(f'{n}:string' for n in names)}>>")).alias("r"))
    whole = ("dataset_index", "true_label", "pred_label")
    return rows.where("r IS NOT NULL").select(*((F.col(f"r.{n}").try_cast("long") if n in whole else F.col(f"r.{n}")).cast("string").alias(n) for n in names), F.lit(None).cast("string").alias("epoch"), "split")


def read_metadata(spark: SparkSession, folder: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): one row of each metadata_task.json below the folder; errors hold path and text of those that don't parse."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "metadata_task.json").option("wholetext", True).text(folder)
    parsed = files.select(F.col("_metadata.file_path").alias("path"), "value", F.from_json("value", StructType([*schema.fields]).add("__bad", "string"), {"columnNameOfCorruptRecord": "__bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r.__bad").isNotNull()
    return parsed.where(~bad).select("path", *(F.col(f"r.{f.name}").alias(f.name) for f in schema.fields)), parsed.where(bad).select("path", F.col("value").alias("text"))


def read_grid(spark: SparkSession, path: str, slugs: list[str] | None = None) -> DataFrame:
    """Settings of experiments; a slug that repeats is an error when its row is read."""
    schema = "type_of_request string, desc_level string, noise_level string, number_train_samples_per_class int, number_test_samples int, is_adversarial boolean, seeds string, test_set_slug string, shot_slug string, row_slug string"
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path).withColumn("seeds", F.from_json("seeds", "array<int>"))
    chosen = rows.where(F.col("row_slug").isin(slugs)) if slugs is not None else rows
    others = [c for c in rows.columns if c != "row_slug"]
    found = chosen.groupBy("row_slug").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*others)).alias("r"))
    stop = F.raise_error(F.concat(F.lit("repeated slug: "), F.col("row_slug")))
    return found.select(F.when(F.col("n") == 1, F.col("row_slug")).otherwise(stop.cast("string")).alias("row_slug"), "r.*").select(rows.columns)


def newest_file(df: DataFrame) -> DataFrame:
    """Rows of a file source that come from the file with the last name."""
    tagged = df.select("*", F.col("_metadata.file_name").alias("__file"))
    last = tagged.agg(F.max("__file").alias("__file"))
    return tagged.join(F.broadcast(last), "__file").drop("__file")  # one row


def aligned_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new metrics in one table; accuracies under their former names move to metric_accuracy."""
    former = [c for c in ("metric_accuracy", "metric_value", "accuracy") if c in old.columns]
    moved = old.withColumn("metric_accuracy", F.coalesce(*former)) if former else old
    return moved.drop("metric_value", "accuracy").unionByName(new, allowMissingColumns=True).select(new.columns)


def export_bundle(samples: DataFrame, selected: DataFrame, path: str, key: str = "run_id") -> None:
    """Only the samples of selected runs, one folder each; Spark's committer makes the files visible together."""
    samples.join(selected.select(key), key, "left_semi").repartition(key).write.partitionBy(key).option("compression", "zstd").parquet(path)


def describe(spark: SparkSession, path: str) -> tuple[list[dict[str, str]], DataFrame]:
    """The typed fields of a Parquet table, and (path, length, sha256) of each of its files, which are of 2 GB at most."""
    fields = [{"name": f.name, "type": f.dataType.simpleString()} for f in spark.read.parquet(path).schema.fields]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return fields, files.select("path", "length", F.sha2("content", 256).alias("sha256"))
