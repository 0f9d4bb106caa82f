"""Scores of answers: by kind of sample, over seeds, by what can be judged; answers and batches that must be whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.exprs import finite
from .align import parts


def by_sample_type(rows: DataFrame, keys: list[str], types: list[str], kind: str = "sample_type", top1: str = "top1_correct", score: str = "shortlist_score", answers: str = "num_answers") -> DataFrame:
    """(keys, sample_type, top1, shortlist, answers) for each of the types, zeros where a key has none: the shares right at once and the scores over all rows (null is none), the numbers of answers over those that are finite."""
    own = rows.withColumn("kind_", F.trim(kind)).where(F.col("kind_").isin(types))
    found = own.groupBy(*keys, "kind_").agg(F.avg(F.when(F.col(top1), 1.0).otherwise(0.0)).alias("t_"), F.avg(F.coalesce(F.col(score).cast("double"), F.lit(0.0))).alias("s_"), F.avg(F.when(finite(F.col(answers).cast("double")), F.col(answers).cast("double"))).alias("a_"))
    every = rows.select(*keys).distinct().withColumn("kind_", F.explode(F.array(*map(F.lit, types))))
    return every.join(found, [*keys, "kind_"], "left").select(*keys, F.col("kind_").alias("sample_type"), *(F.coalesce(c, F.lit(0.0)).alias(n) for c, n in (("t_", "top1"), ("s_", "shortlist"), ("a_", "answers"))))


def accuracy_by(rows: DataFrame, keys: list[str], correct: Column, evaluable: Column, classes: int) -> DataFrame:
    """(keys, n, correct, evaluable, accuracy, corrected): right answers over those that can be judged (null without any), and that less what chance gives."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(correct).alias("correct"), F.count_if(evaluable).alias("evaluable"))
    accuracy = F.try_divide(F.col("correct"), F.col("evaluable"))
    return counts.withColumn("accuracy", accuracy).withColumn("corrected", X.chance_corrected(F.col("accuracy"), F.lit(classes)))


def over_seeds(rows: DataFrame, sample: str, part: str, score: Column, base: Column, headline: Column) -> DataFrame:
    """(part, samples, mean, headline): means over the seeds of each sample, then over samples; the headline is of the base seed's rows alone, 0 without any."""
    each = rows.groupBy(sample, part).agg(F.avg(score).alias("mean"), F.avg(F.when(base, headline)).alias("headline"))
    return each.groupBy(part).agg(F.count(F.lit(1)).alias("samples"), F.avg("mean").alias("mean"), F.coalesce(F.avg("headline"), F.lit(0.0)).alias("headline"))


def of_evaluable(stats: DataFrame, sums: list[str], evaluable: str = "evaluable_count") -> list[Column]:
    """Each sum over the number that can be judged, 0 where nothing can."""
    n = F.coalesce(F.col(evaluable), F.lit(0))
    return [F.when(n > 0, F.coalesce(F.col(c), F.lit(0)) / n).otherwise(0.0).alias(c) for c in sums if c in stats.columns]


def signal_ratio(pairs: DataFrame, keys: list[str], delta: Column, baseline: Column) -> DataFrame:
    """(keys, most, share, ratio): the largest difference, as a share of the baseline's largest value, and over the mean of its values.

    The ratio is 0 for a baseline whose mean isn't finite, or is 0 where nothing differs; infinite where something
    differs from a baseline of zeros or the difference has no bound. NaN counts as missing, share is null over zeros.
    """
    d, b = (F.when(~F.isnan(c), F.abs(c)) for c in (delta, baseline))
    found = pairs.groupBy(*keys).agg(F.max(d).alias("most"), F.max(b).alias("top_"), F.avg(b).alias("mean_"))
    unbounded = F.lit(float("inf"))
    ratio = F.when(~finite(F.col("mean_")), 0.0).when(F.col("mean_") <= 0, F.when(F.col("most") > 0, unbounded).otherwise(0.0)).when(~finite(F.col("most")), unbounded).otherwise(F.try_divide(F.col("most"), F.col("mean_")))
    return found.select(*keys, "most", F.try_divide(F.col("most"), F.col("top_")).alias("share"), ratio.alias("ratio"))


def batched(rows: DataFrame, keys: list[str], order: str, size: int, whole: bool = True) -> DataFrame:
    """rows with `batch`, numbered from 0 in this order. whole: a key whose rows the size doesn't divide is an error."""
    own = Window.partitionBy(*keys)
    batch = F.floor((F.row_number().over(own.orderBy(order)) - 1) / size).cast("long")
    n = F.count(F.lit(1)).over(own)
    stop = F.raise_error(F.concat(F.lit(f"{size} must divide the number of samples, "), n.cast("string"))).cast("long")
    return rows.withColumn("batch", F.when(n % size == 0, batch).otherwise(stop) if whole else batch)


def answer_faults(answers: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, sample): what is wrong with answers (keys, sample, labels as array) to the samples expected (keys, sample).

    Names with and without `.parquet` or folders are one sample. Rules: empty_key, repeated_key, empty_label (none, or a
    blank among them), repeated_label, unexpected, missing.
    """
    stem = F.regexp_replace(F.regexp_extract(F.trim("sample"), r"([^/]*)$", 1), r"\.parquet$", "")
    known = expected.select(*keys, F.trim("sample").alias("wanted"), stem.alias("stem"))
    names = known.select(*keys, "wanted", F.explode(F.array_distinct(F.array("wanted", F.regexp_replace("wanted", r"\.parquet$", ""), "stem"))).alias("name"))
    n = parts(answers, expected, expected, expected)
    names = names.repartition(n, *keys, "name").distinct()  # dealt as the join needs them, once
    labels = F.transform(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.trim(x))
    own_rules = {
        "named": F.trim("sample") != "",
        "empty_key": F.coalesce(F.trim("sample"), F.lit("")) == "",
        "empty_label": (F.size(labels) == 0) | F.exists(labels, lambda x: x.isNull() | (x == "")),
        "repeated_label": F.size(F.array_distinct(labels)) < F.size(labels),
    }
    # what is said of an answer alone travels as bits; both uses of `own` below need the same columns, so Spark shuffles them once
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(own_rules.values())), F.lit(0)).cast("tinyint")
    bit = lambda rule: F.col("bits").bitwiseAND(1 << list(own_rules).index(rule)) != 0
    own = answers.select(*keys, F.trim("sample").alias("name"), bits.alias("bits")).repartition(n, *keys, "name").join(names, [*keys, "name"], "left").withColumn("sample", F.coalesce("wanted", "name"))
    rules = F.array(*(F.when(bit(r), r) for r in ("empty_key", "empty_label", "repeated_label")), F.when(bit("named") & F.col("wanted").isNull(), "unexpected"))
    each = own.select(*keys, F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"), "sample")
    given = own.select(*keys, "sample", bit("named").cast("int").alias("named"), F.lit(1).alias("own"))
    every = given.unionByName(known.select(*keys, F.col("wanted").alias("sample"), F.lit(0).alias("named"), F.lit(0).alias("own")))
    counts = every.repartition(n, *keys, "sample").groupBy(*keys, "sample").agg(F.sum("named").alias("named"), F.sum("own").alias("own"), F.min("own").alias("least"))
    no_key = F.exists(F.array(*(F.col(c).isNull() for c in (*keys, "sample"))), lambda x: x)  # what is null equals nothing
    of_sample = F.array(F.when(F.col("named") > 1, "repeated_key"), F.when((F.col("least") == 0) & ((F.col("own") == 0) | no_key), "missing"))
    return each.unionByName(counts.select(*keys, F.explode(F.filter(of_sample, lambda r: r.isNotNull())).alias("rule"), "sample"))
