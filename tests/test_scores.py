"""Scores, ratios, batches and answers on odd rows."""

import math
import re

import pytest
from pyspark.sql import functions as F

from runweave.operators import scores


def test_by_sample_type(spark):
    rows = spark.createDataFrame([("r", " test", True, 0.5, 2.0), ("r", "test", None, None, math.nan), ("r", "test", False, 1.0, None), ("q", None, True, 1.0, 1.0)], "run string, sample_type string, top1_correct boolean, shortlist_score double, num_answers double")
    got = {(r.run, r.sample_type): (r.top1, r.shortlist, r.answers) for r in scores.by_sample_type(rows, ["run"], ["test", "train"]).collect()}
    assert got == {("r", "test"): (1 / 3, 0.5, 2.0), ("r", "train"): (0, 0, 0), ("q", "test"): (0, 0, 0), ("q", "train"): (0, 0, 0)}


def test_of_evaluable(spark):
    stats = spark.createDataFrame([(1.0, 4), (None, 2), (3.0, 0), (3.0, None)], "correct_count double, evaluable_count int")
    assert [r[0] for r in stats.select(*scores.of_evaluable(stats, ["correct_count", "other"])).collect()] == [0.25, 0, 0, 0]


@pytest.mark.parametrize(("delta", "base", "ratio"), [([1.0, -3.0], [1.0, -2.0], 2.0), ([0.0], [0.0], 0.0), ([0.5], [0.0], math.inf), ([1.0], [math.inf], 0.0), ([math.inf], [2.0], math.inf), ([math.nan, 2.0], [1.0, math.nan], 2.0), ([1.0], [math.nan], 0.0)])
def test_signal_ratio(spark, delta, base, ratio):
    df = spark.createDataFrame([("k", d, b) for d, b in zip(delta, base, strict=True)], "k string, d double, b double")
    assert scores.signal_ratio(df, ["k"], F.col("d"), F.col("b")).first().ratio == ratio


def test_batches_must_be_whole(spark):
    df = spark.createDataFrame([("a", k) for k in range(6)], "key string, k int")
    assert [r.batch for r in scores.batched(df, ["key"], "k", 3).orderBy("k").collect()] == [0, 0, 0, 1, 1, 1]
    with pytest.raises(Exception, match="4 must divide the number of samples, 6"):
        scores.batched(df, ["key"], "k", 4).collect()
    assert [r.batch for r in scores.batched(df, ["key"], "k", 4, whole=False).orderBy("k").collect()] == [0, 0, 0, 0, 1, 1]


def test_answer_faults(spark):
    expected = spark.createDataFrame([("q", "d/a.parquet"), ("q", "b.parquet"), ("q", "c"), ("q", " e ")], "k string, sample string")
    answers = [("a", ["x"]), ("d/a", ["x"]), ("b", []), ("c.parquet", ["x"]), ("e", ["x", " x"]), (" ", ["x"]), (None, None), ("z", ["", "y"])]
    df = spark.createDataFrame([("q", *a) for a in answers], "k string, sample string, labels array<string>")
    got = sorted((r.rule, r.sample or "") for r in scores.answer_faults(df, expected, ["k"]).collect())
    assert got == [("empty_key", ""), ("empty_key", ""), ("empty_label", ""), ("empty_label", "b.parquet"), ("empty_label", "z"), ("missing", "c"), ("repeated_key", "d/a.parquet"), ("repeated_label", "e"), ("unexpected", "c.parquet"), ("unexpected", "z")]


def test_answers_meet_their_names_once(spark, monkeypatch):
    """Both uses of the answers with their samples read one shuffle of the names, dealt by numbers of rows (F15)."""
    monkeypatch.setattr("runweave.operators.align.PART_ROWS", 3)
    df = spark.createDataFrame([(1, "a", ["x"]), (1, "d/a.parquet", ["x", " x"]), (1, None, []), (2, "z", ["y", None]), (2, "b.parquet", ["y"])], "k int, sample string, labels array<string>")
    expected = spark.createDataFrame([(1, "d/a.parquet"), (1, "d/a.parquet"), (1, "c"), (1, None), (2, "b")], "k int, sample string")
    found = scores.answer_faults(df, expected, ["k"])
    got = sorted((r.k, r.rule, r.sample or "") for r in found.collect())
    assert got == [(1, "empty_key", ""), (1, "empty_label", ""), (1, "missing", ""), (1, "missing", "c"), (1, "repeated_key", "d/a.parquet"), (1, "repeated_label", "d/a.parquet"), (2, "empty_label", "z"), (2, "missing", "b"), (2, "unexpected", "b.parquet"), (2, "unexpected", "z")]
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") >= 1 and {r[1] for r in re.finditer(r"hashpartitioning\(k#\d+, name#\d+, (\d+)\)", plan)} == {"7"}
