"""Lookups of runs, states and questions on odd rows, and JSON that any reader takes."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from runweave.operators import context, logs


def test_child_contexts(spark):
    runtime = spark.createDataFrame([("A ", "Intervention", " SUCCESS"), ("b", "intervention", "failed"), ("c", "baseline", "success"), ("d", "intervention", "success"), ("e", "intervention", "success"), ("f", "intervention", "success"), (None, "intervention", "success")], "id string, run_type string, status string")
    one, none = {"mass": 2.0, "drag": None}, {"mass": None}
    specs = spark.createDataFrame([("B2", "a", one, "Z", 1.5, {"k": 1.0}), ("B1", " a", one, None, 2.5, None), ("B", "d", {"x": 1.0, "y": 1.0}, "", 1.0, {}), ("B", "e", none, "", 1.0, {}), ("B", "f", {" mass ": 1.0}, "", math.inf, {})], "baseline string, child string, parameters map<string,double>, time0 string, time double, baseline_parameters map<string,double>")
    asked = spark.createDataFrame([(x,) for x in ("a", "A", "b", "c", "d", "e", "f", "gone", None)], "child string")
    got = {r.child: r for r in context.child_contexts(specs, runtime, asked).collect()}
    assert {k: r.fault for k, r in got.items()} == {"a": None, "b": "not successful", "c": "no intervention", "d": "not one parameter", "e": "not one parameter", "f": "no time", "gone": "no runtime entry", None: "no runtime entry"}
    a = got["a"]
    assert (a.baseline, a.time0, a.parameter, a.set_value, a.time, a.baseline_parameters, a.runtime.id) == ("b1", None, "mass", 2.0, 2.5, None, "A ")
    assert all(r.baseline is None and r.runtime is None for k, r in got.items() if k != "a")
    assert context.child_contexts(specs.limit(0), runtime).where("fault IS NULL").count() == 0


def test_states_keep_only_what_the_registry_has(spark):
    registry = spark.createDataFrame([("b", "c", "z"), ("b2", " ", None), (None, "c2", "b")], "baseline string, child string, time0 string")
    states = spark.createDataFrame([(1, ["z", "b", "x", "b", " c"], ["c", "b2"], {"b": 1, "x": 2}), (2, [], None, {})], "user int, runs array<string>, rows array<string>, times map<string,int>")
    got = {r.user: r for r in context.sanitised(states, registry, "user", {"runs": "run", "rows": "baseline", "times": "baseline"}).collect()}
    assert (got[1].runs, got[1].rows, got[1].times) == (["z", "b", "b", " c"], ["b2"], {"b": 1})
    assert (got[2].runs, got[2].rows, got[2].times) == ([], [], {})


def test_questions(spark):
    rows = spark.createDataFrame([("", "UCR", None), (None, "anomaly_x", "v_many_shot"), ("change_point_detection", "ucr_a", "one_shot"), (None, None, ""), ("classification", None, "a_few_shot")], "task string, name string, variant string")
    got = [tuple(r) for r in rows.select(context.kind_of_question(F.col("task"), F.col("name")), context.has_shots(F.col("variant"))).collect()]
    assert got == [("classification", False), ("anomaly", True), ("anomaly", False), ("other", False), ("classification", True)]


def test_json_of_any_type(spark):
    schema = "d double, f float, a array<struct<x:double,y:string>>, m map<int,array<float>>, b binary, t timestamp, day date, n int"
    when = dt.datetime(2024, 1, 2, 3, 4, 5)
    df = spark.createDataFrame([(math.nan, math.inf, [(1.5, "q"), (-math.inf, None), None], {1: [math.nan, 2.0]}, b"ab", when, when.date(), 3), (None,) * 8], schema)
    one, two = (json.loads(r[0]) for r in df.select(context.as_json(df)).collect())
    assert one == {"d": None, "f": None, "a": [{"x": 1.5, "y": "q"}, {"x": None, "y": None}, None], "m": {"1": [None, 2.0]}, "b": "YWI=", "t": "2024-01-02T03:04:05.000000Z", "day": "2024-01-02", "n": 3}
    assert two == dict.fromkeys(one)


def test_averages_need_steps(spark):
    df = spark.createDataFrame([("s", 4, 10, 20, None)], "session string, steps int, prompt int, cached int, completion int")
    assert tuple(logs.token_averages(df).first()) == ("s", 30, 0, 7.5, 0.0)
    with pytest.raises(Exception, match="no steps: s"):
        logs.token_averages(df.withColumn("steps", F.lit(0))).collect()
