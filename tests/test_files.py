"""Files around the runs, and users' functions over runs."""

import json

import pandas as pd
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runweave.operators import plugins
from runweave.sources import files


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "ä\n")], "b int, a string")
    files.write_json_lines(df, f"{tmp_path}/x")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/x").collect()) == ['{"a":"ä\\n","b":2}', '{"a":null,"b":1}']
    (tmp_path / "y.jsonl").write_text('{"a": "1", "b": 1}\n\n  \n{"b": 2}\n')
    assert sorted(tuple(r) for r in files.read_json_lines(spark, f"{tmp_path}/y.jsonl", "b int, a string").collect()) == [(1, "1"), (2, None)]
    for bad in ("[1]", '{"a": '):
        (tmp_path / "z.jsonl").write_text(bad + "\n")
        with pytest.raises((PySparkException, Py4JJavaError)):
            files.read_json_lines(spark, f"{tmp_path}/z.jsonl", "b int, a string").collect()


def test_folders(spark, tmp_path):
    p = tmp_path / "predictions"
    p.mkdir()
    (p / "epoch_best_val.csv").write_text("id,score\n1,0.5\n")
    (p / "epoch_12_test.csv").write_text("id,score\n2,0.25\n")
    (p / "notes.csv").write_text("id,score\n3,1\n")
    assert sorted((r.id, r.epoch, r.split) for r in files.read_predictions(spark, str(tmp_path)).collect()) == [("1", "best", "val"), ("2", "12", "test")]
    assert [r.id for r in files.newest_file(spark.read.option("header", True).csv(f"{p}/epoch*.csv")).collect()] == ["1"]
    for name, text in (("a", '{"run_id": "r1"}'), ("b", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata_task.json").write_text(text)
    rows, errors = files.read_metadata(spark, str(tmp_path), StructType().add("run_id", "string"))
    assert [r.run_id for r in rows.collect()] == ["r1"] and [r.text for r in errors.collect()] == ["{broken"]


def test_grid(spark, tmp_path):
    head = "type_of_request,desc_level,noise_level,number_train_samples_per_class,number_test_samples,is_adversarial,seeds,test_set_slug,shot_slug,row_slug\n"
    (tmp_path / "g.csv").write_text(head + 'direct,low,none,3,10,true,"[0, 1]",t,s,one\ncode,low,none,3,10,,"[2]",t,s,two\ncode,low,none,3,10,,"[2]",t,s,two\n')
    one = files.read_grid(spark, f"{tmp_path}/g.csv", ["one"]).collect()
    assert [(r.row_slug, r.seeds, r.is_adversarial) for r in one] == [("one", [0, 1], True)]
    with pytest.raises(PySparkException):
        files.read_grid(spark, f"{tmp_path}/g.csv").collect()


def test_metrics_bundles_and_descriptions(spark, tmp_path):
    old = spark.createDataFrame([(None, 0.5, "x"), (0.25, None, "y")], "metric_accuracy double, accuracy double, agent_name string")
    new = spark.createDataFrame([("z", 1.0, 2)], "agent_name string, metric_accuracy double, n int")
    assert sorted(tuple(r) for r in files.aligned_metrics(old, new).select("agent_name", "metric_accuracy").collect()) == [("x", 0.5), ("y", 0.25), ("z", 1.0)]
    samples = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, v int")
    files.export_bundle(samples, samples.where("run_id = 'b'"), f"{tmp_path}/bundle")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/bundle").select("run_id", "v").collect()] == [("b", 2)]
    fields, digests = files.describe(spark, f"{tmp_path}/bundle/run_id=b")
    assert fields == [{"name": "v", "type": "int"}] and all(len(r.sha256) == 64 for r in digests.collect())


def runs(spark):
    return spark.createDataFrame([(1, 1, 5.0), (1, 0, 2.0), (2, 0, float("nan"))], "run_id int, pos int, value double")


@pytest.mark.parametrize("said, want", [("a", ["a"]), (["a", "b"], ["a", "b"]), ({"final_answer": " a ", "change_time": 2}, ["a"])])
def test_answers(said, want):
    assert plugins.answer_of(said, {"a", "b"})[0] == want


@pytest.mark.parametrize("said", ["", [], "c", ["a", "a"], [1], {}])
def test_answers_that_are_errors(said):
    with pytest.raises((ValueError, KeyError)):
        plugins.answer_of(said, {"a", "b"})


def test_failing_rules_are_results(spark):
    def predict(run):
        if run.value.isna().any():
            raise RuntimeError("no data")
        return "up" if run.value.iloc[-1] > run.value.iloc[0] else "down"

    rows = plugins.apply_rule(runs(spark), ["run_id"], "pos", predict, {"up", "down"}).orderBy("run_id").collect()
    assert [(r.predictions, r.error) for r in rows] == [(["up"], None), ([], "RuntimeError: no data")]


def test_features_and_references(spark):
    rows = plugins.apply_features(runs(spark), ["run_id"], "pos", lambda run: {"last": run.value.iloc[-1]}).orderBy("run_id").collect()
    assert [r.features for r in rows] == [{"last": 5.0}, {"last": None}]
    reference = spark.createDataFrame([(1, 0, 1.0), (3, 0, 1.0)], "run_id int, pos int, value double")
    beside = plugins.apply_beside(runs(spark), reference, ["run_id"], "pos", lambda a, b: pd.DataFrame({"n": [len(a)], "m": [len(b)]}), "n long, m long")
    assert sorted(tuple(r) for r in beside.collect()) == [(1, 2, 1), (2, 1, 0)]
    assert json.loads(spark.range(1).select(files.canonical(spark.range(1))).first()[0]) == {"id": 0}
    assert beside.where(F.col("n") > 5).count() == 0
