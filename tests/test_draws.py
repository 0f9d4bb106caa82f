"""Draws of sequential generators, dataset descriptors, noise of two streams, rules, models' noise, run folders."""

import hashlib
import json
import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from runweave.operators import draws, noise, plugins
from runweave.sources import descriptors, files

#: What NumPy's generator of seed 3 gives for eight, and Python's of seed 5.
PERMUTATION_OF_8_BY_3 = [6, 7, 2, 1, 4, 5, 3, 0]
SHUFFLED_BY_5 = ["b1", "b4", "b6", "b7", "b0", "b5", "b2", "b3"]


def test_generators(spark):
    ids = [f"b{k}" for k in range(8)]
    df = spark.createDataFrame([(m, i, k) for m in "xy" for k, i in enumerate(ids)], "model string, id string, k int").repartition(3)
    got = draws.permuted(df, ["model"], "id", 3).orderBy("model", "place").collect()
    assert [r.id for r in got] == [ids[k] for k in PERMUTATION_OF_8_BY_3] * 2
    got = draws.permuted(df.withColumn("seed", F.length("model") + 2), ["model"], "id", "seed").where("model = 'x'").orderBy("place").collect()
    assert [r.id for r in got] == [ids[k] for k in PERMUTATION_OF_8_BY_3]
    want = list(reversed(ids))
    random.Random(5).shuffle(want)
    assert want == SHUFFLED_BY_5
    got = draws.shuffled(df.withColumn("k", -F.col("k")), ["model"], "id", "k", 5).where("model = 'y'").orderBy("place").collect()
    assert [r.id for r in got] == want
    rows = draws.folds(df, ["model"], "id", 3, 3).where("model = 'x'").collect()
    parts = [[ids[k] for k in part] for part in np.array_split(PERMUTATION_OF_8_BY_3, 3)]
    assert [sorted(r.id for r in rows if r.fold == k) for k in range(3)] == [sorted(p) for p in parts]
    with pytest.raises(Exception, match="8 families for 9 folds"):
        draws.folds(df, ["model"], "id", 9, 1).collect()
    with pytest.raises(ValueError, match="two folds"):
        draws.folds(df, ["model"], "id", 1, 1)


def test_chosen_goes_on_from_label_to_label(spark):
    pool = [(m, "ba"[k % 2], k) for m in ("m", "n") for k in range(12)] + [("short", "a", 1)]
    df = spark.createDataFrame(pool, "model string, label string, id int")
    got = draws.chosen(df, ["model"], "label", "id", 3, "model").collect()
    assert draws.generator_seed("m", 7) == int.from_bytes(hashlib.sha256(b"m::7").digest()[:8], "big")
    for m in ("m", "n"):
        rng, want = np.random.default_rng(draws.generator_seed(m)), []
        for label in "ab":
            own = sorted(i for x, y, i in pool if (x, y) == (m, label))
            want += [(label, own[k]) for k in rng.choice(len(own), size=3, replace=False)]
        assert sorted((r.label, r.id) for r in got if r.model == m) == sorted(want)
    assert not [r for r in got if r.model == "short"]


def test_descriptor_round_trips(spark, tmp_path):
    folder = tmp_path / "env"
    for k in range(2):
        df = pd.DataFrame({"time": [0.0, 1.0], "x": np.array([1, 2], "int32"), "on": [True, False], "name": ["a", "b"]})
        (folder / "dataframes").mkdir(parents=True, exist_ok=True)
        df.to_parquet(folder / "dataframes" / f"r{k}.parquet")
    (folder / "questions.json").write_text(json.dumps({"label_int_mapping": {"mass": 1, "no change": 0}, "questions": {}}))
    (folder / "model_record.json").write_text("x" * (descriptors.CHUNK + 5))
    document = json.loads(json.dumps(descriptors.describe_dataset(spark, str(folder), "e/")))
    assert descriptors.faults(document) == []
    assert {f["name"]: f.get("sha256") for f in document["distribution"]} == {n: hashlib.sha256((folder / n).read_bytes()).hexdigest() for n in ("questions.json", "model_record.json")} | {"parquet-files": None}
    series, questions, _ = document["recordSet"]
    assert [(f["name"], f["dataType"]) for f in series["field"]] == [("run_uuid", "sc:Text"), ("time", "sc:Float"), ("x", "sc:Integer"), ("on", "sc:Boolean"), ("name", "sc:Text")]
    assert [f["name"] for f in questions["field"] if f.get("repeated")] == ["allowed_labels"]
    assert [tuple(r) for r in descriptors.labels_of(spark, document).orderBy("integer_id").collect()] == [("no change", 0), ("mass", 1)]
    document["recordSet"][2]["data"][0]["e/labels/integer_id"] = 1
    document["recordSet"][1]["@id"] = "e/labels"
    document["recordSet"][0]["field"][1]["source"]["fileSet"]["@id"] = "gone"
    assert descriptors.faults(document) == ["repeated: e/labels", "missing: gone", "repeated key of e/labels"]


def test_noise_of_two_streams(spark):
    values = [float(np.sin(k)) for k in range(30)]
    df = spark.createDataFrame([("r", s, t, v) for s in ("u", "v") for t, v in enumerate(values)], "run_id string, signal string, t int, value double")
    rules = noise.Rules(5, 0.1)
    noisy = noise.apply_streams(df, "run_id", "signal", "t", 0.2, {"u": 0.3, "v": float("nan")}, 4, rules)
    assert noisy.columns == [*df.columns, "noisy"]

    def alone(key, share, signal):
        own = noise.levels(df.where(F.col("signal") == signal), ["run_id"], "t", window=5)
        drawn = noise.draw(own, ["run_id"], "t", "noise", noise.adaptive_sigma(share, floor=0.1), noise.stream_seed(F.lit(f"{key}:{signal}"), F.lit(4)))
        return np.array([r.noise for r in drawn.orderBy("t").collect()])

    got = {s: np.array([r.noisy - r.value for r in noisy.where(F.col("signal") == s).orderBy("t").collect()]) for s in "uv"}
    assert np.allclose(got["u"], alone("run", 0.2, "u") + alone("signal", 0.3, "u")) and np.allclose(got["v"], alone("run", 0.2, "v"))
    assert noise.apply_streams(df, "run_id", "signal", "t").where("noisy <> value").count() == 0


@pytest.mark.parametrize(("text", "window", "floor"), [(None, 11, 1e-4), ("[1]", 11, 1e-4), ("no", 11, 1e-4), ('{"rolling_window_points": 8, "sigma_floor_ratio": 0.5}', 9, 0.5), ('{"rolling_window_points": 0, "sigma_floor_ratio": "x"}', 11, 1e-4), ('{"rolling_window_points": "7"}', 7, 1e-4), ('{"sigma_floor_ratio": NaN}', 11, 1e-4)])
def test_noise_rules(text, window, floor):
    assert noise.rules_of(text) == noise.Rules(window, floor)


def exports(**changed):
    def add_noise(src, seed, noise_level, ref):
        return src.assign(value=src["value"] + seed + (0 if ref is None else ref["value"].iloc[0])), {"level": noise_level, "n": len(src)}

    own = {"NOISE_DICT": {"low": 1, "high": 2}, "SNR_THR_DICT": {p: {"global": [1], "local": []} for p in ("low", "high")}, "quantify_noise": lambda clean, noisy, reference: {}, "add_noise": add_noise}
    return SimpleNamespace(**{**own, **changed})


def test_models_noise(spark):
    runs = spark.createDataFrame([(m, r, t, 1.0 * t) for m, r in (("m", "a"), ("n", "b")) for t in range(3)], "model string, run_id string, t int, value double")
    reference = spark.createDataFrame([("m", "a", 0, 10.0)], runs.schema)
    models = {"m": exports(), "n": exports()}
    got = plugins.apply_noise(runs, reference, ["model", "run_id"], "t", models, " LOW", 5)
    assert sorted((r.run_id, r.t, r.value, r.analysis) for r in got.collect()) == [(k, t, t + 5.0 + 10 * (k == "a"), '{"level": "low", "n": 3}') for k in "ab" for t in range(3)]
    same = plugins.apply_noise(runs, reference, ["model", "run_id"], "t", models, None, 5)
    assert sorted(map(tuple, same.drop("analysis").collect())) == sorted(map(tuple, runs.collect()))
    with pytest.raises(Exception, match="no noise for model n"):
        plugins.apply_noise(runs, reference, ["model", "run_id"], "t", {"m": exports()}, "high", 5).collect()
    with pytest.raises(ValueError, match="profile"):
        plugins.profile_of("loud")
    for changed in ({"NOISE_DICT": {"low": 1}}, {"SNR_THR_DICT": {"low": {}}}, {"add_noise": lambda src, seed: None}, {"quantify_noise": 1}):
        with pytest.raises(TypeError, match="m: "):
            plugins.checked_noise("m", exports(**changed))


def test_run_folders(spark, tmp_path):
    run = tmp_path / "run"
    (run / "errors").mkdir(parents=True)
    (run / "errors" / "val_errors.json").write_text(json.dumps([{"dataset_index": 3, "sample_id": "s", "true_label": 1, "pred_label": "x"}]))
    (run / "errors" / "test_errors.json").write_text('{"no": "list"')
    (run / "errors" / "other.json").write_text("[]")
    got = files.read_run_predictions(spark, str(run)).collect()
    assert [(r.split, r.dataset_index, r.sample_id, r.true_label, r.pred_label, r.epoch) for r in got] == [("val", "3", "s", "1", None, None)]
    (run / "predictions").mkdir()
    (run / "predictions" / "epoch_best_test.csv").write_text("sample_id,pred_label\nq,2\n")
    got = files.read_run_predictions(spark, str(run)).collect()
    assert [(r.split, r.epoch, r.sample_id) for r in got] == [("test", "best", "q")]
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "note.txt").write_text("x")
    assert files.read_run_predictions(spark, str(empty)).count() == 0
