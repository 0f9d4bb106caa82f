"""Loading and checks of runs, expressions, samples and contracts on small tables; matching against brute force."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from runweave.functions import scalars as S
from runweave.operators import align, classify, contracts, families, loading, registry, sampling
from runweave.plans import catalog
from runweave.sources import runs

SF = "/root/testdata/sf0.001"


def test_columns_of_frames():
    assert loading.signal_columns(["Time", "a", "b", "IDX"]) == ["a", "b"]
    assert loading.signal_columns(["a", "b", "time"], {"x": "continuous", "y": "impulse_like"}) == ["a", "b"]
    assert loading.time_column(["a", "Timestamp", "time"]) == "time"
    assert loading.time_column(["a", "b", "c"], 2) == "c" and loading.time_column(["a", "b"]) is None
    assert loading.flat_names([("a", "b"), "('a', 'b')", "time_s", "x", "x", "x"]) == ["a - b", "a - b (2)", "time", "x", "x (2)", "x (3)"]


def test_time_first_and_anonymous_names(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, `time (s)` double")
    assert loading.time_first(df).columns == ["time", "a"]
    assert loading.anonymise(df).columns == ["col1", "col2"]


@pytest.mark.parametrize(("text", "want"), [("a + b * 2", 7.0), ("a == 1 && b ~= 3", 0.0), ("!(a > 2) || b", 1.0), ("a .^ 2 ./ b", 1 / 3), ("a / (b - 3)", None), ("-a % 3", 2.0), ("max(a, b) - min(a, b)", 2.0), ("a == 1 + 1e-13", 1.0), ("1 < a + 1 <= 2", 1.0), ("true", 1.0)])
def test_expressions(spark, text, want):
    got = spark.createDataFrame([(1, 3)], "a int, b int").select(S.expression(text, ["a", "b"]).alias("x")).first().x
    assert got == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize("text", ["c + 1", "__import__('os')", "a.b", "a if b else 1", "[a]", "a +", "'x'", "open(a)"])
def test_what_no_expression_may_hold(text):
    with pytest.raises(ValueError):
        S.expression(text, ["a", "b"])


def test_expressions_in_a_circle(spark):
    with pytest.raises(ValueError, match="circle"):
        S.evaluated(spark.createDataFrame([(1,)], "a int"), {"x": "y + a", "y": "x"})


def test_runs_of_folders(spark, tmp_path):
    layout = runs.Layout(str(tmp_path))
    frame = spark.createDataFrame([(0.0, 1.0), (1.0, 2.0)], "time double, x double").coalesce(1)
    for run in ("r1", "r2"):
        frame.withColumn("x", F.lit(float(run[1]))).write.parquet(layout.data("m", run))
    frame.toPandas().to_parquet(f"{tmp_path}/r2.parquet")
    (tmp_path / "m" / "bundles").mkdir()
    for run in ("r2", "r3"):
        frame.toPandas().assign(x=9.0).to_parquet(f"{layout.bundles('m')}/{run}.parquet")
    (tmp_path / "m" / "runs" / "bad").mkdir()
    (tmp_path / "m" / "runs" / "bad" / "data.csv").write_text("time,x\n0,1\nsoon,2\n")
    assert runs.load_run(spark, layout.run("m", "r1")).count() == 2
    assert runs.load_run(spark, layout.run("m", "bad")) is None and runs.load_run(spark, layout.run("m", "none")) is None
    got = {(r.run_id, r.x) for r in spark.read.parquet(f"{layout.bundles('m')}/*.parquet").select(runs.run_id_of(F.col("_metadata.file_path")).alias("run_id"), "x").collect()}
    assert got == {("r2", 9.0), ("r3", 9.0)}
    every = {(r.run_id, r.x) for r in runs.scan_runs(spark, layout.runs("m"), layout.bundles("m")).collect()}
    assert every == {("r1", 1.0), ("r2", 2.0), ("r3", 9.0)}
    df = spark.createDataFrame([("r1", "runs", 1), ("r1", "bundle", 2), ("r2", "bundle", 3)], "run_id string, source string, x int")
    assert sorted(r.x for r in runs.preferred(df, ["run_id"], "source", ["runs", "bundle"]).collect()) == [1, 3]
    assert runs.locate(df.withColumn("model", F.col("source")), "r1") == "bundle" and runs.locate(df.withColumn("model", F.col("source")), "r9") is None


def test_small_documents_are_put_in_place_whole(tmp_path):
    path = str(tmp_path / "a" / "x.json")
    runs.write_json({"b": 1, "a": "é"}, path)
    assert list(json.load(open(path, encoding="utf-8"))) == ["a", "b"]
    with pytest.raises(TypeError):
        runs.write_json({"b": object()}, path)
    assert json.load(open(path, encoding="utf-8"))["b"] == 1 and len(list((tmp_path / "a").iterdir())) == 1


def test_lite_parts(spark):
    q = spark.createDataFrame([(k, f"l{k % 2}") for k in range(20)], "id int, label string")
    part = spark.createDataFrame([(k // 2, k) for k in range(40)], "id int, x int")
    chosen, kept, counts = runs.lite(q, {"part": part}, "id", 5, 3, "label")
    ids = {r.id for r in chosen.collect()}
    assert len(ids) == 5 and {r.id for r in kept["part"].collect()} == ids and sum(r.n for r in counts.collect()) == 5


def test_events_are_matched_as_one_by_one(spark):
    rng = random.Random(4)
    rows = [(u, rng.choice("ab"), rng.randrange(0, 400), float(rng.choice([-3, -2, -1, 1, 2, 3]))) for u in range(6) for _ in range(40)]
    rows += [(7, "a", 5, 1.0), (8, "b", 5, 1.0)]
    df = spark.createDataFrame(rows, "run_id int, side string, t long, value double")
    for r in classify.match_events(df, ["run_id"], 6).collect():
        a, b = (sorted((t, v) for u, s, t, v in rows if u == r.run_id and s == side) for side in "ab")
        scale, used, loss, n = max([abs(v) for _, v in a] or [1.0]), set(), 0.0, 0
        order_a = sorted(((t, i) for i, (u, s, t, v) in enumerate(rows) if u == r.run_id and s == "a"))
        assert len(order_a) == len(a)
        if len({t for t, _ in a}) == len(a) and len({t for t, _ in b}) == len(b):  # without ties the order is one
            for t, v in a:
                free = [(-abs(w), abs(s - t), i) for i, (s, w) in enumerate(b) if i not in used and abs(s - t) <= 6]
                if free:
                    i = min(free)[2]
                    used.add(i)
                    loss += abs(b[i][0] - t) / 6 + abs(abs(v) - abs(b[i][1])) / scale
                    n += 1
            lost = len(a) + len(b) - 2 * n
            assert (r.matched, r.unmatched, r.loss) == (n, lost, pytest.approx(loss + lost))


def test_warping_of_channels_against_the_full_table():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(9, 2)), rng.normal(size=(7, 2))
    for band in (None, 2, 3):
        width = 9 if band is None else max(band, 2)
        cost = np.full((10, 8), np.inf)
        cost[0, 0] = 0
        for i in range(1, 10):
            for j in range(1, 8):
                if abs(i - j) <= width:
                    cost[i, j] = ((a[i - 1] - b[j - 1]) ** 2).sum() + min(cost[i - 1, j], cost[i, j - 1], cost[i - 1, j - 1])
        assert classify.dtw(a, b, band) == pytest.approx(cost[9, 7])
        assert classify.dtw(a, b, band, cost[9, 7] * 0.5) == np.inf and classify.dtw(a, b, band, cost[9, 7] * 1.01) == pytest.approx(cost[9, 7])


def test_lag_distance_by_hand():
    x = np.array([0.0, 1, 0, -1, 0, 1, 0, -1])[:, None]
    assert classify.lag_distance(x, np.roll(x, 1, 0), 2) == pytest.approx(0, abs=1e-9)
    assert classify.lag_distance(x, np.zeros_like(x), 2) == 1.0
    assert classify.lag_distance(np.hstack([x, x * 0]), np.hstack([x, x]), 0) == pytest.approx(0.5)


def test_families_are_unique_wherever_they_can_be(spark):
    rows = [(1, lab, f, i) for i, (lab, f) in enumerate([("a", 1), ("a", 2), ("b", 1), ("c", 2), ("c", 3)])] + [(2, "a", 1, 9), (2, "b", 1, 8), (2, "c", 2, 7)]
    df = spark.createDataFrame(rows, "seed int, label string, family int, id int")
    got = sampling.unique_families(df, ["seed"], "label", "family", "id", "seed", 3).collect()
    assert {(r.seed, r.label, r.family) for r in got} == {(1, "a", 2), (1, "b", 1), (1, "c", 3)}


def test_samples_of_unique_families_over_orders(spark):
    got = catalog.queries()["unique_family_samples"](spark, SF).collect()
    o = {r.o_orderkey: (r.o_orderpriority, r.o_custkey) for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    for seed in (11, 12, 13):
        own = [r for r in got if r.seed == seed]
        assert len({r.label for r in own}) == len({r.family for r in own}) == 5 and all(o[r.id] == (r.label, r.family) for r in own)


def test_selectors_say_what_is_missing(spark):
    q = spark.createDataFrame([("q1", "r1", "s1")], "question string, row string, shot string")
    with pytest.raises(ValueError, match="one of"):
        registry.questions(q, question="q1", row="r1")
    with pytest.raises(ValueError, match="no row"):
        registry.questions(q, row="r2")
    children = spark.createDataFrame([("h1", "mass")], "hash string, parameter string")
    with pytest.raises(ValueError, match="h2"):
        registry.compared(children, ["h2"], ["mass"])
    signals = spark.createDataFrame([("x", "continuous"), ("y", "impulse_like")], "signal string, type string")
    assert [r.signal for r in registry.selected_signals(signals, ["y", "x"]).orderBy("place").collect()] == ["y", "x"]
    assert [r.signal for r in registry.selected_signals(signals, ["y", "x"], impulses=True).collect()] == ["y"]
    for asked in (["z"], ["x", "x"]):
        with pytest.raises(ValueError, match="unknown or repeated"):
            registry.selected_signals(signals, asked)
    with pytest.raises(ValueError, match="no signal"):
        registry.selected_signals(signals, ["x"], impulses=True)


def test_runtime_entries_and_results(spark):
    good = ("Success ", "0" * 32, "01234567-89ab-cdef-0123-456789abcdef")
    df = spark.createDataFrame([good, ("done", *good[1:]), (good[0], "0" * 31, good[2]), (good[0], good[1], "x"), (None, *good[1:])], "status string, hash string, id string")
    got = [r.s for r in df.select(contracts.entry_state(F.col("status"), F.col("hash"), F.col("id")).alias("s")).collect()]
    assert got == ["success"] + ["malformed"] * 4
    table = spark.createDataFrame([(1, "a", "m", "0.5"), (2, "a", "n", "1.5"), (3, "", "m", "x")], "k int, agent string, model string, acc string")
    faults = {(r.k, r.rule) for r in contracts.results_faults(table, ["k"], ["agent"], ["acc"], spark.createDataFrame([("a", "m")], "agent string, model string")).collect()}
    assert faults == {(2, "metric acc"), (2, "pair"), (3, "metric acc"), (3, "empty agent"), (3, "pair")}
    with pytest.raises(ValueError, match="missing"):
        contracts.results_faults(table, ["k"], ["shot"], [], table.select("agent"))
    rules = contracts.threshold_rules(F.col("t"), F.col("s"))
    m = spark.sql("SELECT 1 AS k, map('x', 0.5D) AS t, map('x', 'continuous') AS s UNION ALL SELECT 2, map('x', -1D), map('x', 'other')")
    assert {(r.k, r.rule) for r in contracts.broken(m, rules, ["k"]).collect()} == {(2, "thresholds"), (2, "types")}
    assert [r.a for r in m.select(contracts.known_keys(F.col("t"), ["x"]).alias("a")).collect()] == [True, True]


def test_registry_fields_by_name(spark):
    specs = spark.createDataFrame([("a",), ("b",)], "id string")
    run = spark.createDataFrame([("a", " Failed", "h", None), ("z", "success", None, 1)], "id string, status string, host string, code int")
    got = {r.id: (r.status, r.fields) for r in registry.merged(specs, run, "id").collect()}
    assert got == {"a": ("failed", {"host": "h"}), "b": ("not_run", None)}
    with pytest.raises(Exception, match="verdict"):
        registry.failed_children(spark.createDataFrame([(1, 2, "maybe", "yes")], "family int, child int, vs_baseline string, vs_time0 string"), "family").collect()
    m = spark.sql("SELECT map('a', 1) AS p UNION ALL SELECT map('a', CAST(NULL AS INT)) UNION ALL SELECT map('a', 1, 'b', 2)")
    assert [r.r for r in m.select(registry.runnable(F.col("p")).alias("r")).collect()] == [True, False, False]


def test_inferers_by_model(spark):
    known = families.Inferers()
    known.add("pendulum", lambda run, least: "swings" if run.value.max() > least else "rests", ("least",))
    df = spark.createDataFrame([(1, 0, 5.0), (1, 1, 1.0), (2, 0, 0.5)], "run_id int, t int, value double")
    got = {r.run_id: r.predictions for r in known.apply("pendulum", df, ["run_id"], "t", least=2.0).collect()}
    assert got == {1: ["swings"], 2: ["rests"]}
    for call, why in ((lambda: known.apply("pendulum", df, ["run_id"], "t"), "needs"), (lambda: known.apply("other", df, ["run_id"], "t"), "no inferer"), (lambda: known.add("pendulum", len), "has an")):
        with pytest.raises(ValueError, match=why):
            call()


def test_support_sets_are_bounded_and_balanced(spark, monkeypatch):
    s = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [2.0])], "run_id int, label string, values array<double>")
    assert families.balanced_support(s, "label") and not families.balanced_support(s.unionByName(s.where("run_id = 1")), "label")
    monkeypatch.setattr(classify, "MOST_SUPPORT", 1)
    with pytest.raises(ValueError, match="at most 1"):
        classify.support_row(s)
    flat = spark.createDataFrame([(3, "", [1.0, 2.0])], "run_id int, label string, values array<double>")
    shots = spark.createDataFrame([(1, "flat", [1.0, 1.0]), (2, "up", [1.0, 3.0])], "run_id int, label string, values array<double>")
    monkeypatch.setattr(classify, "MOST_SUPPORT", 10)
    r = classify.pairs(flat, shots).select("s_label", classify.truncated_pearson(F.col("values"), F.col("s_values")).alias("r")).collect()
    assert {(x.s_label, x.r) for x in r} == {("flat", float("-inf")), ("up", 1.0)}


def test_greedy_matches_of_a_dense_run():
    """Each event looked at all within reach: 20,000 events in reach of one another took minutes."""
    import time

    rng = np.random.default_rng(8)
    for _ in range(40):
        a, b = ([int(x) for x in np.sort(rng.integers(0, 60, int(rng.integers(0, 40))))] for _ in "ab")
        va, vb = ([float(x) for x in rng.integers(-3, 4, len(x))] for x in (a, b))
        used, loss, n = set(), 0.0, 0
        for t, v in zip(a, va, strict=True):
            free = [(-abs(w), abs(s - t), i) for i, (s, w) in enumerate(zip(b, vb, strict=True)) if i not in used and abs(s - t) <= 7]
            if free:
                i = min(free)[2]
                used.add(i)
                loss, n = loss + abs(b[i] - t) / 7 + abs(abs(v) - abs(vb[i])) / 3, n + 1
        assert classify.greedy_matches(a, va, b, vb, 7, 3.0) == (n, pytest.approx(loss))
    began, many = time.monotonic(), list(range(20_000))
    assert classify.greedy_matches(many, [1.0] * 20_000, many, [float(x % 50) for x in many], 30_000, 50.0)[0] == 20_000
    assert time.monotonic() - began < 10


def test_strategies_leave_signals_spread(spark):
    """Rows meet their signal's strategy where they are: no shuffle puts all rows of a signal into one task (F8)."""
    df = spark.createDataFrame([(1, "a", 5, 1.0), (1, "a", 35, 3.0), (1, "b", 5, -2.0), (1, "b", 45, 4.0)], "run_id long, signal string, t long, value double")
    strategies = spark.createDataFrame([("a", "decimation", "interpolation"), ("b", "abs_max_pooling", "zero_filling")], "signal string, binning string, filling string")
    out = loading.resample(df, strategies, 10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(signal#\d+, \d+\)", plan)
    got = sorted((r.signal, r.bin, r.value) for r in out.collect())
    assert got == [("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, -2.0), ("b", 2, 0.0), ("b", 3, 0.0)]
    with pytest.raises(ValueError):
        loading.resample(df, spark.range(loading.MOST_SIGNALS + 1).selectExpr("string(id) AS signal", "'decimation' AS binning", "'zero_filling' AS filling"), 10)


def planned(df):
    """Numbers of parts that ids are dealt into."""
    return set(re.findall(r"hashpartitioning\((?:id|child)#\d+L?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString()))


def test_parts_of_truth_rows_grow(spark, monkeypatch):
    """A task's share of ids is bounded by rows, as ids that compress well say little by their bytes (F10)."""
    monkeypatch.setattr(align, "PART_ROWS", 10)
    children = spark.range(60).selectExpr("id % 7 AS family", "id AS child", "IF(id % 3 = 0, id + 1000, NULL) AS time0", "'p' AS parameter")
    first = children.selectExpr("child", "child % 5 <> 0 AS eligible", "1.0D AS change_time").where("child < 50")
    families = children.selectExpr("family", "-family AS baseline").distinct()
    chosen = spark.range(-5, 2000).unionByName(spark.range(40)).where("id % 2 = 0")
    out = registry.truth_rows(families, children, first, chosen)
    assert planned(out) == {"11"}
    got = sorted((r.id, r.kind, r.change_time) for r in out.collect())
    kept = [c for c in range(60) if c >= 50 or c % 5]
    assert got == sorted([(-f, "baseline", None) for f in (0, 2, 4)] + [(c, "child", 1.0 if c < 50 else None) for c in kept if c % 2 == 0] + [(c + 1000, "time0", 0.0) for c in kept if c % 3 == 0 and c % 2 == 0], key=lambda r: r[:2])


def test_parts_of_graph_faults_grow(spark, monkeypatch):
    """One pass over nodes and ends, whose tasks are bounded by rows (F12); ids that are null are no nodes."""
    monkeypatch.setattr(align, "PART_ROWS", 10)
    nodes = spark.createDataFrame([("a", "F"), ("a", "O"), ("b", "x"), (None, "F"), (None, "F")], "id string, kind string")
    edges = spark.createDataFrame([("a", "b")] * 30 + [("b", "c"), (None, "c")], "source string, target string")
    faults = contracts.graph_faults(nodes, edges, ["F", "O"])
    assert planned(faults) == {"7"}
    assert sorted((r.id or "", r.rule) for r in faults.collect()) == [("", "missing_end"), ("", "repeated"), ("a", "repeated"), ("b", "kind"), ("c", "missing_end")]
