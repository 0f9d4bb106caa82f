"""Pair distances by blocks and the best separated choice against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from runweave.operators import pairs


@pytest.fixture(scope="module")
def runs():
    rng = np.random.default_rng(5)
    out = []
    for family, n in (("f", 9), ("g", 1), ("h", 4)):
        for run in range(n):
            start = None if run == 2 else int(rng.integers(0, 6))
            for signal in ("u", "v")[: 1 + (run != 3)]:
                for pos in range(8):
                    if rng.random() < 0.9:
                        value = [None, math.nan, float(rng.normal())][int(rng.choice(3, p=[0.05, 0.05, 0.9]))]
                        out.append((family, run, signal, pos, value, start))
    return out


def plain(rows):
    by = {}
    for family, run, signal, pos, value, start in rows:
        by.setdefault((family, run), ({}, []))[0][signal, pos] = math.nan if value is None else value
        by[family, run][1].append((start, pos))
    begin = {k: (v[1][0][0] if v[1][0][0] is not None else max(p for _, p in v[1])) for k, v in by.items()}
    out = {}
    for (f, a), (g, b) in itertools.combinations(sorted(by), 2):
        if f == g:
            names = {s for own, _ in (x for k, x in by.items() if k[0] == f) for s, _ in own}
            for s in names:
                d = [(x - by[g, b][0].get((s, p), math.nan)) ** 2 for (t, p), x in by[f, a][0].items() if t == s and p >= min(begin[f, a], begin[g, b])]
                d = [x for x in d if x == x]
                out[f, a, b, s] = sum(d) / len(d) if d else None
    return out


@pytest.mark.parametrize("block", [1, 2, 64])
def test_pairwise_mse(spark, runs, block):
    df = spark.createDataFrame(runs, "family string, run_id long, signal string, pos int, value double, start int").repartition(3)
    found = pairs.pairwise_mse(df, "family", "start", "signal", block)
    rows = found.collect()
    got, want = {(r.family, r.a_id, r.b_id, r.signal): r.mse for r in rows}, plain(runs)
    want = {k: v for k, v in want.items() if v is not None or k in got}
    assert len(rows) == len(got) and {k: v for k, v in got.items() if v is not None}.keys() == {k for k, v in want.items() if v is not None}
    assert all(math.isclose(v, want[k]) for k, v in got.items() if v is not None)
    means = {(r.family, r.a_id, r.b_id): r.mse for r in pairs.over_signals(found, "family").collect()}
    for k, v in means.items():
        own = [x for (*key, _), x in want.items() if tuple(key) == k and x is not None]
        assert v is None if not own else math.isclose(v, sum(own) / len(own))
    assert pairs.pairwise_mse(df.limit(0), "family").count() == 0


def brute(distances, labels):
    """First of the best choices, over lists of runs by label."""
    best = None
    for choice in itertools.product(*(sorted(own) for own in labels)):
        d = [distances.get((min(x), max(x))) for x in itertools.combinations(choice, 2)]
        d = [x for x in d if x is not None and math.isfinite(x)]
        if d and (best is None or (-min(d), choice) < best):
            best = (-min(d), choice)
    return best


def test_best_separated_choice_is_that_of_all_choices(spark):
    rng = np.random.default_rng(11)
    rows, names, want = [], [], {}
    for family in range(25):
        sizes = rng.integers(1, 5, int(rng.integers(1, 6)))
        ids = [int(x) for x in rng.permutation(100)[: sizes.sum()]]
        labels = [ids[a:b] for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True)]
        distances = {}
        for x in itertools.combinations(sorted(ids), 2):
            d = float(rng.integers(0, 8)) if rng.random() < 0.9 else [None, math.inf, math.nan][int(rng.integers(3))]
            distances[x] = d
            if d is not None or rng.random() < 0.5:
                rows.append((family, *x, d))
        names += [(family, r, f"l{k}") for k, own in enumerate(labels) for r in own]
        best = brute(distances, labels)
        if best:
            want[family] = best
    names += [(0, 999, None)]
    p, r = spark.createDataFrame(rows, "family int, a_id long, b_id long, mse double"), spark.createDataFrame(names, "family int, run_id long, label string")
    got = pairs.best_separated_choice(p, r, "family", "label").collect()
    assert {x.family: (-x.separation, tuple(x.choice)) for x in got} == want and len(got) == len(want)
    every = pairs.separation(pairs.every_choice(r, "family", "label"), p, "family").where("separation IS NOT NULL").collect()
    best = {}
    for x in every:
        best[x.family] = min(best.get(x.family, (0, ())), (-x.separation, tuple(x.choice)), key=lambda v: (v == (0, ()), v))
    assert best == want


def test_a_choice_of_many_labels_is_found_without_listing(spark):
    """Ten labels of thirty runs have 30 ** 10 choices. One run of each label is planted far from all others' planted ones."""
    rng = np.random.default_rng(2)
    label = {r: r // 30 for r in range(300)}
    planted = {30 * k + int(rng.integers(30)) for k in range(10)}
    rows = [(1, a, b, 5.0 + float(rng.random()) if {a, b} <= planted else float(rng.random() * 8)) for a, b in itertools.combinations(range(300), 2) if label[a] != label[b]]
    least = min(d for _, a, b, d in rows if {a, b} <= planted)
    p = spark.createDataFrame(rows, "family int, a_id int, b_id int, mse double")
    r = spark.createDataFrame([(1, k, v) for k, v in label.items()], "family int, run_id int, label int")
    best = pairs.best_separated_choice(p, r, "family", "label").collect()[0]
    assert best.separation >= least and [label[x] for x in best.choice] == list(range(10))
    assert min(d for _, a, b, d in rows if {a, b} <= set(best.choice)) == best.separation


def test_wanted_pairs_are_those_of_all_pairs(spark, runs):
    """Draws of samples needed the distances of all pairs."""
    own = [(run, pos, value) for family, run, signal, pos, value, _ in runs if family == "f" and signal == "u"]
    df = spark.createDataFrame(own, "run_id long, pos int, value double").repartition(3)
    every = pairs.pairwise_mse(df.selectExpr("0 AS family", "*"), "family").collect()
    want = {(r.a_id, r.b_id): r.mse for r in every}
    wanted = [(0, 1), (1, 8), (2, 3), (0, 99)]
    got = {(r.a_id, r.b_id): r.mse for r in pairs.wanted_mse(df, spark.createDataFrame(wanted, "a_id long, b_id long")).collect()}
    assert got.keys() == set(wanted) and got[0, 99] is None
    assert all(got[k] == pytest.approx(want[k]) for k in wanted[:3])


@pytest.mark.parametrize("block", [2, 8192])
def test_extremes_are_those_of_all_pairs(spark, runs, block, monkeypatch):
    """The extremes of a family needed a row for each of its pairs."""
    monkeypatch.setattr(pairs, "TILE", 3)
    rng = np.random.default_rng(3)
    whole = [("w", run, pos, 1e4 + float(v), 2) for run, own in enumerate(rng.normal(size=(25, 6))) for pos, v in enumerate(own)]
    whole += [("x", *row[1:]) for row in whole] + [("x", row[1] + 100, *row[2:]) for row in whole if row[1] % 5 == 0]
    gaps = [(family, run, pos, value, start) for family, run, signal, pos, value, start in runs if signal == "u"]
    df = spark.createDataFrame(whole + gaps, "family string, run_id long, pos int, value double, start int").repartition(3)
    want = {r.family: (r.n, r.a, r.b) for r in pairs.pairwise_mse(df, "family", "start").selectExpr("family", "nanvl(mse, NULL) AS mse").groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("mse").alias("a"), F.max("mse").alias("b")).collect()}
    got = {r.family: (r.pairs, r.least, r.most) for r in pairs.pairwise_extremes(df, "family", "start", block).collect()}
    assert got == want and got["x"][1] == 0 and set(got) == {"f", "h", "w", "x"}
