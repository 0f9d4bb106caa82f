"""Pruned search under warping against all distances, and adversarial draws against plain versions."""

import numpy as np
import pytest

from runweave.operators import classify, sampling, warping
from runweave.plans import tuning


@pytest.fixture(scope="module")
def runs():
    rng = np.random.default_rng(8)
    out = []
    for k in range(24):
        n = int(rng.integers(1, 20))
        base = np.sin(np.linspace(0, 3 + k % 3, n))[:, None] * [1, -1] + rng.normal(0, 0.1, (n, 2))
        out.append((k, k % 3, base.round(1 if k < 12 else 6)))
    return out + [(90, 1, out[0][2].copy()), (91, 2, out[0][2].copy())]


@pytest.mark.parametrize(("window", "most"), [(None, 3), (0, 1), (1, 2), (4, 5), (30, 40)])
def test_pruned_neighbours_are_those_of_all_distances(spark, runs, window, most):
    df = spark.createDataFrame([(k, f"l{c}", x.ravel().tolist()) for k, c, x in runs], "run_id long, label string, values array<double>")
    queries = df.union(spark.createDataFrame([(500, "l0", [0.1, 0.2, 0.3, 0.1])], df.schema)).repartition(3)
    rows = warping.warped_nearest(queries, df.where("run_id % 2 = 0 OR run_id > 80"), most, window, 2).collect()
    support = [r for r in runs if r[0] % 2 == 0 or r[0] > 80]
    for key, x in [(k, x) for k, _, x in runs] + [(500, np.array([[0.1, 0.2], [0.3, 0.1]]))]:
        every = sorted((classify.dtw(x, y, None if not window else window - 1) ** 0.5, k) for k, _, y in support if k != key)
        got = sorted((r.distance, r.s_id) for r in rows if r.run_id == key)
        assert [k for _, k in got] == [k for _, k in every[:most]] and np.allclose([d for d, _ in got], [d for d, _ in every[:most]])
    share = sum({r.run_id: r.computed for r in rows}.values()) / (len(support) * 27)
    assert share < 0.5 if most == 1 else share <= 1


def test_bounds_are_never_over_the_distance():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.normal(size=(int(rng.integers(1, 12)), 2)) for _ in range(2))
        band = max(int(rng.integers(0, 5)), abs(len(a) - len(b)))
        assert warping.outside(a, *warping.envelope(b, band, len(a))) <= classify.dtw(a, b, band) + 1e-9


def test_windows_are_tuned_as_with_all_distances(spark, runs):
    df = spark.createDataFrame([(k, c, x.ravel().tolist()) for k, c, x in runs], "run_id long, label int, values array<double>")
    pairs = classify.pairs(df, df)
    every = classify.distances_by("dtw", pairs, 0, 2).unionByName(classify.distances_by("dtw", pairs, 3, 2))
    want = classify.tuned(every, df.select("run_id", "label"), [1, 3]).collect()
    got = warping.tuned_windows(df, [0, 3], [1, 3], 2).collect()
    assert {(r.setting, r.k, r.correct, r.place) for r in got} == {(r.setting, r.k, r.correct, r.place) for r in want}
    with pytest.raises(ValueError, match="neighbours"):
        warping.tuned_windows(df, [0], [0, 1], 2)


def test_a_large_support_is_an_error(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [2.0])], "run_id long, label string, values array<double>")
    monkeypatch.setattr(warping, "MOST_SUPPORT_BYTES", 8)
    with pytest.raises(ValueError, match="support"):
        warping.warped_nearest(df, df, 1)


def test_adversarial_draws(spark):
    rng = np.random.default_rng(6)
    n, x = 60, rng.normal(size=(60, 5))
    label = [f"l{k % 3}" for k in range(n)]
    z = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    square = lambda v: ((v[:, None] - v[None]) ** 2).mean(2)
    d, e = square(x), square(z)
    pairs = spark.createDataFrame([(a, b, float(d[a, b]), float(e[a, b])) for a in range(n) for b in range(a + 1, n)], "a_id int, b_id int, mse double, z_mse double")
    held = {s: [k for k in range(n) if (k * 7 + s) % 5 == 0] for s in range(6)}
    test = spark.createDataFrame([(s, label[k], k) for s, own in held.items() for k in own], "seed int, label string, id int")
    pool = spark.createDataFrame([(s, label[k], k) for s, own in held.items() for k in range(n) if k not in own], "seed int, label string, id int")

    def scores(seed, train):
        own = np.array(train)
        names = np.array(label)[own]
        means = np.array([x[own[names == c]].mean(0) for c in ("l0", "l1", "l2")])
        says = [names[d[k, own].argmin()] for k in held[seed]], [names[e[k, own].argmin()] for k in held[seed]], [f"l{((x[k] - means) ** 2).mean(1).argmin()}" for k in held[seed]]
        return [np.mean([s == label[k] for s, k in zip(said, held[seed], strict=True)]) for said in says]

    m = sampling.adversarial_manifests(pool, test, pairs, ["seed"], "label", "id", "seed", 2, margin=0.05, attempts=30, waves=(2, 5))
    got = {r.seed: r for r in m.collect()}
    assert got and max(r.attempt for r in got.values()) >= 2
    for seed in held:
        import hashlib

        first = None
        for attempt in range(30):
            order = lambda k: (hashlib.md5(f"{seed}::{attempt}::{k}".encode()).hexdigest(), k)  # noqa: B023, E731
            train = [k for c in ("l0", "l1", "l2") for k in sorted((k for k in range(n) if k not in held[seed] and label[k] == c), key=order)[:2]]
            if max(scores(seed, train)) <= 1 / 3 + 0.05 * 2 / 3:
                first = attempt, sorted(map(str, train)), max(scores(seed, train))
                break
        assert (first is None) == (seed not in got)
        if first:
            assert (got[seed].attempt, got[seed].train) == first[:2] and np.isclose(got[seed].best, first[2])
            assert got[seed].test == sorted(map(str, held[seed]))
    none = sampling.adversarial_manifests(pool, test, pairs, ["seed"], "label", "id", "seed", 2, margin=-1.0, attempts=3, waves=(2,))
    assert none.count() == 0
    short = sampling.adversarial_manifests(pool, test, pairs, ["seed"], "label", "id", "seed", 50, attempts=2)
    assert short.count() == 0


def test_narrow_and_wide_bands_agree(monkeypatch):
    rng = np.random.default_rng(12)
    cases = [(rng.normal(size=int(rng.integers(1, 30))), rng.normal(size=int(rng.integers(1, 30))), [None, 0, 1, 3, 9][k % 5]) for k in range(60)]
    narrow = [classify.dtw(*c) for c in cases]
    monkeypatch.setattr(classify, "NARROW", 0)
    assert np.allclose(narrow, [classify.dtw(*c) for c in cases])
    monkeypatch.setattr(classify, "NARROW", 1_000)
    for c, d in zip(cases, narrow, strict=True):
        assert classify.dtw(*c, d * 1.01 + 1e-9) == pytest.approx(d) and classify.dtw(*c, d * 0.5) >= d * (1 - 1e-9)


def test_pairs_are_warped_together_as_one_by_one():
    rng = np.random.default_rng(5)
    for k in range(120):
        n, m, channels = int(rng.integers(1, 40)), int(rng.integers(1, 40)), 1 + k % 2
        a, b = rng.normal(size=(n, channels, 7)), rng.normal(size=(m, channels, 7))
        band = [0, 1, 3, 9, 100][k % 5]
        want = np.array([classify.dtw(a[..., p], b[..., p], band) for p in range(7)])
        assert np.allclose(warping.dtw_of_pairs(a, b, band, np.full(7, np.inf)), want)
        best = want * rng.choice([0.3, 1.01], 7)
        got = warping.dtw_of_pairs(a, b, band, best)
        assert np.allclose(got[best > want], want[best > want]) and (got[best <= want] >= best[best <= want]).all()
    a[3 % n] = np.nan
    assert np.isinf(warping.dtw_of_pairs(a, b, band, np.full(7, np.inf))).all()


def test_many_queries_take_few_steps(monkeypatch):
    rng = np.random.default_rng(6)
    held, queries = [rng.normal(size=(16, 1)) for _ in range(20)], rng.normal(size=(16, 1, 500))
    calls, plain = [], warping.dtw_of_pairs
    monkeypatch.setattr(warping, "dtw_of_pairs", lambda a, b, band, best: calls.append(a.shape[2]) or plain(a, b, band, best))
    best, place, computed = warping.Support(list(range(20)), ["x"] * 20, held, 4).nearest(list(range(500)), queries, 3)
    assert len(calls) < 20 and sum(calls) == computed.sum() <= 500 * 20
    for q in range(0, 500, 25):
        every = sorted((classify.dtw(queries[..., q], y, 3), k) for k, y in enumerate(held) if k != q)[:3]
        assert [k for _, k in every] == place[q].tolist() and np.allclose([d for d, _ in every], best[q])


def test_neighbours_are_looked_for_once(spark):
    plan = tuning.warped_nearest(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_queries_without_values_have_no_neighbours(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [2.0, 3.0])], "run_id long, label string, values array<double>")
    queries = spark.createDataFrame([(3, []), (4, None), (5, [2.0, None]), (6, [2.0]), (1, [4.0, 5.0])], "run_id long, values array<double>").repartition(1)
    rows = sorted((r.run_id, r.s_id, r.s_label, r.distance) for r in warping.warped_nearest(queries, df, 2).collect())
    assert rows == [(1, 2, "b", 8**0.5), (6, 1, "a", 1.0), (6, 2, "b", 1.0)]
