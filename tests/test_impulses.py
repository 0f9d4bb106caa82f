"""Thinning and verdicts against plain versions on small runs."""

import random

import numpy as np

from runweave.operators import impulses


def heads(rows, parts):
    return [p[0] for p in np.array_split(rows, parts) if len(p)] if parts > 0 else []


def thinned(keep, length):
    """Places that stay, one run after the other's rules, without Spark."""
    n = len(keep)
    every = list(range(n))
    if n <= length:
        return sorted(every + every[: length - n])
    kept = [i for i in every if keep[i]]
    left = length - len(kept)
    if left <= 0:
        return heads(kept, length)
    aims = {round(j * (n - 1) / (left + 1)) for j in range(1, left + 1)}
    hit = [i for i in sorted(aims) if not keep[i]]
    pool = [i for i in every if not keep[i] and i not in aims]
    return sorted(kept + hit + heads(pool, left - len(hit)))


def test_thinning_matches_plain_version(spark):
    rng = random.Random(3)
    runs = {k: [i in (0, n - 1) or rng.random() < share for i in range(n)] for k, (n, share) in enumerate([(1, 0), (2, 0), (7, 0.2), (9, 0.1), (10, 0.5), (25, 0.1), (40, 0.6), (63, 0.05), (100, 0.02), (101, 0.3)])}
    rows = [(k, i, keep) for k, run in runs.items() for i, keep in enumerate(run)]
    df = spark.createDataFrame(rows, "run int, pos int, keep boolean")
    for length in (5, 9, 16):
        found = {}
        for r in impulses.thin(df, ["run"], "pos", length).collect():
            found.setdefault(r.run, []).append(r.pos)
        assert {k: sorted(v) for k, v in found.items()} == {k: list(map(int, thinned(run, length))) for k, run in runs.items()}


def test_verdict_without_losses_or_truth(spark):
    rows = [(1, "a", 0.1, "a", 1.0), (1, "b", 0.5, "a", 1.0), (2, "a", None, "a", 1.0), (3, "b", 0.2, "a", 0.0), (4, "a", float("nan"), "a", 1.0), (4, "b", 0.1, "a", 1.0)]
    df = spark.createDataFrame(rows, "child int, parameter string, loss double, truth string, baseline double")
    found = {r.child: r for r in impulses.verdicts(df, "child", 0.5, 0.5).collect()}
    assert sorted(found) == [1, 3, 4]  # the second has no usable loss
    assert found[1].is_match and found[1].rank == 1 and abs(found[1].gain - 0.9) < 1e-12
    assert (found[3].best, found[3].rank, found[3].gain, found[3].gap, found[3].is_match) == ("b", None, 0.0, None, False)
    assert found[4].rank is None and not found[4].is_match


def test_empty_table(spark):
    df = spark.createDataFrame([], "run int, pos int, value double")
    k = impulses.kept_around(impulses.jumps(df, ["run"], "pos"), ["run"], "pos", impulses.F.col("jump") > 8, 5)
    assert impulses.thin(k, ["run"], "pos", 4).count() == 0
