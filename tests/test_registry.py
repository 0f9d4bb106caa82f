"""Noise streams, decimation and registries on small cases."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from runweave.operators import decimate, noise, registry

# A signal, and its noise by stream.
SIGNAL = [0.0, 0.2, 0.5, 0.3, -0.1, -0.4, -0.2, 0.0, 0.15]
RUN_NOISE = [0.01103272520170869, 0.044054096541523015, 0.0028098914505021878, 0.021100103856411912, 0.021360717922579014, -0.005287461437602594, -0.04401803855339957, 0.03448045529926511, -0.0062360496707766205]
ADAPTIVE_AND_BASE = [0.017583303361920568, 0.07056093606996873, 0.00453992184072524, 0.034287668766669346, 0.034711166624190895, -0.008592124836104213, -0.07093902930633098, 0.05533062453952819, -0.010331140972289437]
PROFILE = [-8.671969003017965e-05, 0.20025589433534516, 0.49929502099304685, 0.29953453159400045, -0.09930669515166021, -0.39843066723051573, -0.19921322117507614, -0.0009293093884867926, 0.15050324080468575]
RUN_ID = "39711d03a0eedb1f48101ab254dd3597"


def signal(spark, values=SIGNAL):
    return spark.createDataFrame([(RUN_ID, "Velocity", i, v) for i, v in enumerate(values)], "run_id string, signal string, t long, value double")


def noise_of(spark, sigma, values=SIGNAL):
    seed = noise.stream_seed(F.lit("run:demo:mass_velocity"), F.lit(17))
    drawn = noise.draw(noise.levels(signal(spark, values), ["run_id"], "t"), ["run_id"], "t", "noise", sigma, seed)
    return [r.noise for r in drawn.orderBy("t").collect()]


def test_noise_streams(spark):
    assert noise_of(spark, noise.adaptive_sigma(0.08)) == pytest.approx(RUN_NOISE, rel=1e-9)
    assert noise_of(spark, noise.adaptive_sigma(0.12, 0.05)) == pytest.approx(ADAPTIVE_AND_BASE, rel=1e-9)


def test_noise_profile(spark):
    assert spark.range(1).select(noise.run_seed(7, F.lit(RUN_ID))).first()[0] == 3872734430
    noisy = noise.apply_profile(signal(spark), "run_id", "signal", "t", 0.001, 0.001, 0.0007, 7)
    assert [r.noisy for r in noisy.orderBy("t").collect()] == pytest.approx(PROFILE, rel=1e-9)


def test_missing_samples_draw_nothing(spark):
    full = noise_of(spark, noise.global_sigma(1.0), [1.0, 1.0, 1.0])
    holes = noise_of(spark, noise.global_sigma(1.0), [1.0, None, float("nan"), 1.0, 1.0])
    assert [holes[i] for i in (0, 3, 4)] == pytest.approx(full) and holes[1:3] == [0.0, 0.0]


@pytest.mark.parametrize("step, n, rate, want", [(0.01, 21, 20.0, [5, 10, 15, 20]), (0.01, 5, 500.0, [0, 1, 2, 3, 4]), (1.0, 1, 0.5, [])])
def test_decimation(spark, step, n, rate, want):
    df = spark.createDataFrame([(1, round(i * step, 9), float(i)) for i in range(n)], "run_id int, t double, v double")
    planned = decimate.plan(df, ["run_id"], "t", rate)
    assert sorted(r.pos for r in planned.where("picked").collect()) == want


def test_signed_peaks_keep_the_first_of_ties(spark):
    values = [0.0, 3.0, -3.0, None, 1.0, -2.0]
    df = spark.createDataFrame([(1, i / 2, v) for i, v in enumerate(values)], "run_id int, t double, v double")
    peaks = decimate.signed_peaks(decimate.plan(df, ["run_id"], "t", 1.0), ["run_id"], "v")
    assert [(r.pos, r.v) for r in peaks.orderBy("block").collect()] == [(2, -3.0), (4, -2.0)]


def test_status(spark):
    planned = spark.createDataFrame([(i, "A") for i in range(6)], "run_id int, hash string")
    runtime = spark.createDataFrame([(1, "success", "a"), (2, "success", "b"), (3, "success", None), (4, "failed", "a"), (5, "", "a")], "run_id int, status string, runtime_hash string")
    have = spark.createDataFrame([(0,), (1,), (2,), (4,), (5,)], "run_id int")
    got = [(r.status, r.stale_reason) for r in registry.with_status(planned, runtime, have).orderBy("run_id").collect()]
    assert got == [("success", None), ("success", None), ("not_run", "hash_mismatch"), ("not_run", "missing_data"), ("failed", None), ("success", None)]


def test_match_once(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert registry.match_once(left, one, ["k"]).count() == 2
    for bad in (one.where("k = 1"), one.union(one)):
        with pytest.raises(PySparkException):
            registry.match_once(left, bad, ["k"]).collect()
