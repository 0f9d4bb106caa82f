"""Draws against plain versions."""

import hashlib

from pyspark.sql import functions as F

from runweave.operators import sampling


def test_first_seeded_is_that_of_the_sorted_group(spark, monkeypatch):
    rows = [(g, k) for g, n in (("a", 3000), ("b", 2), (None, 400)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, id long").withColumn("seed", F.lit(3))
    key = lambda k: (hashlib.md5(f"3::{k}".encode()).hexdigest(), k)
    want = {(g, k) for g, n in (("a", 3000), ("b", 2), (None, 400)) for k in sorted(range(n), key=key)[:5]}
    for groups in (10, 0):  # bounds are broadcast, or joined
        monkeypatch.setattr(sampling, "FEW_GROUPS", groups)
        found = sampling.first_seeded(df, ["g"], "id", F.col("seed"), 5)
        got = [(r.g, r.id) for r in found.collect()]
        assert set(got) == want and len(got) == 12 and found.columns == ["g", "id", "seed"]


def test_draws_sort_few_rows_of_a_large_group(spark):
    """The window over a draw had every row of its group."""
    df = spark.range(200_000).select(F.lit("x").alias("label"), F.lit(1).alias("seed"), "id")
    assert 3 <= sampling.near_front(df, ["seed", "label"], "id", F.col("seed"), 3).count() < 1_000
    assert sampling.stratified(df, ["seed"], "label", "id", "seed", 3).count() == 3
