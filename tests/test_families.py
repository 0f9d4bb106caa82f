"""Families' sets against plain versions."""

from pyspark.sql import functions as F

from runweave.operators import families


def test_others_of_more_than_a_hundred_thousand_values(spark):
    """The selection had a most of 100,000 values."""
    selected = spark.range(120_000).union(spark.range(5)).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    used = spark.range(120_000).where("id % 3 <> 0").select(F.lit(1).alias("row"), "id").union(spark.sql("SELECT NULL, 7L")).union(spark.sql("SELECT 2, NULL"))
    got = {r.row: (r.n, r.total) for r in families.others(selected, used, ["row"], "id").groupBy("row").agg(F.count("id").alias("n"), F.sum("id").alias("total")).collect()}
    every = sum(range(120_000))
    assert got == {1: (40_000, sum(range(0, 120_000, 3))), None: (119_999, every - 7), 2: (120_000, every)}
