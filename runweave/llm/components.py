"""Connected components of a table of links, by alternating stars (large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """(high, low): every neighbour that is larger (large) or else smaller is tied to the smallest neighbour, or to the node itself."""
    if large:
        sides = links.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(links.select(F.col("low").alias("u"), F.col("high").alias("v")))
    else:
        sides = links.select(F.col("high").alias("u"), F.col("low").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = sides.join(least, F.col("u") == F.col("w"))
    if large:
        tied = joined.where("v > u").select(F.col("v").alias("high"), F.col("m").alias("low"))
    else:
        tied = joined.select(F.col("v").alias("high"), F.col("m").alias("low")).unionByName(least.select(F.col("w").alias("high"), F.col("m").alias("low")))
    return tied.where("high <> low").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each node with a link; the component is its smallest node. links: two columns of one type, no nulls."""
    a, b = links.columns
    now = materialise(links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).where("high <> low").distinct())
    seen = None
    while True:
        now = materialise(_stars(_stars(now, large=True), large=False))
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first()
        if state == seen:
            break
        seen = state
    lows = now.groupBy("high").agg(F.min("low").alias("component"))
    roots = now.select(F.col("low").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return lows.select(F.col("high").alias("node"), "component").unionByName(roots)
