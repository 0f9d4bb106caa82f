"""Event sessions over a stream: the batch operator with a watermark, but for gaps that are exactly `gap`, which end a chain here. An extension of ours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_sessions(stream: DataFrame, key: str, time: str, value: str, gap: str, late: str) -> DataFrame:
    """(key, begin, end, events, peak) of each chain of events whose gaps are under `gap`; events later than `late` are dropped.

    peak: the signed value of the largest magnitude, the first of equal ones, as the batch operator has it.
    """
    chains = stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("chain"))
    peak = F.min(F.struct((-F.abs(value)).alias("m"), F.col(time).alias("t"), F.col(value).alias("v")))["v"]
    return chains.agg(F.count(F.lit(1)).alias("events"), peak.alias("peak")).select(key, F.col("chain.start").alias("begin"), F.col("chain.end").alias("end"), "events", "peak")
