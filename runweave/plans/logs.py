"""Queries over event logs: conversations as agent trajectories, pages and documents as texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources import tables
from .kernels import q

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


@query("interactions_by_source", "SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS users, count(*) FILTER (WHERE role = 'assistant') AS assistants, count(*) FILTER (WHERE role = 'system') AS systems, count(*) FILTER (WHERE role = 'system') = 0 AS valid FROM conversations GROUP BY conv_id")
def interactions(spark, d):
    n = lambda r: F.count_if(F.col("role") == r)
    return tables.table(spark, d, "conversations").groupBy("conv_id").agg(n("user").alias("users"), n("assistant").alias("assistants"), n("system").alias("systems"), (n("system") == 0).alias("valid"))


@query("renumbered_steps", "WITH u AS (SELECT *, max(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS last FROM conversations) SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM u WHERE turn >= last")
def renumbered(spark, d):
    """Steps from the last one of the user on, numbered from 1."""
    own = Window.partitionBy("conv_id")
    u = tables.table(spark, d, "conversations").withColumn("last", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(own))
    return u.where("turn >= last").select("conv_id", "turn", F.row_number().over(own.orderBy("turn")).cast("long").alias("step"))


@query("step_durations", "WITH s AS (SELECT user_id, ts, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS us FROM events) SELECT user_id, count(us) AS steps, sum(us)::BIGINT AS total_us, min(us) < 0 AS broken FROM s GROUP BY user_id")
def durations(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts"))
    return tables.table(spark, d, "events").withColumn("us", us).groupBy("user_id").agg(F.count("us").alias("steps"), F.sum("us").alias("total_us"), (F.min("us") < 0).alias("broken"))


@query("text_counters", "SELECT conv_id, turn, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) AS lines, strlen(coalesce(text, ''))::BIGINT AS bytes, array_to_string(string_split(coalesce(text, ''), ' ')[1:5], ' ') AS opening FROM conversations")
def counters(spark, d):
    text = F.coalesce("text", F.lit(""))
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    return tables.table(spark, d, "conversations").select("conv_id", "turn", lines.cast("long").alias("lines"), F.octet_length(text).cast("long").alias("bytes"), F.array_join(F.slice(F.split(text, " "), 1, 5), " ").alias("opening"))


@query("cost", f"WITH t AS (SELECT l_orderkey AS k, sum(l_quantity) AS prompt, sum(l_quantity * l_discount) AS cached, sum(l_linenumber) AS completion FROM lineitem GROUP BY 1) SELECT k, {q('((prompt - cached) * 3.0 + cached * 0.3 + completion * 15.0) / 100')} AS cost FROM t")
def cost(spark, d):
    """Cost of a run from its tokens; those in the cache are part of the prompt and cheaper."""
    t = tables.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("prompt"), F.sum(F.col("l_quantity") * F.col("l_discount")).alias("cached"), F.sum("l_linenumber").alias("completion"))
    return t.select("k", X.scaled(((F.col("prompt") - F.col("cached")) * 3.0 + F.col("cached") * 0.3 + F.col("completion") * 15.0) / 100).alias("cost"))


@query("tool_calls", "WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations) SELECT word, count(*) AS calls, count(DISTINCT conv_id) AS conversations FROM w GROUP BY word")
def tool_calls(spark, d):
    w = tables.table(spark, d, "conversations").select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("conv_id").alias("conversations"))


@query("tool_calls_every_word", "WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations) SELECT word, count(*) AS calls, count(DISTINCT conv_id) AS conversations FROM w GROUP BY word")
def tool_calls_every_word(spark, d):
    w = tables.table(spark, d, "conversations").select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("conv_id").alias("conversations"))


@query("alternation_check", "WITH l AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, count(*) FILTER (WHERE role = before) AS repeats, max(turn) + 1 = count(*) AS dense FROM l GROUP BY conv_id")
def alternation(spark, d):
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return tables.table(spark, d, "conversations").withColumn("before", before).groupBy("conv_id").agg(F.count_if(F.col("role") == F.col("before")).alias("repeats"), (F.max("turn") + 1 == F.count(F.lit(1))).alias("dense"))


@query("event_properties", "SELECT event_type, count(*) AS n, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS most, count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) AS kinds FROM events GROUP BY event_type")
def properties(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return tables.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max(k).alias("most"), F.count_distinct(k).alias("kinds"))
