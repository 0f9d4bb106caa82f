"""Queries that look up what belongs to a run, a candidate, a question or a reader's state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import context, logs
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


@query("child_contexts", f"""WITH r AS (SELECT 'O' || o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'baseline' ELSE ' Intervention' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'Success ' END AS status FROM orders WHERE o_orderkey % 11 <> 0), s AS (SELECT o_orderkey AS k, 'C' || o_custkey AS baseline, 'o' || o_orderkey AS child, o_custkey, o_orderpriority AS parameter, o_totalprice AS value, (o_orderkey % 7) AS n FROM orders WHERE o_orderkey % 13 <> 0),
j AS (SELECT 'o' || o_orderkey AS child, r.id, lower(trim(kind)) AS kind, lower(trim(status)) AS status, s.* EXCLUDE (child) FROM orders LEFT JOIN r ON r.id = 'O' || o_orderkey LEFT JOIN s ON s.k = o_orderkey),
f AS (SELECT *, CASE WHEN id IS NULL THEN 'no runtime entry' WHEN kind <> 'intervention' THEN 'no intervention' WHEN status <> 'success' THEN 'not successful' WHEN k IS NULL THEN 'no spec' WHEN n IN (0, 1) THEN 'not one parameter' END AS fault FROM j)
SELECT child, fault, CASE WHEN fault IS NULL THEN lower(baseline) END AS baseline, CASE WHEN fault IS NULL AND k % 3 = 0 THEN 'z' || k END AS time0, CASE WHEN fault IS NULL THEN parameter END AS parameter, CASE WHEN fault IS NULL THEN {q('value')} END AS set_value, CASE WHEN fault IS NULL THEN (n * 10)::BIGINT END AS time, CASE WHEN fault IS NULL THEN o_custkey END AS mass, CASE WHEN fault IS NULL THEN id END AS id FROM f""")
def child_contexts(spark, d):
    """Each order as a child run, with what belongs to it or why it has no context."""
    o = tables.table(spark, d, "orders")
    k = F.col("o_orderkey")
    runtime = o.where(k % 11 != 0).select(F.concat(F.lit("O"), k.cast("string")).alias("id"), F.when(k % 5 == 0, "baseline").otherwise(" Intervention").alias("run_type"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("Success ").alias("status"))
    one = F.create_map("o_orderpriority", F.col("o_totalprice"), F.lit("none"), F.lit(None).cast("double"))
    changed = F.when(k % 7 == 0, F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(2.0))).when(k % 7 == 1, F.create_map(F.lit("a"), F.lit(None).cast("double"))).otherwise(one)
    specs = o.where(k % 13 != 0).select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("baseline"), F.concat(F.lit(" o"), k.cast("string")).alias("child"), changed.alias("parameters"), F.when(k % 3 == 0, F.concat(F.lit("Z"), k.cast("string"))).alias("time0"), (k % 7 * 10).alias("time"), F.create_map(F.lit("mass"), F.col("o_custkey")).alias("baseline_parameters"))
    found = context.child_contexts(specs, runtime, o.select(F.concat(F.lit("o"), k.cast("string")).alias("child")))
    return found.select("child", "fault", "baseline", "time0", "parameter", X.scaled(F.col("set_value")).alias("set_value"), F.col("time").cast("long").alias("time"), F.col("baseline_parameters")["mass"].alias("mass"), F.col("runtime.id").alias("id"))


@query("candidate_bindings", f"WITH p AS (SELECT p_brand AS model, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END || p_partkey AS parameter, p_size::DOUBLE AS low, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_retailprice / 40 END AS high, p_partkey FROM part), b AS (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n, 'path/' || l_suppkey AS path, CASE WHEN l_linenumber = 6 THEN ' ' ELSE l_returnflag END AS name FROM lineitem WHERE l_quantity > 45), o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY lower(parameter), parameter) - 1 AS place FROM p) SELECT model, parameter, place, {q('low')} AS low, {q('high')} AS high, CASE WHEN high IS NULL THEN 'bounds' WHEN low > high THEN 'interval' WHEN n IS NULL THEN 'no binding' WHEN name = ' ' THEN 'binding' END AS fault, n, path, nullif(trim(name), '') AS name FROM o LEFT JOIN b ON l_partkey = p_partkey")
def candidate_bindings(spark, d):
    """Parts as candidate parameters of their brand, once for each of their larger items."""
    p, li = tables.table(spark, d, "part"), tables.table(spark, d, "lineitem").where("l_quantity > 45")
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.col("p_partkey").cast("string"))
    parameters = p.select(F.col("p_brand").alias("model"), name.alias("parameter"), F.col("p_size").alias("low"), F.when(F.col("p_partkey") % 10 != 0, F.col("p_retailprice") / 40).alias("high"), "p_partkey")
    n = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber")).cast("long")
    each = li.select("l_partkey", n.alias("n"), F.concat(F.lit("path/"), F.col("l_suppkey").cast("string")).alias("path"), F.when(F.col("l_linenumber") == 6, " ").otherwise(F.col("l_returnflag")).alias("name"), F.lit("x").alias("expression"))
    bindings = each.join(parameters.select("model", "parameter", F.col("p_partkey").alias("l_partkey")), "l_partkey").drop("l_partkey")
    found = context.candidate_bindings(parameters.drop("p_partkey"), bindings, ["model"])
    return found.select("model", "parameter", F.col("place").cast("long").alias("place"), X.scaled(F.col("low")).alias("low"), X.scaled(F.col("high")).alias("high"), "fault", "n", "path", "name")


@query("sanitised_states", "WITH k AS (SELECT DISTINCT 'b' || o_custkey AS id, true AS baseline FROM orders UNION ALL SELECT DISTINCT 'c' || o_orderkey, false FROM orders), u AS (SELECT c_custkey, ['b' || c_custkey, 'c' || c_custkey, 'b' || (c_custkey + 1), 'x'] AS ids FROM customer), e AS (SELECT c_custkey, unnest(ids) AS id, unnest(range(4)) AS place FROM u) SELECT c_custkey, array_to_string(coalesce(list(e.id ORDER BY place) FILTER (WHERE k.id IS NOT NULL), []), ',') AS runs, array_to_string(coalesce(list(e.id ORDER BY place) FILTER (WHERE k.baseline), []), ',') AS expanded, array_to_string(coalesce(list(e.id || '=' || place ORDER BY e.id) FILTER (WHERE k.id IS NOT NULL), []), ',') AS times FROM e LEFT JOIN k USING (id) GROUP BY c_custkey")
def sanitised_states(spark, d):
    """Each customer's selection, without what the registry of orders no longer has."""
    c, o = tables.table(spark, d, "customer"), tables.table(spark, d, "orders")
    name = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    registry = o.select(name("b", F.col("o_custkey")).alias("baseline"), name(" c", F.col("o_orderkey")).alias("child"), F.lit(None).cast("string").alias("time0"))
    k = F.col("c_custkey")
    ids = F.array(name("b", k), name("c", k), name("b", k + 1), F.lit("x"))
    states = c.select("c_custkey", ids.alias("runs"), ids.alias("expanded"), F.map_from_arrays(ids, F.array(*map(F.lit, range(4)))).alias("times"))
    s = context.sanitised(states, registry, "c_custkey", {"runs": "run", "expanded": "baseline", "times": "run"})
    times = F.array_sort(F.transform(F.map_entries("times"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return s.select("c_custkey", F.array_join("runs", ",").alias("runs"), F.array_join("expanded", ",").alias("expanded"), F.array_join(times, ",").alias("times"))


@query("kinds_of_questions", "WITH b AS (SELECT o_orderkey AS question, CASE o_orderkey % 6 WHEN 0 THEN 'classification' WHEN 1 THEN 'anomaly_localization' WHEN 2 THEN 'forecast' END AS task, ['UCR', 'uea_x', 'Equations', 'tsb_ad_1', 'anomaly', 'other', 'own_cls9'][1 + o_custkey % 7] AS benchmark, CASE o_orderkey % 4 WHEN 0 THEN 'v_one_shot' WHEN 1 THEN 'v_many_shots' WHEN 2 THEN 'v_zero_shot' END AS variant FROM orders), n AS (SELECT *, benchmark || CASE WHEN variant IS NULL THEN '' ELSE '_' || variant END AS name FROM b) SELECT question, name, CASE WHEN task = 'classification' THEN 'classification' WHEN task = 'anomaly_localization' THEN 'anomaly' WHEN task IS NOT NULL THEN 'other' WHEN regexp_matches(lower(name), '^((ucr|uea|equations|classification)(_|$)|own_cls)') THEN 'classification' WHEN regexp_matches(lower(name), '^(anomaly|tsb_ad)(_|$)') THEN 'anomaly' ELSE 'other' END AS kind, coalesce(variant IN ('v_one_shot', 'v_many_shots'), false) AS shots FROM n")
def kinds_of_questions(spark, d):
    """Questions by task or by how their benchmark begins, and whether their variant has shots."""
    k = F.col("o_orderkey")
    task = F.when(k % 6 == 0, "classification").when(k % 6 == 1, "anomaly_localization").when(k % 6 == 2, "forecast")
    bench = F.element_at(F.array(*map(F.lit, ("UCR", "uea_x", "Equations", "tsb_ad_1", "anomaly", "other", "own_cls9"))), (1 + F.col("o_custkey") % 7).cast("int"))
    variant = F.when(k % 4 == 0, "v_one_shot").when(k % 4 == 1, "v_many_shots").when(k % 4 == 2, "v_zero_shot")
    rows = tables.table(spark, d, "orders").select(k.alias("question"), task.alias("task"), variant.alias("variant"), context.benchmark_of(F.lit(None).cast("string"), bench, variant).alias("name"))
    return rows.select("question", "name", context.kind_of_question(F.col("task"), F.col("name"), ("own_cls",)).alias("kind"), context.has_shots(F.col("variant")).alias("shots"))


@query("shot_faults", "WITH s AS (SELECT o_orderkey, [' Few_Shot', 'zero_shot', 'one_shot', 'some', 'many_shots'][1 + o_orderkey % 5] AS level, count(l_orderkey) AS n, count(DISTINCT l_returnflag) AS classes, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 END AS per_class FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey), f AS (SELECT *, lower(trim(level)) AS name, per_class IS NOT NULL AND lower(trim(level)) <> 'zero_shot' AS each FROM s) SELECT o_orderkey, CASE WHEN name = 'some' THEN 'level' WHEN each AND classes < 1 THEN 'classes' WHEN each AND per_class < 0 THEN 'per_class' WHEN n <> CASE WHEN each THEN per_class * classes ELSE CASE name WHEN 'few_shot' THEN 3 WHEN 'zero_shot' THEN 0 WHEN 'one_shot' THEN 1 ELSE 30 END END THEN 'total' END AS fault FROM f")
def shot_faults(spark, d):
    """Items of an order as the examples of a question, whose number must be exact."""
    items = tables.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_returnflag").alias("classes"))
    k = F.col("o_orderkey")
    level = F.element_at(F.array(*map(F.lit, (" Few_Shot", "zero_shot", "one_shot", "some", "many_shots"))), (1 + k % 5).cast("int"))
    s = tables.table(spark, d, "orders").select("o_orderkey").join(items, "o_orderkey", "left")
    per_class = F.when(k % 3 == 0, 1).when(k % 3 == 1, -1)
    return s.select("o_orderkey", context.shot_fault(level, F.coalesce("n", F.lit(0)), F.coalesce("classes", F.lit(0)), per_class).alias("fault"))


@query("token_averages", f"WITH t AS (SELECT l_orderkey AS session, count(*) AS steps, sum(l_quantity)::BIGINT AS prompt, sum(l_linenumber * 9)::BIGINT AS cached, sum(l_suppkey)::BIGINT AS completion FROM lineitem GROUP BY 1), p AS (SELECT *, CASE WHEN cached > prompt THEN prompt + cached ELSE prompt END AS whole FROM t) SELECT session, whole AS prompt, completion, {q('whole / steps')} AS prompt_per_step, {q('completion / steps')} AS completion_per_step FROM p")
def token_averages(spark, d):
    li = tables.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("session"))
    t = logs.token_averages(li.agg(F.count(F.lit(1)).alias("steps"), F.sum("l_quantity").cast("long").alias("prompt"), F.sum(F.col("l_linenumber") * 9).alias("cached"), F.sum("l_suppkey").alias("completion")))
    return t.select("session", "prompt", "completion", X.scaled(F.col("prompt_per_step")).alias("prompt_per_step"), X.scaled(F.col("completion_per_step")).alias("completion_per_step"))


@query("stepped_signals", f"SELECT event_id, {q('''CASE WHEN event_id >= user_id * 50 THEN 7.5 ELSE value END''')} AS value FROM events")
def stepped_signals(spark, d):
    """Each user's values, which take an end value from a place on."""
    e = tables.table(spark, d, "events")
    return e.select("event_id", X.scaled(context.stepped(F.col("value"), F.col("event_id"), F.col("user_id") * 50, F.lit(7.5))).alias("value"))


@query("json_rows", "SELECT vec_id, '{\"label\":' || label || ',\"last\":' || CASE WHEN vec_id % 3 = 0 THEN 'null' ELSE (vec_id % 10)::VARCHAR END || ',\"list\":[' || vec_id || ',null],\"map\":{\"' || label || '\":null}}' AS json FROM embeddings")
def json_rows(spark, d):
    """Rows as JSON that any reader takes: what is no number is null."""
    e = tables.table(spark, d, "embeddings")
    k = F.col("vec_id")
    nan = F.lit(float("nan"))
    rows = e.select("vec_id", "label", F.when(k % 3 == 0, None).otherwise(k % 10).alias("last"), F.struct(k.alias("a"), nan.alias("b")).alias("pair"), F.create_map("label", nan).alias("map"))
    rows = rows.select("vec_id", "label", "last", F.array(F.col("pair.a").cast("double"), F.col("pair.b")).alias("list"), "map")
    return rows.select("vec_id", F.regexp_replace(context.as_json(rows, ["label", "last", "list", "map"]), r"(\d)\.0", "$1").alias("json"))
