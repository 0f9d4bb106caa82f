"""Queries over families: customers are families, their orders children, priorities parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import scalars as S
from ..operators import classify, contracts, families
from ..sources import tables
from .kernels import _ARRAYS, _EVENTS, DAY, arrays, q

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


_CHILDREN = "c AS (SELECT o_custkey AS family, o_orderkey AS child, o_orderpriority AS parameter, o_orderkey % 4 <> 0 AS eligible FROM orders)"


def children(spark, d):
    return tables.table(spark, d, "orders").select(F.col("o_custkey").alias("family"), F.col("o_orderkey").alias("child"), F.col("o_orderpriority").alias("parameter"), (F.col("o_orderkey") % 4 != 0).alias("eligible"))


def expected(spark, names):
    return spark.createDataFrame([(n,) for n in names], "parameter string")


@query("covered_parameters", f"WITH {_CHILDREN} SELECT family, count(DISTINCT parameter) FILTER (WHERE eligible AND parameter <> '5-LOW') AS parameters, count(DISTINCT parameter) FILTER (WHERE eligible AND parameter <> '5-LOW') >= 3 AS eligible FROM c GROUP BY family")
def covered_parameters(spark, d):
    names = tables.table(spark, d, "orders").select(F.col("o_orderpriority").alias("parameter")).distinct().where("parameter <> '5-LOW'")
    return families.covered(children(spark, d), names, "family", "parameter")


@query("one_child_each", f"WITH {_CHILDREN}, f AS (SELECT family, parameter, min(child) AS child FROM c WHERE eligible GROUP BY ALL), w AS (SELECT count(DISTINCT o_orderpriority) AS n FROM orders) SELECT family, parameter, child FROM f WHERE family IN (SELECT family FROM f, w GROUP BY family, n HAVING count(*) = n)")
def one_child_each(spark, d):
    """The first eligible child of each parameter, in families that have all parameters."""
    names = tables.table(spark, d, "orders").select(F.col("o_orderpriority").alias("parameter")).distinct()
    return families.one_child_each(children(spark, d), names, "family", "parameter", "child")


@query("children_of_folds", f"WITH {_CHILDREN} SELECT family % 5 AS fold, family, child FROM c WHERE eligible")
def children_of_folds(spark, d):
    c = children(spark, d).where("eligible")
    folds = c.select("family").distinct().withColumn("fold", F.col("family") % 5)
    return families.expanded_folds(folds, c, "family").select("fold", "family", "child")


@query("distinct_times", f"WITH {_EVENTS} SELECT run_id, count(DISTINCT t // {DAY}) AS times FROM e GROUP BY run_id")
def distinct_times(spark, d):
    days = tables.event_runs(spark, d).withColumn("day", F.floor(F.col("t") / DAY))
    return families.distinct_times(days, ["run_id"], "day")


@query("collapsed_as_float", f"WITH {_EVENTS} SELECT run_id, CAST(t / 3.6e9 AS FLOAT)::DOUBLE AS hour, {q('avg(value)')} AS mean FROM e GROUP BY ALL")
def collapsed_as_float(spark, d):
    """Rows whose times are one FLOAT become their mean."""
    e = tables.event_runs(spark, d).withColumn("hour", F.col("t") / 3.6e9)
    return families.collapsed(e, ["run_id"], "hour", ["value"]).select("run_id", F.col("hour").cast("double").alias("hour"), X.scaled(F.col("value")).alias("mean"))


@query("unused_samples", "WITH s AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 49), u AS (SELECT DISTINCT l_suppkey % 9 AS row, l_partkey AS id FROM lineitem) SELECT row, id FROM (SELECT DISTINCT row FROM u), s WHERE (row, id) NOT IN (SELECT row, id FROM u)")
def unused_samples(spark, d):
    """For each manifest row the selected samples that it doesn't use."""
    li = tables.table(spark, d, "lineitem")
    selected = li.where("l_quantity > 49").select(F.col("l_partkey").alias("id"))
    used = li.select((F.col("l_suppkey") % 9).alias("row"), F.col("l_partkey").alias("id")).distinct()
    return families.others(selected, used, ["row"], "id")


@query("set_verdicts", "SELECT o_custkey, len(list_filter(list(DISTINCT o_orderpriority), lambda x: x NOT IN ('1-URGENT', '2-HIGH', '5-LOW'))) = 0 AS subset, len(list_intersect(coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F'), []), coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus <> 'F'), []))) = 0 AS disjoint FROM orders GROUP BY o_custkey")
def set_verdicts(spark, d):
    some = lambda c: F.collect_set(F.when(c, F.col("o_orderpriority")))
    g = tables.table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("e"), some(F.col("o_orderstatus") == "F").alias("a"), some(F.col("o_orderstatus") != "F").alias("b"))
    valid = F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "5-LOW"]))
    return g.select("o_custkey", *(c.alias(n) for n, c in families.set_verdicts(F.col("e"), valid, F.col("a"), F.col("b")).items()))


@query("losses_with_truth", f"WITH l AS (SELECT l_orderkey AS child, l_linenumber AS parameter, min(l_discount) AS loss FROM lineitem GROUP BY ALL), t AS (SELECT o_orderkey AS child, (o_orderkey % 8 + 1)::INT AS truth FROM orders) SELECT child, parameter, {q('loss')} AS loss, parameter = truth AS is_truth FROM l JOIN t USING (child) UNION ALL SELECT child, truth, NULL, true FROM t WHERE (child, truth) NOT IN (SELECT child, parameter FROM l)")
def losses_with_truth(spark, d):
    """Candidates' losses; a true parameter that wasn't tried has a row without a loss."""
    found = tables.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("child"), F.col("l_linenumber").alias("parameter")).agg(F.min("l_discount").alias("loss"))
    truth = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("child"), (F.col("o_orderkey") % 8 + 1).cast("int").alias("parameter"))
    return families.with_truth(found, truth, "child", "parameter").withColumn("loss", X.scaled(F.col("loss")))


@query("runtime_rows", "SELECT o_orderkey AS id, kind, CASE kind WHEN 'child' THEN o_orderpriority WHEN 'time0' THEN o_orderpriority || ' from the start' ELSE 'no change' END AS label, CASE kind WHEN 'child' THEN 'change_in_run' WHEN 'time0' THEN 'change_at_start' ELSE 'unchanged' END AS policy, 'not_run' AS status FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'child' WHEN 'O' THEN 'time0' ELSE 'baseline' END AS kind FROM orders)")
def runtime_rows(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", " Child").when(F.col("o_orderstatus") == "O", "time0").otherwise("BASELINE")
    return families.runtime_rows(tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("kind"), F.col("o_orderpriority").alias("parameter")))


@query("chained_hashes", """WITH b AS (SELECT l_orderkey, l_linenumber, substr(sha256('{"a":"' || l_suppkey || '","b":"' || l_linenumber || '"}'), 1, 32) AS base_hash, l_partkey, l_returnflag FROM lineitem), c AS (SELECT *, substr(sha256(base_hash || ':{"' || l_returnflag || '":"' || l_partkey || '"}:' || l_linenumber), 1, 32) AS child_hash FROM b)
SELECT l_orderkey, l_linenumber, base_hash, child_hash, substr(sha256(child_hash || ':0'), 1, 32) AS time0_hash FROM c""")
def chained_hashes(spark, d):
    """Identities of a baseline, a child and its time0 run; keys of maps are sorted first."""
    text = lambda c: F.col(c).cast("string")
    base = F.create_map(F.lit("b"), text("l_linenumber"), F.lit("a"), text("l_suppkey"))
    h = families.chained(base, F.create_map("l_returnflag", text("l_partkey")), F.col("l_linenumber"))
    return tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in h.items()))


@query("correctness_flags", f"""WITH {_ARRAYS}, e AS (SELECT run_id, label, arg_min(s_label, (distance, s_id)) = label AS nearest FROM d GROUP BY run_id, label), m AS (SELECT s_label, pos, avg(s[pos]::DOUBLE) AS v FROM (SELECT s_label, s, unnest(range(1, len(s) + 1)) AS pos FROM s) GROUP BY ALL), a AS (SELECT s_label, list(v ORDER BY pos) AS c FROM m GROUP BY 1),
k AS (SELECT run_id, label, arg_min(s_label, (list_sum(list_transform(list_zip(x, c), lambda p: (p[1]::DOUBLE - p[2]) ** 2)), s_label)) = label AS centroid FROM r, a GROUP BY run_id, label) SELECT label, count(*) AS runs, count(*) FILTER (WHERE nearest) AS nearest, count(*) FILTER (WHERE centroid) AS centroid, true AS balanced FROM e JOIN k USING (run_id, label) GROUP BY label""")
def correctness_flags(spark, d):
    """Of each class how many runs the nearest shot and the nearest centroid get right, from a balanced support set."""
    r = arrays(spark, d)
    shots = classify.few_shots(r, 5)
    near = classify.pairs(r, shots).withColumn("distance", classify.squared_distance(F.col("values"), F.col("s_values"))).groupBy("run_id", "label").agg(F.min(F.struct("distance", "s_id", "s_label"))["s_label"].alias("a"))
    c = classify.pairs(r, classify.centroids(shots).withColumn("run_id", F.lit(None).cast("long")))
    c = c.withColumn("distance", classify.squared_distance(F.col("values"), F.col("s_values"))).groupBy("run_id").agg(F.min(F.struct("distance", "s_label"))["s_label"].alias("b"))
    right = lambda x: F.count_if(F.col(x) == F.col("label"))
    return near.join(c, "run_id").groupBy("label").agg(F.count(F.lit(1)).alias("runs"), right("a").alias("nearest"), right("b").alias("centroid"), F.lit(families.balanced_support(shots, "label")).alias("balanced"))


@query("fetched_rows", f"WITH {_EVENTS}, n AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n, row_number() OVER (PARTITION BY run_id ORDER BY t) - 1 AS pos FROM e), k AS (SELECT DISTINCT run_id, CAST(floor(j * (n - 1) / 29) AS BIGINT) AS pos FROM (SELECT DISTINCT run_id, n FROM n), range(30) r(j)) SELECT run_id, n.pos::BIGINT AS place, {q('CASE WHEN value > 1 THEN value END')} AS value FROM n JOIN k USING (run_id, pos)")
def fetched_rows(spark, d):
    """At most so many evenly spaced rows of a run, values that JSON lacks as NULL; the number asked for is capped."""
    e = tables.event_runs(spark, d).withColumn("value", F.when(F.col("value") > 1, F.col("value")).otherwise(float("nan")))
    rows = tables.fetched(e, ["run_id"], "t", 30)
    return rows.select("run_id", F.col("place").cast("long").alias("place"), X.scaled(S.json_safe(F.col("value"))).alias("value"))


@query("orphans_of_two_sources", "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT o_orderkey FROM orders) AND l_partkey NOT IN (SELECT c_custkey FROM customer)")
def orphans(spark, d):
    """Run folders that neither specs nor the registry name."""
    t = lambda n, c: tables.table(spark, d, n).select(F.col(c).alias("id"))
    return contracts.unknown(t("lineitem", "l_partkey"), t("orders", "o_orderkey").unionByName(t("customer", "c_custkey")), ["id"]).select("id")
