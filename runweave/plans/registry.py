"""Queries over registries and losses: orders play planned runs, their items the samples and results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import decimate, noise, registry, scores
from ..sources import tables
from .kernels import _EVENTS, _PAIRS, DAY, pairs, q
from .reports import _RESULTS, results

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


@query("validated_run_status", """WITH p AS (SELECT o_orderkey AS run_id, md5(o_orderpriority) AS hash FROM orders),
r AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' ELSE '' END AS said, md5(CASE WHEN o_orderkey % 11 = 0 THEN 'old' ELSE o_orderpriority END) AS h FROM orders WHERE o_orderkey % 5 <> 0),
a AS (SELECT DISTINCT l_orderkey AS run_id, true AS has FROM lineitem WHERE l_quantity > 25),
s AS (SELECT run_id, r.h IS NOT NULL AS ran, coalesce(has, false) AS has, said, r.h <> hash AS differs FROM p LEFT JOIN r USING (run_id) LEFT JOIN a USING (run_id)),
t AS (SELECT CASE WHEN NOT ran THEN CASE WHEN has THEN 'success' ELSE 'not_run' END WHEN differs THEN 'not_run' WHEN said = 'failed' THEN 'failed' WHEN has THEN 'success' ELSE 'not_run' END AS status, CASE WHEN differs THEN 'hash_mismatch' WHEN ran AND said = 'success' AND NOT has THEN 'missing_data' END AS stale_reason FROM s)
SELECT status, stale_reason, count(*) AS n FROM t GROUP BY ALL""")
def validated(spark, d):
    o = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), "o_orderstatus", "o_orderpriority")
    said = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "success").otherwise("")
    known = F.when(F.col("run_id") % 11 == 0, "old").otherwise(F.col("o_orderpriority"))
    runtime = o.where("run_id % 5 <> 0").select("run_id", said.alias("status"), F.md5(known).alias("runtime_hash"))
    have = tables.table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("run_id")).distinct()
    found = registry.with_status(o.select("run_id", F.md5("o_orderpriority").alias("hash")), runtime, have)
    return found.groupBy("status", "stale_reason").agg(F.count(F.lit(1)).alias("n"))


@query("prompt_gain", f"WITH {_RESULTS}, m AS (SELECT model, dataset, shot, context, avg(score) AS s FROM r GROUP BY ALL) SELECT a.model, {q('avg(b.s - a.s)')} AS gain, count(*) AS pairs FROM m a JOIN m b USING (model, dataset, shot) WHERE a.context = 'F' AND b.context = 'O' GROUP BY a.model")
def prompt_gain(spark, d):
    m = results(spark, d).groupBy("model", "dataset", "shot", "context").agg(F.avg("score").alias("s"))
    a, b = (m.where(F.col("context") == c).select("model", "dataset", "shot", F.col("s").alias(c)) for c in "FO")
    return a.join(b, ["model", "dataset", "shot"]).groupBy("model").agg(X.scaled(F.avg(F.col("O") - F.col("F"))).alias("gain"), F.count(F.lit(1)).alias("pairs"))


@query("other_samples", "WITH u AS (SELECT DISTINCT l_orderkey % 97 AS row_id, l_suppkey AS sample FROM lineitem WHERE l_returnflag <> 'R'), s AS (SELECT DISTINCT l_suppkey AS sample FROM lineitem), n AS (SELECT count(*) AS n FROM s) SELECT row_id, count(*) AS own, max(n) - count(*) AS others FROM u, n GROUP BY row_id")
def other_samples(spark, d):
    """How many of all selected samples a row neither trains on nor tests: the total less its own, without pairs."""
    li = tables.table(spark, d, "lineitem").select((F.col("l_orderkey") % 97).alias("row_id"), F.col("l_suppkey").alias("sample"), "l_returnflag")
    total = li.agg(F.count_distinct("sample").alias("n"))
    own = li.where("l_returnflag <> 'R'").groupBy("row_id").agg(F.count_distinct("sample").alias("own"))
    return own.join(F.broadcast(total)).select("row_id", "own", (F.col("n") - F.col("own")).alias("others"))  # one row


@query("label_conflicts", "SELECT l_partkey, count(DISTINCT l_returnflag) AS labels FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) > 1")
def label_conflicts(spark, d):
    return registry.conflicts(tables.table(spark, d, "lineitem"), "l_partkey", "l_returnflag")


@query("manifest_match", "SELECT o_orderpriority AS slug, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY slug")
def manifest_match(spark, d):
    """Each question finds its only manifest row, or the job fails."""
    o = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("slug"))
    m = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("v"))
    return registry.match_once(o, m, ["k"]).groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("keys"))


@query("ground_truth_rows", "WITH c AS (SELECT o_custkey AS base, o_orderkey AS child, o_orderpriority AS label FROM orders WHERE o_orderstatus <> 'P'), u AS (SELECT 'baseline' AS kind, base AS id, NULL AS label FROM (SELECT DISTINCT base FROM c) UNION ALL SELECT 'child', child, label FROM c UNION ALL SELECT 'time0', child, label FROM c WHERE child % 2 = 0) SELECT kind, label, count(*) AS n, min(id) AS least FROM u GROUP BY ALL")
def ground_truth(spark, d):
    c = tables.table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"))
    base = c.select(F.col("o_custkey").alias("id")).distinct().select(F.lit("baseline").alias("kind"), "id", F.lit(None).cast("string").alias("label"))
    kinds = F.explode(F.when(F.col("id") % 2 == 0, F.array(F.lit("child"), F.lit("time0"))).otherwise(F.array(F.lit("child"))))
    return base.union(c.select(kinds.alias("kind"), "id", "label")).groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))


@query("child_of_each_parameter", "SELECT o_custkey, o_orderpriority AS parameter, min(o_orderkey) AS child, count(*) AS children FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL")
def child_choice(spark, d):
    o = tables.table(spark, d, "orders").where("o_orderstatus = 'O'")
    return o.groupBy("o_custkey", F.col("o_orderpriority").alias("parameter")).agg(F.min("o_orderkey").alias("child"), F.count(F.lit(1)).alias("children"))


_TIMES = f"{_EVENTS}, s AS (SELECT run_id, t / 1e6 AS t, value, row_number() OVER (PARTITION BY run_id ORDER BY t) - 1 AS pos, t / 1e6 - lag(t / 1e6) OVER (PARTITION BY run_id ORDER BY t) AS gap FROM e)"


@query("rate_decimation", f"WITH {_TIMES}, g AS (SELECT run_id, 1 / median(gap) AS base FROM s WHERE gap > 0 GROUP BY run_id), n AS (SELECT run_id, count(*) FILTER (WHERE t < 200000 - 1e-12) AS begin FROM s GROUP BY run_id), k AS (SELECT s.*, CASE WHEN 5e-6 >= base THEN pos ELSE pos - begin END AS place, CASE WHEN 5e-6 >= base THEN 1 ELSE greatest(1, CAST(floor(base / 5e-6 + 0.5) AS BIGINT)) END AS stride FROM s JOIN g USING (run_id) JOIN n USING (run_id)) SELECT run_id, place // stride AS block, min(pos) AS pos, {q('arg_min(value, (-abs(value), pos))')} AS value FROM k WHERE place >= 0 GROUP BY ALL")
def rate_decimation(spark, d):
    """Runs thinned to one sample in 200,000 seconds, each block with its largest magnitude."""
    e = tables.event_runs(spark, d).withColumn("t", F.col("t") / 1e6)
    found = decimate.signed_peaks(decimate.plan(e, ["run_id"], "t", 5e-6), ["run_id"], "value")
    return found.select("run_id", "block", F.col("pos").cast("long").alias("pos"), X.scaled(F.col("value")).alias("value"))


@query("noise_profile")
def noise_profile(spark, d):
    return noise.apply_profile(tables.event_runs(spark, d), "run_id", "signal", "t", 0.1, 0.02, 0.001, 7)


@query("noise_levels", f"WITH {_EVENTS}, l AS (SELECT run_id, signal, t, sqrt(avg(value * value) OVER w) AS a, sqrt(avg(value * value) OVER (PARTITION BY run_id, signal)) AS b FROM e WINDOW w AS (PARTITION BY run_id, signal ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) SELECT run_id, signal, t, {q('sqrt((0.1 * greatest(a, 0.0001 * b)) ** 2 + (0.02 * b) ** 2 + 0.000001)')} AS sigma, {q('0.03 * 0.5 * b')} AS whole FROM l")
def noise_levels(spark, d):
    e = noise.levels(tables.event_runs(spark, d), ["run_id", "signal"], "t")
    return e.select("run_id", "signal", "t", X.scaled(noise.adaptive_sigma(0.1, 0.02, 0.001)).alias("sigma"), X.scaled(noise.global_sigma(0.5)).alias("whole"))


@query("trajectory_loss", f"WITH {_PAIRS}, c AS (SELECT label, pos // 16 AS signal, greatest(max(abs(base)), 0.000001) AS scale FROM p WHERE pos % 16 < 8 GROUP BY ALL), l AS (SELECT p.label, p.run_id, p.pos // 16 AS signal, avg(((value - base) / scale) ** 2) AS loss FROM p JOIN c ON c.label = p.label AND c.signal = p.pos // 16 WHERE pos % 16 >= 8 GROUP BY ALL), t AS (SELECT label, run_id, sum(loss) AS loss FROM l GROUP BY ALL) SELECT label, run_id, {q('loss')} AS loss, rank() OVER (PARTITION BY label ORDER BY {q('loss')}) AS place FROM t")
def trajectory_loss(spark, d):
    """Squared residuals in units of the reference's level before the intervention, summed over signals, and each run's rank."""
    p = pairs(spark, d).withColumn("signal", F.floor(F.col("pos") / 16))
    scale = p.where("pos % 16 < 8").groupBy("label", "signal").agg(F.greatest(F.max(F.abs("base")), F.lit(1e-6)).alias("scale"))
    residual = F.pow((F.col("value") - F.col("base")) / F.col("scale"), 2)
    losses = p.where("pos % 16 >= 8").join(scale, ["label", "signal"]).groupBy("label", "run_id", "signal").agg(F.avg(residual).alias("loss"))
    t = losses.groupBy("label", "run_id").agg(X.scaled(F.sum("loss")).alias("loss"))
    return t.withColumn("place", F.rank().over(Window.partitionBy("label").orderBy("loss")).cast("long"))


@query("channel_tolerance", f"WITH {_PAIRS} SELECT label, run_id, {q('max(abs(value - base))')} AS most, {q('max(abs(value - base)) / nullif(max(abs(base)), 0)')} AS share, {q('CASE WHEN avg(abs(base)) > 0 THEN max(abs(value - base)) / avg(abs(base)) END')} AS ratio FROM p WHERE pos < 16 GROUP BY ALL")
def channel_tolerance(spark, d):
    found = scores.signal_ratio(pairs(spark, d).where("pos < 16"), ["label", "run_id"], F.col("value") - F.col("base"), F.col("base"))
    return found.select("label", "run_id", *(X.scaled(F.col(c)).alias(c) for c in ("most", "share", "ratio")))


@query("series_inventory", f"WITH {_EVENTS} SELECT run_id, signal, count(*) AS points, count(DISTINCT t // {DAY}) AS days, min(t) AS t_start, max(t) AS t_end FROM e GROUP BY ALL")
def inventory(spark, d):
    e = tables.event_runs(spark, d)
    return e.groupBy("run_id", "signal").agg(F.count(F.lit(1)).alias("points"), F.count_distinct(F.floor(F.col("t") / DAY)).alias("days"), F.min("t").alias("t_start"), F.max("t").alias("t_end"))


@query("rule_scores", f"WITH s AS (SELECT l_partkey AS sample, l_suppkey % 5 AS seed, CASE WHEN l_partkey % 3 = 0 THEN 'test' ELSE 'other' END AS part, (l_returnflag = 'N')::INT AS correct, l_discount AS score FROM lineitem), m AS (SELECT sample, part, avg(score) AS mean, avg(correct) FILTER (WHERE seed = 0) AS headline FROM s GROUP BY ALL) SELECT part, count(*) AS samples, {q('avg(mean)')} AS mean, {q('coalesce(avg(headline), 0)')} AS headline FROM m GROUP BY part")
def rule_scores(spark, d):
    """Means over seeds of each sample, then over samples; the headline takes the base seed alone."""
    part = F.when(F.col("l_partkey") % 3 == 0, "test").otherwise("other")
    rows = tables.table(spark, d, "lineitem").withColumns({"sample": F.col("l_partkey"), "part": part})
    found = scores.over_seeds(rows, "sample", "part", F.col("l_discount"), F.col("l_suppkey") % 5 == 0, (F.col("l_returnflag") == "N").cast("int"))
    return found.select("part", "samples", X.scaled(F.col("mean")).alias("mean"), X.scaled(F.col("headline")).alias("headline"))


@query("grouped_seeds", "SELECT o_orderpriority AS slug, o_orderstatus AS kind, array_to_string(list_sort(list(DISTINCT o_custkey % 13)), ',') AS seeds, count(DISTINCT o_custkey % 3) AS settings FROM orders GROUP BY ALL")
def grouped_seeds(spark, d):
    o = tables.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("slug"), F.col("o_orderstatus").alias("kind"))
    seeds = F.array_sort(F.collect_set(F.col("o_custkey") % 13))
    return o.agg(F.array_join(F.transform(seeds, lambda s: s.cast("string")), ",").alias("seeds"), F.count_distinct(F.col("o_custkey") % 3).alias("settings"))


@query("token_rollup_check", "WITH t AS (SELECT l_orderkey AS k, sum(l_linenumber)::BIGINT AS steps, count(*) AS n, max(l_linenumber) AS last FROM lineitem GROUP BY 1) SELECT k, steps, n * (n + 1) // 2 AS said, steps = n * (n + 1) // 2 AS agrees, last::BIGINT AS last FROM t")
def token_rollup(spark, d):
    """Totals of the steps against those that the log states."""
    t = tables.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_linenumber").cast("long").alias("steps"), F.count(F.lit(1)).alias("n"), F.max("l_linenumber").cast("long").alias("last"))
    said = F.floor(F.col("n") * (F.col("n") + 1) / 2).cast("long")
    return t.select("k", "steps", said.alias("said"), (F.col("steps") == said).alias("agrees"), "last")


@query("excluded_interval_draws", f"WITH u AS (SELECT p_partkey, p_size::DOUBLE AS c, CAST('0x' || substr(md5('5:' || p_partkey), 1, 8) AS BIGINT) / 4294967296 AS u FROM part), w AS (SELECT *, greatest(0, least(c - 4, 50) - 1) AS l, greatest(c + 4, 1) AS b FROM u), z AS (SELECT *, greatest(0, 50 - b) AS r FROM w) SELECT p_partkey, {q('CASE WHEN l + r > 0 THEN CASE WHEN u * (l + r) < l THEN 1 + u * (l + r) ELSE b + u * (l + r) - l END END')} AS drawn FROM z")
def interval_draws(spark, d):
    """A value of [1, 50] at least 4 from the present one, from a seeded hash."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit("5:"), F.col("p_partkey").cast("string"))), 1, 8), 16, 10).cast("long") / 4294967296
    at = registry.uniform_outside(u, F.lit(1.0), F.lit(50.0), F.col("p_size").cast("double"), F.lit(4.0))
    return tables.table(spark, d, "part").select("p_partkey", X.scaled(at).alias("drawn"))


@query("test_batches", "WITH k AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings) SELECT label, k // 8 AS batch, count(*) AS n, count(*) = 8 AS whole FROM k GROUP BY ALL")
def test_batches(spark, d):
    e = scores.batched(tables.table(spark, d, "embeddings"), ["label"], "vec_id", 8, whole=False)
    return e.groupBy("label", "batch").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == 8).alias("whole"))


@query("answer_faults", "WITH a AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber = 7 THEN ' ' ELSE 's' || l_suppkey END AS name, 's' || l_suppkey AS stem, CASE l_returnflag WHEN 'A' THEN ['x', ' x'] WHEN 'R' THEN ['x', 'y'] WHEN 'N' THEN CASE WHEN l_quantity > 40 THEN [] ELSE ['y', ' '] END END AS labels FROM lineitem), e AS (SELECT DISTINCT l_orderkey AS k, 's' || l_suppkey AS stem FROM lineitem WHERE l_linenumber <> 3), j AS (SELECT a.k, trim(name) AS name, CASE WHEN trim(name) = '' THEN '' WHEN e.stem IS NULL THEN name ELSE 'data/' || e.stem || '.parquet' END AS sample, labels, e.stem IS NOT NULL AND trim(name) <> '' AS known FROM a LEFT JOIN e ON a.k = e.k AND a.stem = e.stem), f AS (SELECT k, sample, unnest(list_filter([CASE WHEN name = '' THEN 'empty_key' END, CASE WHEN len(labels) = 0 OR list_contains(labels, ' ') THEN 'empty_label' END, CASE WHEN labels = ['x', ' x'] THEN 'repeated_label' END, CASE WHEN name <> '' AND NOT known THEN 'unexpected' END], lambda x: x IS NOT NULL)) AS rule FROM j) SELECT k, rule, sample FROM f UNION ALL SELECT k, 'repeated_key', sample FROM j WHERE name <> '' GROUP BY k, sample HAVING count(*) > 1 UNION ALL SELECT k, 'missing', 'data/' || stem || '.parquet' FROM e WHERE NOT EXISTS (FROM j WHERE j.k = e.k AND j.sample = 'data/' || e.stem || '.parquet')")
def answer_faults(spark, d):
    """Items of an order as answers by the names of samples, of which some aren't expected."""
    li = tables.table(spark, d, "lineitem").withColumn("k", F.col("l_orderkey"))
    stem = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    flag = F.col("l_returnflag")
    texts = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    labels = F.when(flag == "A", texts("x", " x")).when(flag == "R", texts("x", "y")).otherwise(F.when(F.col("l_quantity") > 40, texts()).otherwise(texts("y", " ")))
    answers = li.select("k", F.when(F.col("l_linenumber") == 7, " ").otherwise(stem).alias("sample"), labels.alias("labels"))
    expected = li.where("l_linenumber <> 3").select("k", F.concat(F.lit("data/"), stem, F.lit(".parquet")).alias("sample"))
    return scores.answer_faults(answers, expected, ["k"])


@query("answer_contract", "WITH a AS (SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT l_suppkey) AS kinds, list(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1) SELECT count(*) FILTER (WHERE kinds < n) AS repeated, count(*) FILTER (WHERE NOT list_contains(flags, 'N')) AS missing, count(*) AS answers FROM a")
def answer_contract(spark, d):
    a = tables.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("kinds"), F.count_if(F.col("l_returnflag") == "N").alias("expected"))
    return a.agg(F.count_if(F.col("kinds") < F.col("n")).alias("repeated"), F.count_if(F.col("expected") == 0).alias("missing"), F.count(F.lit(1)).alias("answers"))
