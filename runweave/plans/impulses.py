"""Queries over impulses, scales of losses, verdicts and contracts of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import impulses, noise, windows
from ..sources import tables
from .kernels import _PAIRS, _VECTORS, pairs, q, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


_JUMPS = f"{_VECTORS}, d AS (SELECT *, coalesce(value - lag(value) OVER (PARTITION BY run_id ORDER BY pos), 0) AS d FROM v), m AS (SELECT *, abs(d - median(d) OVER (PARTITION BY run_id)) AS o FROM d), s AS (SELECT *, 1.4826::DOUBLE * median(o) OVER (PARTITION BY run_id) AS s FROM m), j AS (SELECT run_id, pos, value, CASE WHEN s > 0 THEN o / s ELSE 0 END AS jump FROM s)"


@query("impulse_samples", f"WITH {_JUMPS} SELECT run_id, count(*) FILTER (WHERE jump > 2.5) AS impulses, CAST(min(pos) FILTER (WHERE jump > 2.5) AS BIGINT) AS first, {q('max(jump)')} AS most FROM j GROUP BY run_id")
def impulse_samples(spark, d):
    j, far = impulses.jumps(vectors(spark, d), ["run_id"], "pos"), F.col("jump") > 2.5
    return j.groupBy("run_id").agg(F.count_if(far).alias("impulses"), F.min(F.when(far, F.col("pos"))).cast("long").alias("first"), X.scaled(F.max("jump")).alias("most"))


_KEPT = f"{_JUMPS}, b AS (SELECT *, max(CASE WHEN jump > 2.5 THEN pos END) OVER (PARTITION BY run_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS before, min(CASE WHEN jump > 2.5 THEN pos END) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after, count(*) OVER (PARTITION BY run_id) AS n FROM j), k AS (SELECT *, pos = 0 OR pos = n - 1 OR coalesce(pos - before <= 2, false) OR coalesce(after - pos <= 2, false) AS keep FROM b)"


@query("kept_around_impulses", f"WITH {_KEPT} SELECT run_id, count(*) FILTER (WHERE keep) AS kept, sum(pos) FILTER (WHERE keep)::BIGINT AS places FROM k GROUP BY run_id")
def kept(spark, d):
    k = impulses.kept_around(impulses.jumps(vectors(spark, d), ["run_id"], "pos"), ["run_id"], "pos", F.col("jump") > 2.5, 2)
    return k.groupBy("run_id").agg(F.count_if("keep").alias("kept"), F.sum(F.when(F.col("keep"), F.col("pos"))).alias("places"))


@query("impulse_aware_thinning")
def thinning(spark, d):
    """40 samples of each run, impulses and their neighbours first."""
    k = impulses.kept_around(impulses.jumps(vectors(spark, d), ["run_id"], "pos"), ["run_id"], "pos", F.col("jump") > 8, 5)
    return impulses.thin(k, ["run_id"], "pos", 40).select("run_id", "pos", "value")


_PEAKS = f"{_VECTORS}, t AS (SELECT *, max(abs(value)) OVER (PARTITION BY run_id) AS most FROM v), i AS (SELECT *, pos - row_number() OVER (PARTITION BY run_id ORDER BY pos) AS island FROM t WHERE abs(value) > 0.6 * most), k AS (SELECT run_id, arg_min(pos, (-abs(value), pos)) AS place, arg_min(value, (-abs(value), pos)) AS peak FROM i GROUP BY run_id, island)"


@query("impulse_events", f"WITH {_PEAKS}, n AS (SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY run_id ORDER BY place) > 4 THEN 1 ELSE 0 END AS fresh FROM k), s AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY place) AS session FROM n) SELECT run_id, CAST(min(place) AS BIGINT) AS begin, count(*) AS peaks, {q('arg_min(peak, (-abs(peak), place))')} AS peak FROM s GROUP BY run_id, session")
def impulse_events(spark, d):
    """Peaks over a share of the run's largest; those close to one another are one event."""
    found = impulses.peaks(vectors(spark, d), ["run_id"], "pos", 0.6).select("run_id", "place", F.col("peak").alias("value"))
    events = windows.sessions(found, ["run_id"], "place", "value", 4)
    return events.select("run_id", F.col("begin").cast("long").alias("begin"), F.col("events").alias("peaks"), X.scaled(F.col("peak")).alias("peak"))


@query("rebound_peaks", f"WITH {_PEAKS}, w AS (SELECT k.run_id, k.place, k.peak, median(v.value) FILTER (WHERE v.pos <= k.place) AS a, median(v.value) FILTER (WHERE v.pos >= k.place) AS b FROM k JOIN v ON v.run_id = k.run_id AND v.pos BETWEEN k.place - 3 AND k.place + 3 GROUP BY ALL) SELECT run_id, CAST(place AS BIGINT) AS place, {q('peak')} AS peak FROM w WHERE a < 0 AND b > 0")
def rebound_peaks(spark, d):
    v = vectors(spark, d)
    found = impulses.rebounds(impulses.peaks(v, ["run_id"], "pos", 0.6), v, ["run_id"], "pos", "value", 3)
    return found.select("run_id", F.col("place").cast("long").alias("place"), X.scaled(F.col("peak")).alias("peak"))


@query("signal_scales", f"WITH {_PAIRS}, a AS (SELECT label, run_id, max(abs(value)) FILTER (WHERE pos < 4 AND abs(value) > 0.1) AS own, max(abs(base)) FILTER (WHERE pos < 4 AND abs(base) > 0.15) AS theirs FROM p GROUP BY ALL) SELECT label, run_id, {q('coalesce(own, theirs, 1)')} AS scale, own IS NULL AS from_baseline FROM a")
def signal_scales(spark, d):
    """The level before the intervention: the reference's, else the baseline's, else 1."""
    most = lambda c, least: F.max(F.when((F.col("pos") < 4) & (F.abs(c) > least), F.abs(c)))
    a = pairs(spark, d).groupBy("label", "run_id").agg(most("value", 0.1).alias("own"), most("base", 0.15).alias("theirs"))
    return a.select("label", "run_id", X.scaled(F.coalesce("own", "theirs", F.lit(1.0))).alias("scale"), F.col("own").isNull().alias("from_baseline"))


@query("candidate_verdict", f"WITH c AS (SELECT l_orderkey AS child, l_linenumber AS parameter, min(l_discount) AS loss, l_orderkey % 4 + 1 AS truth FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY loss, parameter) AS k FROM c), f AS (SELECT child, max(parameter) FILTER (WHERE k = 1) AS best, max(loss) FILTER (WHERE k = 1) AS l1, max(loss) FILTER (WHERE k = 2) AS l2, min(k) FILTER (WHERE parameter = truth) AS rank, max(truth) AS truth FROM k GROUP BY child), g AS (SELECT *, (0.08::DOUBLE - l1) / 0.08::DOUBLE AS gain, (l2 - l1) / greatest(abs(l2), 1e-12) AS gap FROM f) SELECT child, best, rank, {q('gain')} AS gain, {q('gap')} AS gap, coalesce(best = truth AND gain >= 0.2 AND gap >= 0.1, false) AS is_match FROM g")
def verdict(spark, d):
    li = tables.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("child"), F.col("l_linenumber").alias("parameter")).agg(F.min("l_discount").alias("loss"))
    found = impulses.verdicts(li.withColumn("truth", F.col("child") % 4 + 1).withColumn("baseline", F.lit(0.08)), "child", 0.2, 0.1)
    return found.withColumn("gain", X.scaled(F.col("gain"))).withColumn("gap", X.scaled(F.col("gap")))


@query("noise_summary")
def noise_summary(spark, d):
    """How far two levels of noise move each run, over five seeds: mean and spread of the distances and of the signal-to-noise ratio."""
    keys = ["run_id", "profile", "seed"]
    sigma = {n: x * F.greatest("__local", noise.FLOOR * F.col("__whole")) for n, x in (("low", 0.02), ("high", 0.1))}
    # samples have their places before they are repeated, so that only they are sorted
    v = noise.levels(vectors(spark, d), ["run_id"], "pos").withColumns({f"k_{n}": noise.place(["run_id"], "pos", s) for n, s in sigma.items()})
    level = F.explode(F.array(*(F.struct(F.lit(n).alias("profile"), s.alias("sigma"), F.col(f"k_{n}").alias("k")) for n, s in sigma.items())))
    stream = noise.stream_seed(F.concat(F.lit("run:"), F.col("run_id").cast("string")), F.col("seed"))
    streams = vectors(spark, d).select("run_id").distinct().withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("stream", stream)
    streams = streams.groupBy("run_id").agg(F.collect_list(F.struct("seed", "stream")).alias("streams"))
    each = v.join(streams, "run_id").select("run_id", "value", "streams", level.alias("l")).select("run_id", "value", "l.*", F.inline("streams"))
    drawn = noise.with_normals(each, "normal", F.col("stream"), F.col("k"))
    noisy = drawn.withColumn("noise", F.when(F.col("k").isNotNull(), F.col("sigma") * F.col("normal")).otherwise(0.0))
    rms = lambda c: F.sqrt(F.avg(F.pow(c, F.lit(2))))
    each = noisy.groupBy(*keys).agg(F.sqrt(F.sum(F.pow("noise", F.lit(2)))).alias("distance"), F.try_divide(rms("value"), rms("noise")).alias("ratio"))
    return each.groupBy("run_id", "profile").agg(F.avg("distance").alias("distance"), X.ratio_to_db(F.avg("ratio")).alias("db"), F.stddev_pop("ratio").alias("spread"))


@query("feasible_draws", "WITH c AS (SELECT o_orderpriority AS label, count(*) AS candidates, count(DISTINCT o_custkey) AS families FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT label, candidates, families, families >= 20 AND candidates >= 30 AS feasible FROM c")
def feasible(spark, d):
    """Whether each label has enough candidates, of enough families, to draw from."""
    o = tables.table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_orderpriority").alias("label"))
    c = o.agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct("o_custkey").alias("families"))
    return c.withColumn("feasible", (F.col("families") >= 20) & (F.col("candidates") >= 30))


@query("wrong_samples", "SELECT DISTINCT l_suppkey % 7 AS model, l_partkey AS sample FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def wrong_samples(spark, d):
    """(model, sample) of each sample that a model got wrong in any trial."""
    li = tables.table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_linestatus = 'F'")
    return li.select((F.col("l_suppkey") % 7).alias("model"), F.col("l_partkey").alias("sample")).distinct()


@query("baseline_in_two_hops", "WITH e AS (SELECT DISTINCT 'o' || l_orderkey AS child, 's' || l_suppkey AS node FROM lineitem UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders) SELECT b.child AS baseline, count(DISTINCT a.node) AS reached FROM e a JOIN e b ON b.node = a.child GROUP BY b.child")
def two_hops(spark, d):
    """From each run over its parent to the baseline, along one table of edges."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    a = tables.table(spark, d, "lineitem").select(name("o", "l_orderkey").alias("child"), name("s", "l_suppkey").alias("node")).distinct()
    e = a.union(tables.table(spark, d, "orders").select(name("c", "o_custkey").alias("child"), name("o", "o_orderkey").alias("node")))
    upper = e.select(F.col("child").alias("baseline"), F.col("node").alias("child"))
    return e.join(upper, "child").groupBy("baseline").agg(F.count_distinct("node").alias("reached"))


@query("results_contract", "WITH c AS (SELECT o_orderkey AS k, o_totalprice AS score, CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' ELSE o_orderkey::VARCHAR END AS said, o_orderpriority AS model FROM orders) SELECT 'not a number' AS rule, count(*) FILTER (WHERE TRY_CAST(said AS DOUBLE) IS NULL) AS n FROM c UNION ALL SELECT 'out of range', count(*) FILTER (WHERE score NOT BETWEEN 0 AND 200000) FROM c UNION ALL SELECT 'unknown model', count(*) FILTER (WHERE model NOT IN ('1-URGENT', '2-HIGH')) FROM c UNION ALL SELECT 'repeated', count(*) - count(DISTINCT k) FROM c")
def results_contract(spark, d):
    """One pass over the results; each rule with the rows that break it."""
    said = F.when(F.col("o_orderkey") % 17 == 0, "n/a").otherwise(F.col("o_orderkey").cast("string"))
    counts = tables.table(spark, d, "orders").agg(
        F.count_if(said.try_cast("double").isNull()).alias("not a number"),
        F.count_if(~F.col("o_totalprice").between(0, 200000)).alias("out of range"),
        F.count_if(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("unknown model"),
        (F.count(F.lit(1)) - F.count_distinct("o_orderkey")).alias("repeated"),
    )
    return counts.unpivot([], counts.columns, "rule", "n")
