"""Queries over runs as they come: checks, coercion, alignment, regular grids, and verdicts against two references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import loading
from ..sources import tables
from .kernels import _BINS, _EVENTS, _PAIRS, _VECTORS, DAY, pairs, q, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def raw_events(spark, d):
    """Events whose time and value are texts, some of them no numbers."""
    e = tables.event_runs(spark, d)
    n = F.pmod(F.floor(F.col("t") / 1_000_000).cast("long"), F.lit(1_009))
    raw = F.when((n == 7) & (F.col("run_id") % 3 == 0), "n/a").otherwise(F.col("t").cast("string"))
    return e.select("run_id", "signal", raw.alias("time"), F.when(n == 11, "").otherwise(F.col("value").cast("string")).alias("v"), "value", "t")


_RAW = f"{_EVENTS}, raw AS (SELECT run_id, signal, CASE WHEN (t // 1000000) % 1009 = 7 AND run_id % 3 = 0 THEN 'n/a' ELSE t::VARCHAR END AS time, CASE WHEN (t // 1000000) % 1009 = 11 THEN NULL ELSE value END AS v, t FROM e)"


@query("numeric_runs", f"WITH {_RAW} SELECT run_id, count(*) AS rows, min(t) AS first, max(t) AS last FROM raw GROUP BY run_id HAVING count(*) FILTER (WHERE try_cast(time AS DOUBLE) IS NULL) = 0")
def numeric_runs(spark, d):
    """Runs with a time that is no number are left out whole."""
    rows = loading.numeric_runs(raw_events(spark, d), ["run_id"], "time")
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"), F.min("t").alias("first"), F.max("t").alias("last"))


@query("coerced_runs", f"WITH {_RAW} SELECT run_id, signal, t, {q('CAST(v AS FLOAT)::DOUBLE')} AS value FROM raw WHERE try_cast(time AS DOUBLE) IS NOT NULL AND v IS NOT NULL")
def coerced_runs(spark, d):
    rows = loading.coerced_runs(raw_events(spark, d), "time", ["v"])
    return rows.select("run_id", "signal", "t", X.scaled(F.col("v").cast("double")).alias("value"))


_FRAME = "f AS (SELECT l_suppkey AS run_id, epoch_ms(l_shipdate::TIMESTAMP) // 86400000 AS time, l_quantity AS a, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END AS b, l_orderkey, l_linenumber FROM lineitem)"


def frames(spark, d):
    li = tables.table(spark, d, "lineitem")
    time = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return li.select(F.col("l_suppkey").alias("run_id"), time.alias("time"), F.col("l_quantity").alias("a"), F.when(F.col("l_linenumber") != 7, F.col("l_discount")).alias("b"), "l_orderkey", "l_linenumber")


@query("validated_frames", f"WITH {_FRAME}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id, time ORDER BY l_orderkey, l_linenumber) AS k FROM f WHERE a IS NOT NULL AND b IS NOT NULL), n AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS rows FROM k WHERE k = 1) SELECT run_id, time::BIGINT AS time, {q('a')} AS a, {q('b')} AS b, rows FROM n WHERE rows >= 12")
def validated_frames(spark, d):
    rows = loading.validated_frames(frames(spark, d), ["run_id"], "time", ["a", "b"], ["l_orderkey", "l_linenumber"])
    return rows.select("run_id", F.col("time").cast("long").alias("time"), X.scaled(F.col("a")).alias("a"), X.scaled(F.col("b")).alias("b"), "rows")


@query("anonymised_columns", "SELECT r_regionkey AS col1, r_name AS col2 FROM region")
def anonymised(spark, d):
    return loading.anonymise(tables.table(spark, d, "region").select("r_regionkey", "r_name"))


@query("from_time_or_all", f"WITH {_EVENTS}, n AS (SELECT *, count(*) FILTER (WHERE t >= {20 * DAY}) OVER (PARTITION BY run_id, signal) AS n FROM e) SELECT run_id, signal, count(*) AS rows, min(t) AS first FROM n WHERE t >= {20 * DAY} OR n = 0 GROUP BY ALL")
def from_time(spark, d):
    rows = loading.from_time(tables.event_runs(spark, d), ["run_id", "signal"], "t", F.lit(20 * DAY))
    return rows.groupBy("run_id", "signal").agg(F.count(F.lit(1)).alias("rows"), F.min("t").alias("first"))


@query("regular_sampling", f"""WITH {_VECTORS}, g AS (SELECT *, pos * 0.125 + CASE WHEN run_id % 7 = 0 AND pos = 5 THEN 0.03125 WHEN run_id % 11 = 0 AND pos = 9 THEN -1 ELSE 0 END AS time FROM v),
s AS (SELECT *, time - lag(time) OVER (PARTITION BY run_id ORDER BY pos) AS gap FROM g), m AS (SELECT run_id, count(*) AS rows, median(gap) AS step FROM s GROUP BY run_id)
SELECT run_id, rows, {q('step')} AS step, bool_and(gap > 0) AS increasing, bool_and(abs(gap - step) <= greatest(1e-9, 1e-6 * abs(step))) AS even, abs(step - 0.125) <= greatest(1e-9, 1e-6 * abs(step)) AS at_rate, increasing AND even AND at_rate AS regular FROM s JOIN m USING (run_id) WHERE gap IS NOT NULL GROUP BY run_id, rows, step""")
def regular_sampling(spark, d):
    v = vectors(spark, d)
    late = F.when((F.col("run_id") % 7 == 0) & (F.col("pos") == 5), 0.03125).when((F.col("run_id") % 11 == 0) & (F.col("pos") == 9), -1.0).otherwise(0.0)
    return loading.regular_sampling(v.withColumn("time", F.col("pos") * 0.125 + late), ["run_id"], "time", 8.0).withColumn("step", X.scaled(F.col("step")))


@query("grid_faults", f"""WITH {_EVENTS}, r AS (SELECT run_id, t // {DAY} + 1 AS time, avg(value) AS value FROM e GROUP BY ALL), g AS (SELECT *, time - lag(time) OVER (PARTITION BY run_id ORDER BY time) AS gap FROM r)
SELECT run_id, count(*) AS rows, array_to_string(list_filter([CASE WHEN count(*) < 20 THEN 'few_rows' END, CASE WHEN min(time) <> 1 THEN 'wrong_start' END, CASE WHEN count(*) FILTER (WHERE gap <> 1) > 0 THEN 'uneven' END], lambda x: x IS NOT NULL), ',') AS faults FROM g GROUP BY run_id""")
def grid_faults(spark, d):
    days = tables.event_runs(spark, d).groupBy("run_id", (F.floor(F.col("t") / DAY) + 1).alias("time")).agg(F.avg("value").alias("value"))
    return loading.grid_faults(days, ["run_id"], "time", ["value"], 1.0, 20).withColumn("faults", F.array_join("faults", ","))


_STRATEGIES = {"click": ("decimation", "zero_filling"), "view": ("abs_max_pooling", "validate_only"), "purchase": ("decimation", "interpolation"), "error": ("abs_max_pooling", "interpolation")}


@query("resample_by_strategy", f"""WITH {_BINS}, p(signal, binning, filling) AS (VALUES {', '.join(f"('{s}', '{b}', '{f}')" for s, (b, f) in _STRATEGIES.items())}),
l AS (SELECT run_id, signal, bin, arg_max(value, t) AS last, arg_min(value, (-abs(value), t)) AS largest FROM x GROUP BY ALL),
c AS (SELECT run_id, signal, t, avg(value) AS value FROM e GROUP BY ALL), k AS (SELECT *, bin * {DAY} AS t FROM g),
b AS (SELECT k.*, c.t AS t0, c.value AS v0 FROM k ASOF LEFT JOIN c ON k.run_id = c.run_id AND k.signal = c.signal AND k.t >= c.t),
a AS (SELECT k.run_id, k.signal, k.bin, c.t AS t1, c.value AS v1 FROM k ASOF LEFT JOIN c ON k.run_id = c.run_id AND k.signal = c.signal AND k.t <= c.t),
i AS (SELECT run_id, signal, bin, coalesce(v0 + (v1 - v0) * (t - t0) / nullif(t1 - t0, 0), v0, v1) AS mid FROM b JOIN a USING (run_id, signal, bin))
SELECT i.run_id, i.signal, i.bin, {q("coalesce(CASE WHEN binning = 'decimation' THEN last ELSE largest END, CASE filling WHEN 'zero_filling' THEN 0 WHEN 'interpolation' THEN mid END)")} AS value FROM i JOIN p USING (signal) LEFT JOIN l USING (run_id, signal, bin)""")
def resample_by_strategy(spark, d):
    strategies = spark.createDataFrame([(s, *x) for s, x in _STRATEGIES.items()], "signal string, binning string, filling string")
    return loading.resample(tables.event_runs(spark, d), strategies, DAY).withColumn("value", X.scaled(F.col("value")))


_FIXED = "o AS (SELECT run_id, list(value ORDER BY {order}) AS o FROM {of} GROUP BY run_id), p AS (SELECT run_id, o, k, k * (len(o) - 1) / {last}::DOUBLE AS x FROM o, range({n}) r(k)), z AS (SELECT run_id, k, o[floor(x)::INT + 1] + (o[least(floor(x)::INT + 2, len(o))] - o[floor(x)::INT + 1]) * (x - floor(x)) AS value FROM p)"


@query("fixed_length", f"WITH {_EVENTS}, {_FIXED.format(order='t', of='e', last=23, n=24)} SELECT run_id, k, {q('value')} AS value FROM z")
def fixed_length(spark, d):
    return loading.fixed_length(tables.event_runs(spark, d), ["run_id"], "t", "value", 24).select("run_id", F.col("k").cast("long").alias("k"), X.scaled(F.col("value")).alias("value"))


@query("prepared_series", f"""WITH {_VECTORS}, h AS (SELECT *, CASE WHEN (run_id + pos) % 13 = 0 THEN NULL ELSE value END AS seen FROM v), w AS (SELECT run_id, pos, coalesce(seen, avg(seen) OVER (PARTITION BY run_id)) AS value FROM h),
b AS (SELECT run_id, pos // 6 AS block, avg(value) AS value FROM w GROUP BY ALL HAVING count(*) = 6), {_FIXED.format(order='block', of='b', last=15, n=16)}, s AS (SELECT *, avg(value) OVER (PARTITION BY run_id) AS m, stddev_pop(value) OVER (PARTITION BY run_id) AS s FROM z)
SELECT run_id, k, {q('(value - m) / CASE WHEN s < 1e-6 THEN 1 ELSE s END')} AS value FROM s""")
def prepared_series(spark, d):
    v = vectors(spark, d).withColumn("value", F.when((F.col("run_id") + F.col("pos")) % 13 == 0, float("nan")).otherwise(F.col("value")))
    return loading.prepared(v, ["run_id"], "pos", "value", 6, 16).select("run_id", F.col("k").cast("long").alias("k"), X.scaled(F.col("value")).alias("value"))


@query("capped_trace", f"WITH {_EVENTS}, n AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n, row_number() OVER (PARTITION BY run_id ORDER BY t) - 1 AS place FROM e) SELECT run_id, t, {q('value')} AS value FROM n WHERE place % ceil(n / 25.0)::BIGINT = 0")
def capped_trace(spark, d):
    """A trace for a plot: every stride-th row, so that at most 25 are left."""
    return loading.strided(tables.event_runs(spark, d), ["run_id"], "t", 25).select("run_id", "t", X.scaled(F.col("value")).alias("value"))


_DAYS = f"{_EVENTS}, y AS (SELECT run_id, signal, t // {DAY} AS day, min(value) AS value FROM e WHERE t < {12 * DAY} GROUP BY ALL)"


def days(spark, d, signal):
    e = tables.event_runs(spark, d).where((F.col("t") < 12 * DAY) & (F.col("signal") == signal))
    return e.groupBy("run_id", F.floor(F.col("t") / DAY).cast("long").alias("day")).agg(F.min("value").alias("value"))


@query("aligned_runs", f"""WITH {_DAYS}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id, signal ORDER BY day) AS place FROM y), a AS (FROM k WHERE signal = 'click'), b AS (FROM k WHERE signal = 'view')
SELECT run_id, count(a.day) AS rows_a, count(b.day) AS rows_b, bool_and(coalesce(a.day = b.day, false)) AS aligned FROM a FULL JOIN b USING (run_id, place) GROUP BY run_id""")
def aligned_runs(spark, d):
    """Whether two signals of a run have the same times."""
    return loading.aligned_runs(days(spark, d, "click"), days(spark, d, "view"), ["run_id"], "day")


@query("overlap_join", f"WITH {_EVENTS}, r AS (SELECT run_id, signal, round(t / 3.6e9, 1) AS hour, arg_min(value, t) AS v FROM e GROUP BY ALL) SELECT a.run_id, {q('hour')} AS hour, {q('a.v')} AS a, {q('b.v')} AS b FROM r a JOIN r b USING (run_id, hour) WHERE a.signal = 'click' AND b.signal = 'view'")
def overlap_join(spark, d):
    """Rows of two signals at the same time, to a tenth of an hour."""
    e = tables.event_runs(spark, d).withColumn("hour", F.col("t") / 3.6e9)
    a, b = (e.where(F.col("signal") == s).select("run_id", "hour", "value") for s in ("click", "view"))
    return loading.overlap(a, b, ["run_id"], "hour", 1).select("run_id", X.scaled(F.col("at")).alias("hour"), X.scaled(F.col("a")).alias("a"), X.scaled(F.col("b")).alias("b"))


@query("local_and_global_noise", f"""WITH {_EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t) AS place, value + sin(t % 1000) AS dirty FROM e), m AS (SELECT *, arg_min(place, (abs(t - {10 * DAY}), place)) OVER (PARTITION BY run_id) AS near FROM n),
g AS (SELECT run_id, sqrt(avg((dirty - value) ** 2)) AS n, sqrt(avg(value ** 2)) AS s, sqrt(avg((dirty - value) ** 2) FILTER (WHERE place - near BETWEEN -10 AND 30)) AS ln, sqrt(avg(value ** 2) FILTER (WHERE place - near BETWEEN -10 AND 30)) AS ls FROM m GROUP BY run_id)
SELECT run_id, {q('20 * log10(CASE WHEN n > 0 AND s > 0 THEN n / s END)')} AS global_db, {q('20 * log10(CASE WHEN ln > 0 AND ls > 0 THEN ln / ls END)')} AS local_db FROM g""")
def local_and_global_noise(spark, d):
    e = tables.event_runs(spark, d).select("run_id", "t", F.col("value").alias("clean"), (F.col("value") + F.sin(F.col("t") % 1000)).alias("dirty"))
    db = loading.quantified(e, ["run_id"], "t", F.lit(10 * DAY))
    return db.select("run_id", X.scaled(F.col("global_db")).alias("global_db"), X.scaled(F.col("local_db")).alias("local_db"))


@query("abs_correlation", f"""WITH {_PAIRS}, c AS (SELECT label, run_id, pos, CASE WHEN pos < 5 THEN 0 WHEN run_id % 17 = 0 THEN 1 ELSE value END AS a, CASE WHEN pos < 5 THEN 0 WHEN run_id % 17 = 0 AND run_id % 2 = 0 THEN 2 ELSE base END AS b FROM p), r AS (SELECT label, run_id, count(*) AS n, max(a) = min(a) AS fa, max(b) = min(b) AS fb, sum(a * b) - sum(a) * sum(b) / count(*) AS ab, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb FROM c WHERE pos >= 5 GROUP BY ALL)
SELECT label, run_id, {q('CASE WHEN fa AND fb THEN 1 WHEN fa OR fb THEN 0 ELSE least(1, abs(ab / sqrt(aa * bb))) END')} AS r FROM r""")
def abs_correlation(spark, d):
    """Correlation from the first row on that isn't 0 in both; flat runs have a value of their own."""
    p, zero, flat = pairs(spark, d), F.col("pos") < 5, F.col("run_id") % 17 == 0
    c = p.select("label", "run_id", "pos", F.when(zero, 0.0).when(flat, 1.0).otherwise(F.col("value")).alias("a"), F.when(zero, 0.0).when(flat & (F.col("run_id") % 2 == 0), 2.0).otherwise(F.col("base")).alias("b"))
    return loading.abs_correlation(c, ["label", "run_id"], "pos").withColumn("r", X.scaled(F.col("r")))


_KINDS = "CASE WHEN l_linenumber = 1 THEN 'baseline' WHEN l_linenumber % 2 = 0 THEN 'child' ELSE 'time0' END"


@query("told_from_two_references", f"""WITH r AS (SELECT l_suppkey AS family, l_linenumber AS run, {_KINDS} AS kind, l_returnflag AS signal, month(l_shipdate) AS t, avg(l_quantity) AS value FROM lineitem GROUP BY ALL),
th(signal, least) AS (VALUES ('A', 9.0), ('R', 8.0), ('N', 7.0)), own(run, child) AS (VALUES (3, 2), (5, 4), (7, 6)), ch AS (SELECT family, run AS child, signal, t, value AS own FROM r WHERE kind = 'child'), every AS (SELECT DISTINCT family, child FROM ch),
ref AS (SELECT family, child, signal, t, value AS ref, 'vs_baseline' AS against FROM r JOIN every USING (family) WHERE kind = 'baseline' UNION ALL SELECT family, child, signal, t, value, 'vs_time0' FROM r JOIN own USING (run) WHERE kind = 'time0'),
w AS (SELECT * FROM every, (VALUES ('vs_baseline'), ('vs_time0')) k(against)), b AS (SELECT * FROM (SELECT * FROM ch JOIN w USING (family, child)) FULL JOIN ref USING (family, child, signal, t, against)),
a AS (SELECT family, child, against, signal, sqrt(avg(CASE WHEN t >= 4 THEN (own - ref) ** 2 END)) AS rms, bool_and(own IS NOT NULL AND ref IS NOT NULL) AS aligned FROM b GROUP BY ALL),
o AS (SELECT family, child, against, CASE WHEN NOT bool_and(aligned) THEN 'error' WHEN bool_or(rms > least) THEN 'yes' ELSE 'no' END AS told FROM a JOIN th USING (signal) GROUP BY ALL)
SELECT family, child, vs_baseline, vs_time0, CASE WHEN vs_baseline <> 'yes' AND vs_time0 <> 'yes' THEN 'not told from baseline and time0' WHEN vs_baseline <> 'yes' THEN 'not told from baseline' WHEN vs_time0 <> 'yes' THEN 'not told from time0' END AS reason
FROM (SELECT w.family, w.child, coalesce(max(told) FILTER (WHERE w.against = 'vs_baseline'), 'error') AS vs_baseline, coalesce(max(told) FILTER (WHERE w.against = 'vs_time0'), 'error') AS vs_time0 FROM w LEFT JOIN o USING (family, child, against) GROUP BY ALL)""")
def told_from_two_references(spark, d):
    li = tables.table(spark, d, "lineitem")
    kind = F.when(F.col("l_linenumber") == 1, "baseline").when(F.col("l_linenumber") % 2 == 0, "child").otherwise("time0")
    runs = li.groupBy(F.col("l_suppkey").alias("family"), F.col("l_linenumber").alias("run"), kind.alias("kind"), F.col("l_returnflag").alias("signal"), F.month("l_shipdate").alias("t")).agg(F.avg("l_quantity").alias("value"))
    own = spark.createDataFrame([(3, 2), (5, 4), (7, 6)], "run int, child int")
    thresholds = spark.createDataFrame([("A", 9.0), ("R", 8.0), ("N", 7.0)], "signal string, least double")
    found = loading.against_two(runs, ["family"], "run", own, thresholds, F.lit(4))
    return found.withColumn("reason", loading.skip_reason(F.col("vs_baseline"), F.col("vs_time0"))).withColumn("child", F.col("child").cast("int"))


@query("overlay_rule", f"""WITH {_PAIRS}, s AS (SELECT label, run_id, corr(value, base) AS r, sum(value * base) / sqrt(sum(value ** 2) * sum(base ** 2)) AS c, sqrt(sum((value - base) ** 2)) / 1000 AS e FROM p GROUP BY ALL) SELECT label, run_id, (coalesce(r >= 0.99 AND c >= 0.99 AND isfinite(r) AND isfinite(c), false) OR coalesce(e <= 0.01 AND isfinite(e), false)) AS overlay FROM s""")
def overlay_rule(spark, d):
    p = pairs(spark, d).groupBy("label", "run_id")
    s = p.agg(F.corr("value", "base").alias("r"), (F.sum(F.expr("value * base")) / F.sqrt(F.sum(F.expr("value * value")) * F.sum(F.expr("base * base")))).alias("c"), (F.sqrt(F.sum(F.expr("(value - base) * (value - base)"))) / 1000).alias("e"))
    return s.select("label", "run_id", loading.overlays(F.col("r"), F.col("c"), F.col("e")).alias("overlay"))
