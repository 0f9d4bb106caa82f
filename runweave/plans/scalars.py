"""Queries over scalars: customers, parts and orders give the texts, choices and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import scalars as S
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


@query("expressions", f"""SELECT l_orderkey, l_linenumber, {q('l_extendedprice * (1 - l_discount) / (l_quantity - 10)')} AS net, CASE WHEN l_discount > 0.05 AND NOT abs(l_tax - 0.02) <= 1e-12 THEN 1 ELSE 0 END AS flag, {q('least(l_quantity ** 2, 900) + l_tax')} AS capped
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_quantity FROM lineitem) WHERE l_quantity <> 10
UNION ALL SELECT l_orderkey, l_linenumber, NULL, CASE WHEN l_discount > 0.05 AND NOT abs(l_tax - 0.02) <= 1e-12 THEN 1 ELSE 0 END, {q('least(l_quantity ** 2, 900) + l_tax')} FROM lineitem WHERE l_quantity = 10""")
def expressions(spark, d):
    """Users' arithmetic, in either notation, as columns."""
    names = ["l_extendedprice", "l_discount", "l_tax", "l_quantity"]
    li = tables.table(spark, d, "lineitem")
    net, flag, capped = (S.expression(x, names) for x in ("l_extendedprice .* (1 - l_discount) ./ (l_quantity - 10)", "(l_discount > 0.05) && (l_tax ~= 0.02)", "min(l_quantity ^ 2, 900) + l_tax"))
    return li.select("l_orderkey", "l_linenumber", X.scaled(net).alias("net"), flag.cast("int").alias("flag"), X.scaled(capped).alias("capped"))


@query("tokens_of_labels", "SELECT p_partkey, CASE WHEN regexp_matches(l, '(^|_)promo(_|$)') THEN 'few' WHEN regexp_matches(l, '(^|_)brass(_|$)') THEN 'one' WHEN regexp_matches(l, '(^|_)small(_|$)') THEN 'none' END AS shot FROM (SELECT p_partkey, lower(replace(p_type, ' ', '_')) AS l FROM part)")
def tokens_of_labels(spark, d):
    label = F.replace("p_type", F.lit(" "), F.lit("_"))
    return tables.table(spark, d, "part").select("p_partkey", S.token_of(label, {"promo": "few", "brass": "one", "small": "none"}).alias("shot"))


@query("labels_of_paths", "SELECT p_partkey, CASE WHEN suffix(n, 'RASS') THEN 'RASS' WHEN suffix(n, 'IN') THEN 'IN' WHEN suffix(n, 'SS') THEN 'SS' WHEN contains(n, 'RASS') THEN 'RASS' WHEN contains(n, 'IN') THEN 'IN' WHEN contains(n, 'SS') THEN 'SS' END AS label FROM (SELECT p_partkey, replace(p_type, '.', '') AS n FROM part)")
def labels_of_paths(spark, d):
    path = F.concat(F.lit("runs/"), F.replace("p_type", F.lit("."), F.lit("")), F.lit(".parquet"))
    return tables.table(spark, d, "part").select("p_partkey", S.label_of_path(path, ["SS", "RASS", "IN"]).alias("label"))


_TEXTS = "t AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'no' WHEN 2 THEN 'NaN' WHEN 3 THEN '12.0' WHEN 4 THEN '' WHEN 5 THEN '0' ELSE o_orderpriority END AS x FROM orders)"


@query("nullable_values", f"WITH {_TEXTS} SELECT o_orderkey, CASE WHEN lower(trim(x)) IN ('1', 'true', 'yes', 'y', 't', 'on') THEN true WHEN lower(trim(x)) IN ('0', 'false', 'no', 'n', 'f', 'off') THEN false END AS truth, CASE WHEN lower(trim(x)) NOT IN ('', 'nan', 'none', 'null') THEN TRY_CAST(CASE WHEN regexp_full_match(trim(x), '[0-9]+(\\.0+)?') THEN regexp_replace(trim(x), '\\.0+$', '') END AS BIGINT) END AS whole, CASE WHEN lower(trim(x)) IN ('yes', 'true', '1') THEN 'yes' WHEN lower(trim(x)) IN ('no', 'false', '0') THEN 'no' ELSE 'error' END AS verdict FROM t")
def nullable_values(spark, d):
    x = tables.table(spark, d, "orders")
    m = F.col("o_orderkey") % 7
    text = F.when(m == 0, " Yes ").when(m == 1, "no").when(m == 2, "NaN").when(m == 3, "12.0").when(m == 4, "").when(m == 5, "0").otherwise(F.col("o_orderpriority"))
    return x.select("o_orderkey", S.nullable_bool(text).alias("truth"), S.nullable_int(text).alias("whole"), S.tri_state(text).alias("verdict"))


@query("resolved_choices", "SELECT o_orderkey, CASE WHEN list_contains(c, a) THEN a WHEN len(list_filter(c, lambda x: lower(x) = lower(a))) = 1 THEN list_filter(c, lambda x: lower(x) = lower(a))[1] END AS choice FROM (SELECT o_orderkey, ['1-URGENT', '2-high', '2-High', '3-Medium', '5-LOW'] AS c, trim(CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END) AS a FROM orders)")
def resolved_choices(spark, d):
    choices = F.array(*map(F.lit, ["1-URGENT", "2-high", "2-High", "3-Medium", "5-LOW"]))
    answer = F.when(F.col("o_orderkey") % 3 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))
    return tables.table(spark, d, "orders").select("o_orderkey", S.resolved_choice(answer, choices).alias("choice"))


@query("significant_digits", "SELECT c_custkey, CASE WHEN c_acctbal = 0 THEN 0.0 ELSE floor(abs(c_acctbal) * m + 0.5) / m * sign(c_acctbal) END AS digits FROM (SELECT c_custkey, c_acctbal, 10.0::DOUBLE ** (2.0::DOUBLE - floor(log10(CASE WHEN c_acctbal = 0 THEN 1 ELSE abs(c_acctbal) END))) AS m FROM customer)")
def significant_digits(spark, d):
    return tables.table(spark, d, "customer").select("c_custkey", S.significant(F.col("c_acctbal"), 3).alias("digits"))


@query("subtree_ids", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(['c' || o_custkey], list('o' || o_orderkey), list('o' || (o_orderkey // 2))))), ',') AS ids FROM orders GROUP BY o_custkey")
def subtree_ids(spark, d):
    o = tables.table(spark, d, "orders").groupBy("o_custkey")
    text = lambda x: F.concat(F.lit("o"), x.cast("string"))
    kids = o.agg(F.collect_list(text(F.col("o_orderkey"))).alias("a"), F.collect_list(text(F.floor(F.col("o_orderkey") / 2))).alias("b"))
    return kids.select("o_custkey", F.array_join(F.array_sort(S.subtree(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.col("a"), F.col("b"))), ",").alias("ids"))


@query("valid_ratios", f"WITH e AS (SELECT user_id, event_id, value FROM events), l AS (SELECT user_id, list(CASE WHEN event_id % 500 = 3 THEN 'nan'::DOUBLE WHEN event_id % 50 = 4 THEN '-inf'::DOUBLE WHEN event_id % 20 = 5 THEN NULL ELSE value END) AS xs FROM e GROUP BY user_id) SELECT user_id, CASE WHEN len(list_filter(xs, lambda x: isnan(x) OR x = 'inf'::DOUBLE)) = 0 THEN len(xs) END AS n, {q('list_min(list_filter(xs, lambda x: isfinite(x)))')} AS least FROM l")
def valid_ratios(spark, d):
    i = F.col("event_id")
    x = F.when(i % 500 == 3, float("nan")).when(i % 50 == 4, float("-inf")).when(i % 20 == 5, None).otherwise(F.col("value"))
    some = F.collect_list(F.struct(x.alias("x")))["x"].alias("xs")  # keeps NULL
    xs = tables.table(spark, d, "events").groupBy("user_id").agg(some)
    return xs.select("user_id", F.size(S.valid_ratios(F.col("xs"))).cast("long").alias("n"), X.scaled(F.array_min(F.filter(F.transform("xs", S.json_safe), lambda v: v.isNotNull()))).alias("least"))


@query("sampling_specs", f"""WITH s AS (SELECT p_partkey, p_size / 10.0 AS low, CASE WHEN p_partkey % 7 = 0 THEN p_size / 10.0 - 1 ELSE p_size / 10.0 + p_partkey % 5 END AS high, CASE WHEN p_partkey % 3 = 0 THEN 'loguniform' ELSE 'uniform' END AS scale, (p_partkey % 101) / 101.0 AS u FROM part)
SELECT p_partkey, CASE WHEN low <= high THEN scale END AS scale, {q("CASE WHEN low <= high THEN CASE scale WHEN 'loguniform' THEN exp(ln(low) + u * (ln(high) - ln(low))) ELSE low + u * (high - low) END END")} AS value,
{q("CASE WHEN high > low THEN CASE WHEN scale = 'uniform' THEN CASE WHEN u * (high - low) * 0.75 < (high - low) * 0.25 THEN low + u * (high - low) * 0.75 ELSE low + (high - low) * 0.25 + u * (high - low) * 0.75 END END END")} AS outside FROM s""")
def sampling_specs(spark, d):
    """Intervals given as JSON, drawn on their scale, whole and (uniform ones) without their second quarter."""
    low = F.col("p_size") / 10.0
    high = F.when(F.col("p_partkey") % 7 == 0, low - 1).otherwise(low + F.col("p_partkey") % 5)
    scale = F.when(F.col("p_partkey") % 3 == 0, "loguniform").otherwise("uniform")
    text = F.to_json(F.struct(F.array(low, high).alias("interval"), scale.alias("distribution")))
    p = tables.table(spark, d, "part").select("p_partkey", S.sampling(text).alias("s"), ((F.col("p_partkey") % 101) / 101.0).alias("u"))
    low, width = F.col("s.low"), F.col("s.high") - F.col("s.low")
    outside = F.when(F.col("s.scale") == "uniform", S.drawn_outside(F.col("s"), F.col("u"), low + width * 0.25, low + width * 0.5))
    return p.select("p_partkey", F.col("s.scale").alias("scale"), X.scaled(S.drawn(F.col("s"), F.col("u"))).alias("value"), X.scaled(outside).alias("outside"))


@query("nested_matrix", "WITH m AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY ALL), k AS (SELECT DISTINCT o_orderstatus AS x FROM orders), s AS (SELECT x.x AS a, y.x AS b, (SELECT sum(n) FROM m WHERE m.b = x.x) + (SELECT sum(n) FROM m WHERE m.b = y.x) AS n FROM k x, k y) SELECT a, b, n::BIGINT AS n FROM s")
def nested_matrix(spark, d):
    """A square matrix by names, to a map of maps and back."""
    n = tables.table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = n.agg(F.array_sort(F.collect_list(F.struct("o_orderstatus", "n"))).alias("own"))  # a row for each of few states
    names = F.col("own.o_orderstatus")
    rows = F.transform("own", lambda a: F.transform("own", lambda b: a["n"] + b["n"]))
    back = one.select(names.alias("names"), S.matrix(names, S.nested(names, rows)).alias("rows"))
    cells = back.select("names", F.posexplode("rows").alias("i", "row")).select("names", "i", F.posexplode("row").alias("j", "n"))
    return cells.select(F.get("names", "i").alias("a"), F.get("names", "j").alias("b"), F.col("n").cast("long").alias("n"))


@query("identity_numbers", "SELECT l_orderkey, l_linenumber, CASE WHEN x = 0 THEN '0' WHEN x = floor(x) THEN x::BIGINT::VARCHAR ELSE x::VARCHAR END AS number FROM (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 2 AS x FROM lineitem)")
def identity_numbers(spark, d):
    return tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.identity_number(((F.col("l_quantity") - 25) / 2).cast("string")).alias("number"))


@query("orders_of_labels", "SELECT DISTINCT o_orderpriority AS label, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 ELSE dense_rank() OVER (ORDER BY CASE WHEN o_orderpriority IN ('5-LOW', '1-URGENT', '3-MEDIUM') THEN 2 ELSE 1 END, o_orderpriority) + 1 END AS place FROM orders WHERE o_orderpriority <> '3-MEDIUM' UNION ALL SELECT '3-MEDIUM', count(DISTINCT o_orderpriority) - 1 FROM orders HAVING count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') > 0")
def orders_of_labels(spark, d):
    """Labels by a preferred order, then by name, the no-change label last."""
    labels = tables.table(spark, d, "orders").select(F.col("o_orderpriority").alias("label")).distinct()
    return X.label_order(labels, "label", ["5-LOW", "1-URGENT"], "3-MEDIUM")


@query("first_seen_order", "WITH f AS (SELECT conv_id, text, min(turn) AS first FROM conversations GROUP BY ALL) SELECT conv_id, count(*) AS kinds, sum(first)::BIGINT AS firsts FROM f GROUP BY conv_id")
def first_seen_order(spark, d):
    """Distinct texts of a conversation in the order of their first turn."""
    c = tables.table(spark, d, "conversations")
    return X.first_seen(c, ["conv_id"], "text", "turn").groupBy("conv_id").agg(F.count(F.lit(1)).alias("kinds"), F.sum("first").alias("firsts"))


@query("chronological_nulls_last", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 9 <> 0 THEN ts END ASC NULLS LAST, event_id) AS place FROM events")
def chronological(spark, d):
    """Rows by time, those without one last in their first order."""
    e = tables.table(spark, d, "events").withColumn("ts", F.when(F.col("event_id") % 9 != 0, F.col("ts")))
    return X.chronological(e, ["user_id"], "ts", "event_id").select("event_id", "user_id", F.col("place").cast("long").alias("place"))


@query("sorted_groups", "SELECT o_custkey, o_orderstatus, sha256(string_agg(o_orderkey || ':' || o_orderpriority, ',' ORDER BY o_orderkey)) AS digest, count(*) AS members FROM orders GROUP BY ALL")
def sorted_groups(spark, d):
    """The members of each manifest group (a customer's orders of a status, few by the data's contract), sorted by id, as one digest."""
    o = tables.table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus")
    own = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    texts = F.transform(own, lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["o_orderpriority"]))
    return o.agg(F.sha2(F.array_join(texts, ","), 256).alias("digest"), F.count(F.lit(1)).alias("members"))


@query("remapped_labels", "WITH l AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM (SELECT DISTINCT label FROM embeddings)) SELECT vec_id, 'L' || k AS label FROM embeddings JOIN l USING (label)")
def remapped_labels(spark, d):
    """Labels by anonymous names, the k-th for the k-th in order."""
    e = tables.table(spark, d, "embeddings").select("vec_id", "label")
    index = X.label_order(e.select("label").distinct(), "label", [], None)
    return e.join(index, "label").select("vec_id", F.concat(F.lit("L"), F.col("place").cast("string")).alias("label"))
