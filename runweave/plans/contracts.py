"""Queries over plug-ins, contracts, aliases and choices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import pairs as pair_distances
from ..operators import aliases, plugins
from ..sources import tables
from .kernels import _EVENTS, _PAIRS, _VECTORS, DAY, pairs, q, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


@query("rule_predictions", f"WITH {_VECTORS}, m AS (SELECT run_id, arg_max(pos, (abs(value), -pos)) AS place FROM v GROUP BY run_id) SELECT run_id, CASE WHEN place < 32 THEN 'early' ELSE 'late' END AS prediction, place::DOUBLE AS change_time, false AS failed FROM m")
def rule_predictions(spark, d):
    """A user's rule, run on each trajectory: is the largest magnitude in the first half?"""

    def predict(run):
        at = int(run.value.abs().to_numpy().argmax())
        return {"final_answer": "early" if at < 32 else "late", "change_time": float(run.pos[at])}

    said = plugins.apply_rule(vectors(spark, d), ["run_id"], "pos", predict, {"early", "late"})
    return said.select("run_id", F.col("predictions")[0].alias("prediction"), "change_time", F.col("error").isNotNull().alias("failed"))


@query("feature_hook", f"WITH {_VECTORS} SELECT run_id, {q('max(value)')} AS most, {q('min(value)')} AS least FROM v GROUP BY run_id")
def feature_hook(spark, d):
    f = plugins.apply_features(vectors(spark, d), ["run_id"], "pos", lambda run: {"most": run.value.max(), "least": run.value.min()})
    return f.select("run_id", X.scaled(F.col("features")["most"]).alias("most"), X.scaled(F.col("features")["least"]).alias("least"))


@query("detectability_hook", f"WITH {_EVENTS}, r AS (SELECT run_id, max(abs(value)) FILTER (WHERE signal = 'click') AS a, max(abs(value)) FILTER (WHERE signal = 'view') AS b FROM e GROUP BY run_id) SELECT run_id, coalesce(a > b, true) AS detectable FROM r WHERE a IS NOT NULL")
def detectability_hook(spark, d):
    """A user's test of each run beside its reference."""
    e = tables.event_runs(spark, d).select("run_id", "signal", "t", "value")
    runs, references = (e.where(F.col("signal") == s).drop("signal") for s in ("click", "view"))

    def louder(run, reference):
        import pandas as pd

        return pd.DataFrame({"detectable": [reference.empty or bool(run.value.abs().max() > reference.value.abs().max())]})

    return plugins.apply_beside(runs, references, ["run_id"], "t", louder, "detectable boolean")


@query("strict_mean_ratio", f"SELECT l_suppkey, {q('CASE WHEN count(nullif(l_discount, 0)) = count(*) THEN avg(l_tax / nullif(l_discount, 0)) END')} AS strict, {q('avg(l_tax / nullif(l_discount, 0))')} AS skipping, {q('coalesce(avg(l_tax / nullif(l_discount, 0)), 0)')} AS zero FROM lineitem GROUP BY l_suppkey")
def strict_mean(spark, d):
    r = F.try_divide(F.col("l_tax"), F.nullif(F.col("l_discount"), F.lit(0.0)))
    g = tables.table(spark, d, "lineitem").withColumn("r", r).groupBy("l_suppkey")
    strict = F.when(F.count("r") == F.count(F.lit(1)), F.avg("r"))
    return g.agg(X.scaled(strict).alias("strict"), X.scaled(F.avg("r")).alias("skipping"), X.scaled(F.coalesce(F.avg("r"), F.lit(0.0))).alias("zero"))


@query("plan_registry", "WITH o AS (SELECT o_custkey, count(*) AS children, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, CASE WHEN min(o_orderpriority) = max(o_orderpriority) THEN min(o_orderpriority) END AS common FROM orders GROUP BY 1) SELECT c_custkey, coalesce(children, 0) AS children, coalesce(failed, 0) AS failed, common FROM customer LEFT JOIN o ON c_custkey = o_custkey")
def plan_registry(spark, d):
    """Baselines with their children's number, failures, and setting where all share one."""
    low, high = F.min("o_orderpriority"), F.max("o_orderpriority")
    o = tables.table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.when(low == high, low).alias("common"))
    return tables.table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("children"), F.coalesce("f", F.lit(0)).alias("failed"), "common")


@query("rollout_plan", "SELECT agent, o_orderpriority AS slug, count(*) AS questions FROM orders, (SELECT unnest(['a', 'b', 'c']) AS agent) GROUP BY ALL")
def rollout_plan(spark, d):
    """Each question once for each of the listed agents."""
    agents = F.explode(F.array(*map(F.lit, "abc")))
    return tables.table(spark, d, "orders").select(agents.alias("agent"), F.col("o_orderpriority").alias("slug")).groupBy("agent", "slug").agg(F.count(F.lit(1)).alias("questions"))


_TOKENS = """list_distinct(list_concat({w}, list_transform(list_filter({w}, lambda w: ends_with(w, 's') AND length(w) > 3), lambda w: w[:-2])))"""
_WORDS = "list_filter(string_split_regex(replace(replace(lower({x}), '_', ' '), '-', ' '), '\\s+'), lambda w: w <> '')"


def _tokens(x: str) -> str:
    """SQL for the words of a name, with singulars, where bolt and gear stand for each other."""
    both = _TOKENS.format(w=_WORDS.format(x=x))
    return f"list_distinct(list_concat({both}, CASE WHEN list_contains({both}, 'bolt') THEN ['gear'] ELSE [] END, CASE WHEN list_contains({both}, 'gear') THEN ['bolt'] ELSE [] END))"


@query("alias_match", f"WITH n AS (SELECT DISTINCT p_brand AS brand, p_type || ' ' || p_name AS name, {_tokens("p_type || ' ' || p_name")} AS words FROM part), c AS (SELECT DISTINCT p_brand AS brand, p_name AS candidate, p_type AS described, p_size * 1000 + p_partkey % 1000 AS place FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) = 1), o AS (SELECT *, list_distinct(list_concat({_tokens('candidate')}, {_tokens('described')})) AS words FROM c), s AS (SELECT n.brand, name, candidate, place, len(list_intersect(n.words, o.words)) AS shared, len(o.words) AS own FROM n JOIN o USING (brand)), m AS (SELECT *, max(shared) OVER (PARTITION BY brand, name) AS most FROM s), p AS (SELECT brand, name, most AS shared, arg_min(candidate, (-own, place, candidate)) AS candidate, max(place) > arg_min(place, (-own, place, candidate)) AS ambiguous FROM m WHERE shared = most AND most > 0 GROUP BY brand, name, most) SELECT brand, name, CASE WHEN NOT ambiguous THEN candidate END AS candidate, shared, ambiguous FROM p")
def alias_match(spark, d):
    """Types and names of parts by the name of their brand that shares most words with them."""
    p = tables.table(spark, d, "part")
    first = Window.partitionBy("p_brand", "p_name").orderBy("p_partkey")
    c = p.withColumn("k", F.row_number().over(first)).where("k = 1")
    c = c.select(F.col("p_brand").alias("brand"), F.col("p_name").alias("candidate"), (F.col("p_size") * 1000 + F.col("p_partkey") % 1000).alias("place"), F.col("p_type").alias("more"))
    n = p.select(F.col("p_brand").alias("brand"), F.concat_ws(" ", "p_type", "p_name").alias("name"))
    return aliases.alias_match(n, c, ["brand"], {"bolt": ["gear"], "gear": ["bolt"]})


@query("parameter_bindings", "SELECT w AS binding, count(*) AS parameters, min(p_partkey) AS first FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part) GROUP BY w")
def bindings(spark, d):
    p = tables.table(spark, d, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("binding"))
    return p.groupBy("binding").agg(F.count(F.lit(1)).alias("parameters"), F.min("p_partkey").alias("first"))


def _chosen(runs: int) -> str:
    """SQL for every choice of one run of each label of a family of so many consecutive runs, with its least distance in ten-thousandths."""
    return f"""WITH RECURSIVE {_VECTORS}, f AS (SELECT *, run_id // {runs} AS family FROM v), r AS (SELECT family, run_id, label, dense_rank() OVER (PARTITION BY family ORDER BY label) AS turn FROM (SELECT DISTINCT family, run_id, label FROM f)),
m AS (SELECT a.family, a.run_id AS a_id, b.run_id AS b_id, {q('avg((a.value - b.value) ** 2)')} AS mse FROM f a JOIN f b ON a.family = b.family AND a.pos = b.pos AND a.run_id < b.run_id GROUP BY ALL),
c AS (SELECT family, turn, [run_id] AS choice, NULL::BIGINT AS separation FROM r WHERE turn = 1
UNION ALL SELECT c.family, r.turn, list_append(c.choice, r.run_id), least(c.separation, (SELECT min(mse) FROM m WHERE m.family = c.family AND ((m.b_id = r.run_id AND list_contains(c.choice, m.a_id)) OR (m.a_id = r.run_id AND list_contains(c.choice, m.b_id))))) FROM c JOIN r ON r.family = c.family AND r.turn = c.turn + 1),
w AS (SELECT family, array_to_string(choice, ',') AS choice, choice AS ids, separation FROM c SEMI JOIN (SELECT family, max(turn) AS turn FROM r GROUP BY family) e USING (family, turn) WHERE turn > 1)"""


def _families(spark, d, runs: int):
    """Vectors of so many consecutive ids as a family, and the distances of its pairs in ten-thousandths."""
    r = vectors(spark, d).withColumn("family", F.floor(F.col("run_id") / runs))
    return r, pair_distances.pairwise_mse(r, "family").withColumn("mse", X.scaled(F.col("mse")).cast("double"))


@query("choice_combinations", f"{_chosen(12)} SELECT family, choice, separation FROM w")
def combinations(spark, d):
    """Every choice of one run of each label, in families of twelve runs, and how far apart its nearest two are."""
    r, p = _families(spark, d, 12)
    found = pair_distances.separation(pair_distances.every_choice(r, "family", "label"), p, "family")
    return found.select("family", F.array_join("choice", ",").alias("choice"), F.col("separation").cast("long").alias("separation"))


@query("best_separated_choice", f"{_chosen(16)} SELECT family, arg_min(choice, (-separation, ids)) AS choice, max(separation) AS separation FROM w GROUP BY family")
def best_choice(spark, d):
    """The best separated choice of each family of sixteen runs, found without listing the choices."""
    r, p = _families(spark, d, 16)
    best = pair_distances.best_separated_choice(p, r, "family", "label")
    return best.select("family", F.array_join("choice", ",").alias("choice"), F.col("separation").cast("long").alias("separation"))


@query("early_stop", f"WITH {_PAIRS}, l AS (SELECT label, run_id, avg((value - base) ** 2) AS loss, max(avg(base ** 2)) OVER (PARTITION BY label) AS ref FROM p GROUP BY label, run_id) SELECT label, bool_and(abs(loss - ref) <= 1.5 * ref) AS stop, {q('min(loss)')} AS best, arg_min(run_id, ({q('loss')}, run_id)) AS run_id FROM l GROUP BY label")
def early_stop(spark, d):
    """Whether all losses of a family lie within a share of the baseline's, and the run with the least."""
    l = pairs(spark, d).groupBy("label", "run_id").agg(F.avg(F.pow(F.col("value") - F.col("base"), 2)).alias("loss"), F.avg(F.pow("base", F.lit(2))).alias("own"))  # noqa: E741
    l = l.withColumn("ref", F.max("own").over(Window.partitionBy("label")))  # noqa: E741
    near = F.bool_and(F.abs(F.col("loss") - F.col("ref")) <= 1.5 * F.col("ref"))
    return l.groupBy("label").agg(near.alias("stop"), X.scaled(F.min("loss")).alias("best"), F.min(F.struct(X.scaled(F.col("loss")).alias("x"), "run_id"))["run_id"].alias("run_id"))


@query("candidate_roll_up", f"WITH l AS (SELECT l_orderkey AS child, l_linenumber AS parameter, {q('min(l_discount)')} AS loss FROM lineitem GROUP BY ALL), t AS (SELECT o_orderkey AS child, o_orderkey % 4 + 1 AS truth FROM orders) SELECT child, truth, string_agg(parameter || ':' || loss, ',' ORDER BY parameter) AS losses, coalesce(bool_or(parameter = truth), false) AS tried FROM t LEFT JOIN l USING (child) GROUP BY ALL")
def roll_up(spark, d):
    """Losses of a child's candidate parameters, and whether the true one is among them."""
    l = tables.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("child"), F.col("l_linenumber").alias("parameter")).agg(X.scaled(F.min("l_discount")).alias("loss"))  # noqa: E741
    per = l.groupBy("child").agg(F.array_sort(F.collect_list(F.struct("parameter", "loss"))).alias("all"))
    t = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("child"), (F.col("o_orderkey") % 4 + 1).alias("truth")).join(per, "child", "left")
    text = F.array_join(F.transform("all", lambda x: F.concat(x.parameter.cast("string"), F.lit(":"), x.loss.cast("string"))), ",")
    return t.select("child", "truth", text.alias("losses"), F.coalesce(F.exists("all", lambda x: x.parameter == F.col("truth")), F.lit(False)).alias("tried"))


@query("graph_contract", "WITH e AS (SELECT l_orderkey AS a, l_partkey AS b FROM lineitem) SELECT 'unknown target' AS rule, count(*) AS n FROM e WHERE b NOT IN (SELECT p_partkey FROM part WHERE p_size > 3) UNION ALL SELECT 'repeated node', count(*) FROM (SELECT 1 FROM part GROUP BY p_brand, p_type, p_size HAVING count(*) > 1) UNION ALL SELECT 'repeated edge', count(*) FROM (SELECT 1 FROM e GROUP BY ALL HAVING count(*) > 1)".replace("SELECT 1 FROM e GROUP BY ALL", "SELECT 1 FROM e GROUP BY a, b"))
def graph_contract(spark, d):
    e, p = tables.table(spark, d, "lineitem"), tables.table(spark, d, "part")
    n = lambda df, rule: df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"))
    unknown = e.join(p.where("p_size > 3"), F.col("l_partkey") == F.col("p_partkey"), "left_anti")
    nodes = p.groupBy("p_brand", "p_type", "p_size").count().where("count > 1")
    edges = e.groupBy("l_orderkey", "l_partkey").count().where("count > 1")
    return n(unknown, "unknown target").union(n(nodes, "repeated node")).union(n(edges, "repeated edge"))


@query("entry_formats", "SELECT o_orderstatus, count(*) FILTER (WHERE regexp_matches(md5(o_orderpriority || o_orderkey), '^[0-9a-f]{32}$')) AS hashes, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) AS known, count(*) FILTER (WHERE o_totalprice >= 0 AND isfinite(o_totalprice)) AS finite FROM orders GROUP BY o_orderstatus")
def entry_formats(spark, d):
    hashed = F.md5(F.concat("o_orderpriority", F.col("o_orderkey").cast("string")))
    return tables.table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_if(hashed.rlike("^[0-9a-f]{32}$")).alias("hashes"), F.count_if(F.col("o_orderstatus").isin("F", "O")).alias("known"), F.count_if((F.col("o_totalprice") >= 0) & X.finite(F.col("o_totalprice"))).alias("finite"))


@query("first_diff_contract", f"WITH {_EVENTS}, f AS (SELECT run_id, signal, min(t) FILTER (WHERE abs(value) > 100) AS first FROM e GROUP BY ALL) SELECT run_id, bool_and(coalesce(first, 0) >= 0) AS valid, coalesce(bool_or(first >= {3 * DAY}), false) AS after, count(*) - count(first) AS missing FROM f GROUP BY run_id")
def first_diff_contract(spark, d):
    """First differences are null or not negative, and one of them is not before the intervention."""
    f = tables.event_runs(spark, d).groupBy("run_id", "signal").agg(F.min(F.when(F.abs("value") > 100, F.col("t"))).alias("first"))
    return f.groupBy("run_id").agg(F.bool_and(F.coalesce("first", F.lit(0)) >= 0).alias("valid"), F.coalesce(F.bool_or(F.col("first") >= 3 * DAY), F.lit(False)).alias("after"), (F.count(F.lit(1)) - F.count("first")).alias("missing"))


@query("artifact_buckets", r"SELECT CASE WHEN u LIKE '%.html' THEN 'page' WHEN u LIKE '%/' THEN 'folder' ELSE 'other' END AS bucket, count(*) AS n, min(page_id) AS first FROM (SELECT page_id, lower(coalesce(url, '')) AS u FROM pages) GROUP BY bucket")
def buckets(spark, d):
    u = F.lower(F.coalesce("url", F.lit("")))
    kind = F.when(u.endswith(".html"), "page").when(u.endswith("/"), "folder").otherwise("other")
    return tables.table(spark, d, "pages").groupBy(kind.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
