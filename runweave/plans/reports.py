"""Queries over results and registries: scores, consolidation, report tables, joins, sets, constraints, identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import draws, paging, report, scores, windows
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


_RESULTS = "r AS (SELECT o_orderpriority AS model, c_mktsegment AS dataset, l_returnflag AS shot, l_linestatus AS context, l_discount AS score, l_quantity AS answers, o_orderkey AS batch FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"


def results(spark: SparkSession, d: str) -> DataFrame:
    """The results fact table: a score for each model, dataset, shot and context."""
    li = tables.table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_discount", "l_quantity")
    o = tables.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = tables.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    joined = li.join(o.join(c, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_orderpriority").alias("model"), F.col("c_mktsegment").alias("dataset"), F.col("l_returnflag").alias("shot"), F.col("l_linestatus").alias("context"), F.col("l_discount").alias("score"), F.col("l_quantity").alias("answers"), F.col("o_orderkey").alias("batch"))


@query("grouped_mean_table", f"WITH {_RESULTS} SELECT shot, model, dataset, context, {q('avg(score)')} AS mean, {q('stddev_pop(score)')} AS spread, count(score) AS n FROM r GROUP BY ALL")
def grouped_mean(spark, d):
    t = report.mean_table(results(spark, d), ["shot", "model", "dataset", "context"], "score")
    return t.withColumn("mean", X.scaled(F.col("mean"))).withColumn("spread", X.scaled(F.col("spread")))


def _gain_sql(keys: str, by: str, base: str, target: str) -> str:
    return f"WITH {_RESULTS}, g AS (SELECT {keys}, avg(score) FILTER (WHERE {by} = '{base}') AS b, avg(score) FILTER (WHERE {by} = '{target}') AS t FROM r GROUP BY ALL) SELECT {keys}, {q('b')} AS base, {q('t')} AS target, {q('t - b')} AS gain FROM g WHERE b IS NOT NULL AND t IS NOT NULL"


def _gain(spark, d, keys, by, base, target):
    return report.gain(results(spark, d), keys, by, base, target, "score").select(*keys, *(X.scaled(F.col(c)).alias(c) for c in ("base", "target", "gain")))


@query("shot_gain", _gain_sql("model, dataset, context", "shot", "N", "R"))
def shot_gain(spark, d):
    return _gain(spark, d, ["model", "dataset", "context"], "shot", "N", "R")


@query("context_gain", _gain_sql("model, shot", "context", "F", "O"))
def context_gain(spark, d):
    return _gain(spark, d, ["model", "shot"], "context", "F", "O")


@query("average_rank", f"WITH {_RESULTS}, m AS (SELECT shot, context, dataset, model, {q('avg(score)')} AS mean FROM r GROUP BY ALL), k AS (SELECT *, rank() OVER (PARTITION BY shot, context, dataset ORDER BY mean DESC) + (count(*) OVER (PARTITION BY shot, context, dataset, mean) - 1) / 2.0 AS k FROM m) SELECT model, {q('avg(k)')} AS average_rank FROM k GROUP BY model")
def average_rank(spark, d):
    keys = ["shot", "context", "dataset"]
    m = results(spark, d).groupBy(*keys, "model").agg(X.scaled(F.avg("score")).alias("mean"))
    return m.withColumn("k", windows.average_rank("mean", keys)).groupBy("model").agg(X.scaled(F.avg("k")).alias("average_rank"))


@query("best_method", f"WITH {_RESULTS}, m AS (SELECT dataset, model, {q('avg(score)')} AS s FROM r GROUP BY ALL) SELECT dataset, arg_min(model, (-s, model)) AS best, max(s) AS score FROM m GROUP BY dataset")
def best_method(spark, d):
    m = results(spark, d).groupBy("dataset", "model").agg(X.scaled(F.avg("score")).alias("s"))
    return report.best_by(m, ["dataset"], "model", "s")


@query("main_table_unpivot", f"WITH {_RESULTS}, u AS (SELECT model, shot, 'score' AS metric, 100 * avg(score) AS v FROM r GROUP BY ALL UNION ALL SELECT model, shot, 'answers', avg(answers) FROM r GROUP BY ALL) SELECT model, shot, metric, {q('v')} AS value FROM u")
def main_table(spark, d):
    t = results(spark, d).groupBy("model", "shot").agg((100 * F.avg("score")).alias("score"), F.avg("answers").alias("answers"))
    return t.unpivot(["model", "shot"], ["score", "answers"], "metric", "value").withColumn("value", X.scaled(F.col("value")))


@query("complete_seed_families", f"WITH {_RESULTS}, f AS (SELECT model, dataset, batch % 997 AS family, count(*) AS rows, list(DISTINCT shot) AS have FROM r GROUP BY ALL) SELECT model, dataset, family, rows, CAST(len(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(have, x))) AS BIGINT) AS missing FROM f")
def complete_families(spark, d):
    r = results(spark, d).withColumn("family", F.col("batch") % 997)
    return report.complete_families(r, ["model", "dataset", "family"], "shot", ["A", "N", "R"]).withColumn("missing", F.col("missing").cast("long"))


@query("newest_configuration", "WITH k AS (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority DESC) AS age FROM orders) SELECT o_custkey, o_orderkey, o_orderpriority FROM k WHERE age = 1")
def newest(spark, d):
    return windows.newest(tables.table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderpriority").select("o_custkey", "o_orderkey", "o_orderpriority")


@query("accuracy_by_mode", f"WITH s AS (SELECT o_orderpriority AS mode, o_orderstatus AS status FROM orders), a AS (SELECT mode, count(*) AS n, count(*) FILTER (WHERE status = 'F') AS correct, count(*) FILTER (WHERE status <> 'P') AS evaluable FROM s GROUP BY mode) SELECT mode, n, correct, evaluable, {q('correct / nullif(evaluable, 0)')} AS accuracy, {q('(correct / evaluable - 0.5) / 0.5')} AS corrected FROM a")
def accuracy(spark, d):
    s = F.col("o_orderstatus")
    found = scores.accuracy_by(tables.table(spark, d, "orders").withColumnRenamed("o_orderpriority", "mode"), ["mode"], s == "F", s != "P", 2)
    return found.withColumns({c: X.scaled(F.col(c)) for c in ("accuracy", "corrected")})


@query("final_metrics", f"WITH s AS (SELECT o_custkey AS run, CASE o_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN ' test' ELSE 'other' END AS kind, o_orderstatus = 'F' AS top1, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 4)::DOUBLE / 4 END AS score, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 END AS answers FROM orders), t AS (SELECT DISTINCT run, unnest(['train', 'test', 'held']) AS sample_type FROM s) SELECT t.run, sample_type, {q('coalesce(avg(coalesce(top1, false)::INT) FILTER (WHERE s.run IS NOT NULL), 0)')} AS top1, {q('coalesce(avg(coalesce(score, 0)) FILTER (WHERE s.run IS NOT NULL), 0)')} AS shortlist, {q('coalesce(avg(answers), 0)')} AS answers FROM t LEFT JOIN s ON s.run = t.run AND trim(kind) = sample_type GROUP BY ALL")
def final_metrics(spark, d):
    """Figures of each kind of sample, zeros where there is none."""
    k = F.col("o_orderkey")
    rows = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.when(k % 3 == 0, "train").when(k % 3 == 1, " test").otherwise("other").alias("sample_type"), (F.col("o_orderstatus") == "F").alias("top1_correct"), F.when(k % 4 > 0, (k % 4) / 4.0).alias("shortlist_score"), F.when(k % 5 > 0, k % 5).alias("num_answers"))
    found = scores.by_sample_type(rows, ["run"], ["train", "test", "held"])
    return found.select("run", "sample_type", *(X.scaled(F.col(c)).alias(c) for c in ("top1", "shortlist", "answers")))


@query("shortlist_score", f"WITH p AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey % 7)) AS answers FROM lineitem GROUP BY 1) SELECT k, {q('CASE WHEN list_contains(answers, k % 7) THEN 1.0 / len(answers) ELSE 0 END')} AS score FROM p")
def shortlist(spark, d):
    p = tables.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.col("l_suppkey") % 7).alias("answers"))
    return p.select("k", X.scaled(X.shortlist_score(F.col("answers"), F.col("k") % 7)).alias("score"))


@query("registry_status", "WITH k AS (SELECT c_custkey, n_name, r_name, max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 WHEN 'P' THEN 1 END) AS s, count(o_orderkey) AS runs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) SELECT r_name, n_name, count(*) AS children, sum(runs)::BIGINT AS runs, CASE max(coalesce(s, 0)) WHEN 3 THEN 'failed' WHEN 2 THEN 'success' ELSE 'not_run' END AS status FROM k GROUP BY ALL")
def registry(spark, d):
    t = lambda n: tables.table(spark, d, n)
    level = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).when(F.col("o_orderstatus") == "P", 1)
    runs = t("orders").groupBy("o_custkey").agg(F.max(level).alias("s"), F.count(F.lit(1)).alias("runs"))
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = t("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).join(runs, F.col("c_custkey") == F.col("o_custkey"), "left")
    worst = F.max(F.coalesce("s", F.lit(0)))
    return k.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("children"), F.sum(F.coalesce("runs", F.lit(0))).alias("runs"), F.when(worst == 3, "failed").when(worst == 2, "success").otherwise("not_run").alias("status"))


@query("orphan_runs", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphans(spark, d):
    return tables.table(spark, d, "customer").join(tables.table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


#: Pages asked for (number, size), some beyond what there is.
PAGES = ((1, 0), (3, 50), (2, 5_000), (1_000_000, 250))


@query("page_of_families", f"WITH k AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS pos, count(*) OVER () AS total FROM customer), a(asked, size) AS (VALUES {', '.join(str(p) for p in PAGES)}), z AS (SELECT asked, least(CASE WHEN size > 0 THEN size ELSE 250 END, 1000) AS page_size FROM a), p AS (SELECT k.*, page_size, ceil(total / page_size)::BIGINT AS pages, asked, least(asked, ceil(total / page_size))::BIGINT AS page FROM k, z) SELECT asked, page, page_size, pages, total, c_custkey, c_name, page > 1 AS has_previous, page < pages AS has_next FROM p WHERE pos BETWEEN (page - 1) * page_size + 1 AND page * page_size")
def page(spark, d):
    """Pages of customers, each found by counts of ranges of the key."""
    c = tables.table(spark, d, "customer").select("c_custkey", "c_name")
    out = None
    for asked, size in PAGES:
        p = paging.page_of(c, "c_custkey", asked, size)
        facts = {"asked": asked, "page": p.page, "page_size": p.page_size, "pages": p.total_pages, "total": p.total, "has_previous": p.has_previous, "has_next": p.has_next}
        rows = p.rows.withColumns({k: F.lit(v) for k, v in facts.items()})
        out = rows if out is None else out.unionByName(rows)
    return out


@query("common_models", "SELECT p_brand FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) = (SELECT count(DISTINCT p_type) FROM part)")
def common_models(spark, d):
    p = tables.table(spark, d, "part")
    n = p.agg(F.count_distinct("p_type").alias("n"))
    return p.groupBy("p_brand").agg(F.count_distinct("p_type").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("p_brand")


@query("train_test_sets", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'N') SELECT 'both' AS part, count(*) AS n FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'train', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'any', count(*) FROM (FROM a UNION FROM b)")
def sets(spark, d):
    li = tables.table(spark, d, "lineitem")
    a, b = (li.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k")).distinct() for f in "AN")
    n = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return n(a.intersect(b), "both").union(n(a.exceptAll(b), "train")).union(n(a.union(b).distinct(), "any"))


@query("balanced_sample", "WITH k AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || vec_id), vec_id) AS k FROM embeddings) SELECT label, vec_id, k <= 3 AS train FROM k WHERE k <= 8")
def balanced(spark, d):
    """Eight runs of each class without replacement, three of them for training; the order is that of a seeded hash."""
    by = Window.partitionBy("label").orderBy(F.md5(F.concat(F.lit("7:"), F.col("vec_id").cast("string"))), "vec_id")
    k = tables.table(spark, d, "embeddings").select("vec_id", "label").withColumn("k", F.row_number().over(by))
    return k.where("k <= 8").select("label", "vec_id", (F.col("k") <= 3).alias("train"))


@query("published_folds")
def published_folds(spark, d):
    """Families of each brand's parts dealt to three folds by the permutation that published splits use."""
    p = tables.table(spark, d, "part").select(F.col("p_brand").alias("model"), F.col("p_partkey").alias("family"))
    return draws.folds(p, ["model"], "family", 3, 7)


@query("published_choices")
def published_choices(spark, d):
    """Two parts of each type of each brand, from a generator named by the brand, and the brand's names in the shuffled order of its questions."""
    p = tables.table(spark, d, "part").select(F.col("p_brand").alias("model"), F.col("p_type").alias("label"), F.col("p_partkey").alias("id"))
    picked = draws.chosen(p, ["model"], "label", "id", 2, "model")
    order = draws.shuffled(p.select("model", "label").distinct(), ["model"], "label", "label", 11)
    return picked.join(order, ["model", "label"])


@query("family_folds", "WITH f AS (SELECT c_nationkey AS family, (row_number() OVER (ORDER BY md5('3:' || c_nationkey)) - 1) % 5 AS fold FROM (SELECT DISTINCT c_nationkey FROM customer)) SELECT fold, count(DISTINCT family) AS families, count(*) AS members FROM customer JOIN f ON c_nationkey = family GROUP BY fold")
def family_folds(spark, d):
    """Families are dealt to folds whole, in the order of a seeded hash; a family is one of few keys."""
    c = tables.table(spark, d, "customer")
    order = Window.orderBy(F.md5(F.concat(F.lit("3:"), F.col("family").cast("string"))))
    f = c.select(F.col("c_nationkey").alias("family")).distinct().withColumn("fold", ((F.row_number().over(order) - 1) % 5).cast("long"))
    return c.join(F.broadcast(f), F.col("c_nationkey") == F.col("family")).groupBy("fold").agg(F.count_distinct("family").alias("families"), F.count(F.lit(1)).alias("members"))


@query("label_balance", "SELECT min(n) AS least, max(n) AS most, max(n) - min(n) <= 1 AS balanced FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def balance(spark, d):
    n = tables.table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), (F.max("n") - F.min("n") <= 1).alias("balanced"))


@query("contract_violations", "SELECT 'negative value' AS rule, count(*) AS n FROM lineitem WHERE l_quantity < 0 UNION ALL SELECT 'discount range', count(*) FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.09 UNION ALL SELECT 'missing parent', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'repeated key', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def violations(spark, d):
    li, o = tables.table(spark, d, "lineitem"), tables.table(spark, d, "orders")
    n = lambda df, rule: df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"))
    missing = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    repeated = li.groupBy("l_orderkey", "l_linenumber").count().where("count > 1")
    return n(li.where("l_quantity < 0"), "negative value").union(n(li.where("NOT l_discount BETWEEN 0 AND 0.09"), "discount range")).union(n(missing, "missing parent")).union(n(repeated, "repeated key"))


@query("chained_identity", """WITH p AS (SELECT c_custkey, substr(sha256('{"segment":"' || c_mktsegment || '"}'), 1, 32) AS parent FROM customer) SELECT c_custkey, parent, substr(sha256('{"key":' || c_custkey || ',"parent":"' || parent || '"}'), 1, 32) AS child, 'fam_' || substr(sha256(parent), 1, 32) AS family FROM p""")
def identity(spark, d):
    """Content hashes: a child's comes from its parent's and its own parameters, as sorted compact JSON."""
    p = tables.table(spark, d, "customer").select("c_custkey", F.substring(F.sha2(F.to_json(F.struct(F.col("c_mktsegment").alias("segment"))), 256), 1, 32).alias("parent"))
    child = F.substring(F.sha2(F.to_json(F.struct(F.col("c_custkey").alias("key"), "parent")), 256), 1, 32)
    return p.select("c_custkey", "parent", child.alias("child"), F.concat(F.lit("fam_"), F.substring(F.sha2("parent", 256), 1, 32)).alias("family"))


@query("scalar_functions", f"""SELECT l_orderkey, l_linenumber, {q('2 * abs(l_quantity - l_discount) / nullif(abs(l_quantity) + abs(l_discount), 0)')} AS parameter_srd, {q('abs(l_tax - l_discount) / greatest(abs(l_discount), abs(l_tax), 0.01)')} AS change,
CASE WHEN l_discount = 0 THEN NULL ELSE {q('20 * log10(l_discount)')} END AS db, {q('pow(10, -l_quantity / 20)')} AS multiplier, greatest(0, CAST(floor(l_quantity * 2.5) AS BIGINT) - 1) AS points FROM lineitem""")
def scalars(spark, d):
    li = tables.table(spark, d, "lineitem")
    quantity, discount, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    db = X.ratio_to_db(discount)
    return li.select("l_orderkey", "l_linenumber", X.scaled(X.parameter_srd(quantity, discount)).alias("parameter_srd"), X.scaled(X.relative_change(tax, discount, 0.01)).alias("change"), F.when(X.finite(db), X.scaled(db)).alias("db"), X.scaled(X.db_to_multiplier(quantity)).alias("multiplier"), X.sampled_points(quantity, 2.5).alias("points"))


@query("text_normalisers", r"""SELECT p_partkey, lower(regexp_replace(trim(p_name), '\s+', ' ', 'g')) AS label, regexp_replace(regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug,
try_cast(nullif(regexp_extract(replace(p_brand, '#', '_'), '_(\d+)$', 1), '') AS BIGINT) AS seed, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(p_brand, '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), '_+', '_', 'g'), ''), 'item') AS file FROM part""")
def normalisers(spark, d):
    p = tables.table(spark, d, "part")
    return p.select("p_partkey", X.normal_label(F.col("p_name")).alias("label"), X.slug(F.concat_ws(" ", "p_brand", "p_type")).alias("slug"), X.seed_of(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))).alias("seed"), X.file_component(F.col("p_brand")).alias("file"))


@query("quantised_times", "SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 4, 0) * 4 AS BIGINT) AS step, CAST(CASE WHEN l_tax > 0 THEN (WITH n AS (SELECT greatest(3, least(101, CAST(round_even(l_quantity / nullif(l_tax * 100, 0), 0) AS INT))) AS n) SELECT n + 1 - n % 2 FROM n) ELSE 9 END AS BIGINT) AS odd FROM lineitem")
def quantised(spark, d):
    li = tables.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", X.quantise(F.col("l_quantity"), 4.0).cast("long").alias("step"), X.odd_window(F.col("l_quantity"), F.col("l_tax") * 100).cast("long").alias("odd"))


@query("grid_arg_min", f"WITH g AS (SELECT l_suppkey, l_linenumber AS k, l_returnflag AS w, avg(l_discount) AS a FROM lineitem GROUP BY ALL) SELECT l_suppkey, arg_min(k, (-{q('a')}, w, k)) AS k, arg_min(w, (-{q('a')}, w, k)) AS w FROM g GROUP BY l_suppkey")
def grid(spark, d):
    """The setting with the best accuracy; ties go to the smallest window, then k."""
    g = tables.table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").alias("k"), F.col("l_returnflag").alias("w")).agg((-X.scaled(X.exact_avg(F.col("l_discount")))).alias("a"))
    return g.groupBy("l_suppkey").agg(F.min(F.struct("a", "w", "k")).alias("b")).select("l_suppkey", "b.k", "b.w")


@query("candidate_ranking", f"WITH l AS (SELECT l_orderkey, l_partkey, sum(l_discount) AS loss FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {q('loss')}, l_partkey) AS k FROM l) SELECT l_orderkey, max(l_partkey) FILTER (WHERE k = 1) AS best, max(l_partkey) FILTER (WHERE k = 2) AS second, count(*) AS candidates FROM r GROUP BY l_orderkey")
def ranking(spark, d):
    losses = tables.table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(X.scaled(F.sum("l_discount")).alias("loss"))
    r = losses.withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("loss", "l_partkey")))
    return r.groupBy("l_orderkey").agg(F.max(F.when(F.col("k") == 1, F.col("l_partkey"))).alias("best"), F.max(F.when(F.col("k") == 2, F.col("l_partkey"))).alias("second"), F.count(F.lit(1)).alias("candidates"))
