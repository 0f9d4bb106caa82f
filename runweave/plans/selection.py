"""Queries over registries, samples, manifests and their contracts: orders play runs, customers families, priorities labels."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import align, contracts, registry, sampling, stored
from ..operators import pairs as pair_distances
from ..sources import tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


_VERDICTS = "v AS (SELECT o_custkey AS family, o_orderkey AS child, CASE o_orderkey % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'error' ELSE 'yes' END AS vs_baseline, CASE WHEN o_custkey % 3 = 0 THEN 'no' WHEN o_orderkey % 7 = 3 THEN 'error' ELSE 'yes' END AS vs_time0 FROM orders)"


def verdicts(spark, d):
    k = F.col("o_orderkey") % 5
    base = F.when(k == 0, "no").when(k == 1, "error").otherwise("yes")
    zero = F.when(F.col("o_custkey") % 3 == 0, "no").when(F.col("o_orderkey") % 7 == 3, "error").otherwise("yes")
    return tables.table(spark, d, "orders").select(F.col("o_custkey").alias("family"), F.col("o_orderkey").alias("child"), base.alias("vs_baseline"), zero.alias("vs_time0"))


@query("failed_children", f"WITH {_VERDICTS} SELECT family, child, vs_baseline <> 'yes' OR vs_time0 <> 'yes' AS failed FROM v")
def failed_children(spark, d):
    return registry.failed_children(verdicts(spark, d), "family")


@query("eligible_children", f"WITH {_VERDICTS}, f AS (SELECT family, count(*) FILTER (WHERE vs_baseline = 'yes') >= 3 AS eligible FROM v GROUP BY family) SELECT family, child FROM v JOIN f USING (family) WHERE eligible AND vs_baseline = 'yes' AND vs_time0 = 'yes'")
def eligible_children(spark, d):
    v = verdicts(spark, d)
    f = v.groupBy("family").agg((F.count_if(F.col("vs_baseline") == "yes") >= 3).alias("eligible"))
    return registry.eligible_children(v, f, "family").select("family", "child")


@query("eligibility_summary", f"WITH {_VERDICTS}, e AS (SELECT *, vs_baseline = 'error' OR vs_time0 = 'error' AS error FROM v) SELECT family, count(*) AS children, count(*) FILTER (WHERE vs_baseline = 'yes') AS told, count(*) FILTER (WHERE vs_time0 = 'yes') AS unlike_time0, count(*) FILTER (WHERE error) AS errors, coalesce(array_to_string(list_sort((list('/run/' || child ORDER BY child) FILTER (WHERE error))[1:10]), ','), '') AS urls FROM e GROUP BY family")
def eligibility_summary(spark, d):
    s = registry.summary(verdicts(spark, d), "family", F.concat(F.lit("/run/"), F.col("child").cast("string")))
    return s.withColumn("urls", F.array_join("urls", ","))


_RUNTIME = "r AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN ' Failed' WHEN 'O' THEN 'success' ELSE 'not_run' END AS status, o_clerk AS host, CASE WHEN o_orderkey % 2 = 0 THEN o_shippriority END AS code FROM orders WHERE o_orderkey % 7 <> 0)"


def runtime(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", " Failed").when(F.col("o_orderstatus") == "O", "success").otherwise("not_run")
    return tables.table(spark, d, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("id"), s.alias("status"), F.col("o_orderpriority").alias("host"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("code"))


@query("merged_registry", _RUNTIME.join(["WITH ", " SELECT DISTINCT l_orderkey + l_linenumber - 1 AS id, coalesce(lower(trim(r.status)), 'not_run') AS status, (host IS NOT NULL)::INT + (code IS NOT NULL)::INT AS fields, host FROM lineitem LEFT JOIN r ON r.id = l_orderkey + l_linenumber - 1"]).replace("o_clerk AS host", "o_orderpriority AS host").replace("THEN o_shippriority END", "THEN o_custkey END"))
def merged_registry(spark, d):
    """Planned runs with runtime status and further fields."""
    specs = tables.table(spark, d, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber") - 1).alias("id")).distinct()
    m = registry.merged(specs, runtime(spark, d), "id")
    return m.select("id", "status", F.greatest(F.coalesce(F.size("fields"), F.lit(0)), F.lit(0)).alias("fields"), F.try_element_at("fields", F.lit("host")).alias("host"))


@query("plan_of_families", """WITH st AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' ELSE 'not_run' END AS said FROM orders), b AS (SELECT id FROM st WHERE id % 3 = 0),
e AS (SELECT l_orderkey AS source, l_orderkey + l_linenumber AS target, CASE WHEN l_linenumber % 2 = 1 THEN 'child' ELSE 'time0' END AS kind, l_suppkey % 2 AS start FROM lineitem),
x AS (SELECT source AS id, count(*) FILTER (WHERE kind = 'child') AS children, max(CASE t.said WHEN 'failed' THEN 2 WHEN 'success' THEN 1 ELSE 0 END) AS worst, CASE WHEN min(start) = max(start) THEN min(start) END AS start FROM e JOIN b ON b.id = source JOIN st t ON t.id = target GROUP BY 1),
s AS (SELECT l_orderkey AS id, arg_max(l_partkey, (l_linenumber, l_partkey)) AS score FROM lineitem GROUP BY 1)
SELECT b.id AS baseline, coalesce(children, 0) AS children, CASE greatest(CASE st.said WHEN 'failed' THEN 2 WHEN 'success' THEN 1 ELSE 0 END, coalesce(worst, 0)) WHEN 2 THEN 'failed' WHEN 1 THEN 'success' ELSE 'not_run' END AS status, start, score FROM b JOIN st USING (id) LEFT JOIN x USING (id) LEFT JOIN s USING (id)""")
def plan_of_families(spark, d):
    o, li = tables.table(spark, d, "orders"), tables.table(spark, d, "lineitem")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "success").otherwise("not_run")
    run = o.select(F.col("o_orderkey").alias("id"), status.alias("status"))
    kind = F.when(F.col("l_linenumber") % 2 == 1, "child").otherwise("time0")
    edges = li.select(F.col("l_orderkey").alias("source"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("target"), kind.alias("kind"), (F.col("l_suppkey") % 2).alias("start"))
    scores = li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("at"), F.col("l_partkey").alias("score"))
    return registry.plan_of_families(run.where("id % 3 = 0").select("id"), edges, run, scores)


@query("truth_rows", """WITH c AS (SELECT o_custkey AS family, o_orderkey AS child, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 5000000000 END AS time0, o_orderpriority AS parameter, o_orderkey % 5 <> 0 AS eligible, (o_orderkey % 97)::DOUBLE AS change_time FROM orders), k AS (SELECT * FROM c WHERE eligible)
SELECT family, id, kind, label, change_time FROM (SELECT DISTINCT family, -family AS id, 'baseline' AS kind, 'no change' AS label, NULL::DOUBLE AS change_time FROM c UNION ALL SELECT family, child, 'child', parameter, change_time FROM k UNION ALL SELECT family, time0, 'time0', parameter, 0 FROM k WHERE time0 IS NOT NULL) WHERE id % 2 = 0""")
def truth_rows(spark, d):
    """Baselines, children and time0 runs of the selected ids with their labels."""
    child = F.col("o_orderkey")
    o = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("family"), child.alias("child"), F.when(child % 3 == 0, child + 5_000_000_000).alias("time0"), F.col("o_orderpriority").alias("parameter"))
    families = o.select("family", (-F.col("family")).alias("baseline")).distinct()
    first = o.select("child", (F.col("child") % 5 != 0).alias("eligible"), (F.col("child") % 97).alias("change_time"))
    every = families.select(F.col("baseline").alias("id")).unionByName(o.select(F.col("child").alias("id"))).unionByName(o.select(F.col("time0").alias("id")))
    return registry.truth_rows(families, o, first, every.where("id % 2 = 0"))


@query("referenced_ids", "SELECT count(*) AS ids, min(id) AS first FROM (SELECT l_orderkey::VARCHAR AS id FROM lineitem UNION SELECT l_partkey::VARCHAR FROM lineitem UNION SELECT o_custkey::VARCHAR FROM orders)")
def referenced_ids(spark, d):
    ids = registry.referenced((tables.table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"]), (tables.table(spark, d, "orders"), ["o_custkey"]))
    return ids.agg(F.count(F.lit(1)).alias("ids"), F.min("id").alias("first"))


@query("question_index", "WITH q AS (SELECT 'q' || o_orderkey AS question, o_orderpriority AS row, o_orderstatus AS shot FROM orders), e AS (SELECT 'question' AS selector, question AS slug, question FROM q UNION SELECT 'row', row, question FROM q UNION SELECT 'shot', shot, question FROM q) SELECT selector, slug, count(*) AS questions, min(question) AS first FROM e GROUP BY ALL")
def question_index(spark, d):
    o = tables.table(spark, d, "orders")
    return registry.question_index(o.select(F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("question"), F.col("o_orderpriority").alias("row"), F.col("o_orderstatus").alias("shot")))


@query("selected_questions", "SELECT 'q' || o_orderkey AS question, o_orderpriority AS row, o_orderstatus AS shot FROM orders WHERE o_orderpriority = '2-HIGH'")
def selected_questions(spark, d):
    o = tables.table(spark, d, "orders")
    q = o.select(F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("question"), F.col("o_orderpriority").alias("row"), F.col("o_orderstatus").alias("shot"))
    return registry.questions(q, row="2-HIGH")


@query("own_paths", "SELECT p_partkey, NOT (contains(p_name, 'a') AND p_partkey % 3 = 0) AND p_partkey % 5 <> 0 AS own FROM part")
def own_paths(spark, d):
    tail = F.when(F.contains("p_name", F.lit("a")) & (F.col("p_partkey") % 3 == 0), "run__attempt2").otherwise("run")
    path = F.concat(F.lit("models/"), F.when(F.col("p_partkey") % 5 == 0, "old_preserved/").otherwise("new/"), tail, F.lit("/metadata.json"))
    return tables.table(spark, d, "part").select("p_partkey", registry.own_path(path).alias("own"))


@query("compared_children", "SELECT l_orderkey AS child, l_linenumber, md5(l_linestatus) AS hash, l_returnflag AS parameter FROM lineitem WHERE l_linestatus = 'O' OR l_returnflag = 'A'")
def compared_children(spark, d):
    c = tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("child"), "l_linenumber", F.md5("l_linestatus").alias("hash"), F.col("l_returnflag").alias("parameter"))
    return registry.compared(c, [hashlib.md5(b"O").hexdigest()], ["A"])


@query("balanced_counts", "WITH l AS (SELECT DISTINCT o_orderpriority AS label FROM orders), k AS (SELECT count(*) AS k FROM l), n AS (SELECT count(*) AS n FROM nation) SELECT label, n // k + CASE WHEN row_number() OVER (ORDER BY label) - 1 < n % k THEN 1 ELSE 0 END + 0 AS n FROM l, k, (SELECT 23 AS n)")
def balanced_counts(spark, d):
    labels = tables.table(spark, d, "orders").select(F.col("o_orderpriority").alias("label"))
    return sampling.balanced_counts(labels, "label", F.lit(23))


_SEEDS = "s AS (SELECT unnest([11, 12, 13]) AS seed), c AS (SELECT seed, o_orderpriority AS label, o_custkey AS family, o_orderkey AS id FROM orders, s)"


@query("stratified_samples", f"WITH {_SEEDS}, u AS (SELECT *, row_number() OVER (PARTITION BY seed, label ORDER BY md5(seed || '::' || id), id) AS k FROM c WHERE id % 10 <> 3) SELECT seed, label, id FROM u WHERE k <= 4")
def stratified_samples(spark, d):
    """Four runs of each label for each seed, without used ones."""
    c = seeded_candidates(spark, d)
    used = c.where("id % 10 = 3").select("id").distinct()
    return sampling.stratified(c, ["seed"], "label", "id", "seed", 4, used).select("seed", "label", "id")


def seeded_candidates(spark, d):
    o = tables.table(spark, d, "orders")
    return o.select(F.explode(F.array(F.lit(11), F.lit(12), F.lit(13))).alias("seed"), F.col("o_orderpriority").alias("label"), F.col("o_custkey").alias("family"), F.col("o_orderkey").alias("id"))


@query("unique_family_samples")
def unique_family_samples(spark, d):
    """One run of each label for each seed, all of different families."""
    return sampling.unique_families(seeded_candidates(spark, d), ["seed"], "label", "family", "id", "seed", 5)


@query("manifests", f"""WITH {_SEEDS}, a AS (SELECT *, unnest([0, 1, 2, 3]) AS attempt FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY seed, attempt, label ORDER BY md5((seed * 100 + attempt) || '::' || id), id) AS k FROM a),
t AS (SELECT seed, attempt, list_sort(list(id::VARCHAR) FILTER (WHERE k <= 3)) AS train, list_sort(list(id::VARCHAR) FILTER (WHERE k BETWEEN 4 AND 5)) AS test, sum(id) FILTER (WHERE k <= 3) AS total FROM k GROUP BY ALL), ok AS (SELECT seed, min(attempt) AS attempt FROM t WHERE total % 3 <> 0 GROUP BY seed)
SELECT seed, attempt, array_to_string(train, ',') AS train, array_to_string(test, ',') AS test, sha256('["' || array_to_string(train, '", "') || '"]') AS train_hash, sha256('["' || array_to_string(test, '", "') || '"]') AS test_hash FROM t JOIN ok USING (seed, attempt)""")
def manifests(spark, d):
    """For each seed the first of its attempts that isn't rejected; here a rule over ids stands for the baselines' accuracy."""
    c = seeded_candidates(spark, d).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("own_seed", F.col("seed") * 100 + F.col("attempt"))
    drawn = sampling.stratified(c, ["seed", "attempt"], "label", "id", "own_seed", 5)
    ranked = sampling.shuffled(drawn, ["seed", "attempt", "label"], "id", F.col("own_seed"))
    train, test = ranked.where("place < 3"), ranked.where("place >= 3")
    accepted = train.groupBy("seed", "attempt").agg(F.sum("id").alias("total")).where("total % 3 <> 0").select("seed", "attempt")
    m = sampling.manifests(train, test, ["seed"], "id", "attempt", accepted)
    return m.withColumns({c: F.array_join(c, ",") for c in ("train", "test")})


_DRAWS = f"""z AS (SELECT vec_id AS id, label, embedding AS x, list_transform(embedding, lambda v: (v - list_avg(embedding)) / list_stddev_pop(embedding)) AS y FROM embeddings),
d AS (SELECT a.id AS a_id, b.id AS b_id, list_avg(list_transform(list_zip(a.x, b.x), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)) AS mse, list_avg(list_transform(list_zip(a.y, b.y), lambda p: (p[1] - p[2]) ** 2)) AS z_mse FROM z a JOIN z b ON a.id <> b.id),
s AS (SELECT unnest(range(8)) AS seed), c AS (SELECT seed, label, id, row_number() OVER (PARTITION BY seed, label ORDER BY md5('test::' || seed || '::' || id), id) AS k FROM z, s),
e AS (SELECT seed, label, id FROM c WHERE k <= 3), p AS (SELECT seed, label, id FROM c WHERE k > 3), a AS (SELECT *, unnest(range(60)) AS attempt FROM p),
t AS (SELECT seed, attempt, label, id FROM (SELECT *, row_number() OVER (PARTITION BY seed, attempt, label ORDER BY md5(seed || '::' || attempt || '::' || id), id) AS k FROM a) WHERE k <= 2),
m AS (SELECT t.seed, t.attempt, e.id, e.label AS truth, t.label AS said, min(mse) AS mse, min(z_mse) AS z_mse, avg(mse) AS mean FROM e JOIN t USING (seed) JOIN d ON a_id = e.id AND b_id = t.id GROUP BY ALL),
w AS (SELECT t.seed, t.attempt, t.label AS said, sum(mse) / 8 AS inside FROM t JOIN t u ON t.seed = u.seed AND t.attempt = u.attempt AND t.label = u.label JOIN d ON a_id = t.id AND b_id = u.id GROUP BY ALL),
b AS (SELECT seed, attempt, id, truth, (arg_min(said, (mse, said)) = truth)::INT AS nearest, (arg_min(said, (z_mse, said)) = truth)::INT AS correlated, (arg_min(said, (mean - inside, said)) = truth)::INT AS centroid FROM m JOIN w USING (seed, attempt, said) GROUP BY seed, attempt, id, truth),
r AS (SELECT seed, attempt, greatest(avg(nearest), avg(correlated), avg(centroid)) AS best FROM b GROUP BY seed, attempt), f AS (SELECT seed, min(attempt) AS attempt FROM r WHERE best <= 0.1 + 0.02 * 0.9 GROUP BY seed)"""


@query("adversarial_manifests", f"""WITH {_DRAWS}, x AS (SELECT seed, list_sort(list(id::VARCHAR)) AS test FROM e GROUP BY seed), y AS (SELECT seed, attempt, list_sort(list(id::VARCHAR)) AS train FROM t GROUP BY ALL)
SELECT seed, attempt, CAST(round(best * 30) AS BIGINT) AS right_of_thirty, array_to_string(train, ',') AS train, array_to_string(test, ',') AS test, sha256('["' || array_to_string(train, '", "') || '"]') AS train_hash, sha256('["' || array_to_string(test, '", "') || '"]') AS test_hash FROM f JOIN r USING (seed, attempt) JOIN x USING (seed) JOIN y USING (seed, attempt)""")
def adversarial_manifests(spark, d):
    """For each of eight seeds the first draw of train samples from which no classifier tells the test samples' labels much better than chance."""
    runs = tables.vector_runs(spark, d)

    def distances(wanted):
        own = stored.cut(runs.join(wanted.select(F.col("a_id").alias("run_id")).union(wanted.select("b_id")).distinct(), "run_id", "left_semi"))
        near = pair_distances.wanted_mse(own, wanted)
        alike = pair_distances.wanted_mse(align.standardise(own, ["run_id"], "value").select("run_id", "pos", F.col("z").alias("value")), wanted)
        return near.join(alike.withColumnRenamed("mse", "z_mse"), ["a_id", "b_id"])

    samples = tables.table(spark, d, "embeddings").withColumnRenamed("vec_id", "id").select(F.explode(F.sequence(F.lit(0), F.lit(7))).alias("seed"), "label", "id")
    order = Window.partitionBy("seed", "label").orderBy(F.md5(F.concat_ws("::", F.lit("test"), F.col("seed").cast("string"), F.col("id").cast("string"))), "id")
    placed = samples.withColumn("k", F.row_number().over(order))
    m = sampling.adversarial_manifests(placed.where("k > 3").drop("k"), placed.where("k <= 3").drop("k"), distances, ["seed"], "label", "id", "seed", 2, margin=0.02)
    return m.select("seed", "attempt", F.round(F.col("best") * 30).cast("long").alias("right_of_thirty"), F.array_join("train", ",").alias("train"), F.array_join("test", ",").alias("test"), "train_hash", "test_hash")


_MANIFEST = "m AS (SELECT l_suppkey AS row, l_linenumber AS seed, list_sort(list(DISTINCT l_orderkey::VARCHAR) FILTER (WHERE l_returnflag = 'A')) AS train, list_sort(list(DISTINCT l_orderkey::VARCHAR) FILTER (WHERE l_returnflag <> 'A')) AS test FROM lineitem GROUP BY ALL HAVING count(*) FILTER (WHERE l_returnflag = 'A') > 0 AND count(*) FILTER (WHERE l_returnflag <> 'A') > 0)"


@query("manifest_faults", f"""WITH {_MANIFEST}, r AS (SELECT row, seed, unnest(list_filter([CASE WHEN len(train) <> 2 THEN 'train_count' END, CASE WHEN len(test) <> 3 THEN 'test_count' END, CASE WHEN row % 9 = 4 AND len(train) > 1 THEN 'train_sorted' END, CASE WHEN row % 9 = 4 AND len(train) < 2 THEN NULL END, CASE WHEN len(list_intersect(train, test)) > 0 THEN 'disjoint' END, CASE WHEN row % 8 = 5 THEN 'test_hash' END], lambda x: x IS NOT NULL)) AS rule FROM m),
u AS (SELECT row, id, count(DISTINCT seed) AS n FROM (SELECT row, seed, unnest(train) AS id FROM m) GROUP BY ALL) SELECT row, seed, rule FROM r UNION ALL SELECT DISTINCT row, NULL, 'train_reused' FROM u WHERE n > 1""")
def manifest_faults(spark, d):
    ids = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("l_orderkey").cast("string"))))
    m = tables.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("row"), F.col("l_linenumber").alias("seed")).agg(ids(F.col("l_returnflag") == "A").alias("train"), ids(F.col("l_returnflag") != "A").alias("test"))
    m = m.where("size(train) > 0 AND size(test) > 0")
    h = F.when(F.col("row") % 8 == 5, "old").otherwise(contracts.list_hash(F.col("test")))
    m = m.withColumns({"train_hash": contracts.list_hash(F.col("train")), "test_hash": h, "train": F.when(F.col("row") % 9 == 4, F.reverse("train")).otherwise(F.col("train"))})
    rules = contracts.manifest_rules(F.col("train"), F.col("test"), F.lit(2), F.lit(3), F.col("train_hash"), F.col("test_hash"))
    reused = contracts.reused(m, ["row"], "seed", "train").select("row", F.lit(None).cast("int").alias("seed"), "rule")
    return contracts.broken(m, rules, ["row", "seed"]).unionByName(reused)


@query("stated_totals", "WITH f AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed FROM orders GROUP BY 1), s AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE coalesce(n, 0) END AS n, coalesce(failed, 0) + (c_custkey % 25 = 0)::INT AS failed, coalesce(f.n, 0) AS fn, coalesce(f.failed, 0) AS ff FROM customer LEFT JOIN f ON o_custkey = c_custkey) SELECT c_custkey AS family, 'runs' AS rule FROM s WHERE n <> fn UNION ALL SELECT c_custkey, 'failed' FROM s WHERE failed <> ff")
def stated_totals(spark, d):
    o = tables.table(spark, d, "orders").withColumnRenamed("o_custkey", "family")
    found = o.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    stated = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("family")).join(found, "family", "left")
    k = F.col("family")
    stated = stated.select("family", F.when(k % 10 == 0, 1).otherwise(F.coalesce("n", F.lit(0))).alias("runs"), (F.coalesce("f", F.lit(0)) + (k % 25 == 0).cast("int")).alias("failed"))
    return contracts.totals_agree(stated, o, ["family"], {"runs": F.lit(True), "failed": F.col("o_orderstatus") == "F"})


@query("distribution_faults", "SELECT p_partkey, unnest(list_filter([CASE WHEN low > high THEN 'interval' END, CASE WHEN scale NOT IN ('uniform', 'loguniform') THEN 'scale' END, CASE WHEN scale = 'loguniform' AND low <= 0 THEN 'positive' END], lambda x: x IS NOT NULL)) AS rule FROM (SELECT p_partkey, p_size - 10 AS low, p_retailprice / 100 AS high, CASE p_partkey % 4 WHEN 0 THEN 'loguniform' WHEN 1 THEN 'normal' ELSE 'uniform' END AS scale FROM part)")
def distribution_faults(spark, d):
    k = F.col("p_partkey") % 4
    scale = F.when(k == 0, "loguniform").when(k == 1, "normal").otherwise("uniform")
    rules = contracts.interval_rules((F.col("p_size") - 10).cast("double"), F.col("p_retailprice") / 100, scale)
    return contracts.broken(tables.table(spark, d, "part"), rules, ["p_partkey"])


@query("sampling_faults", "SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN NOT (l_discount > 0 AND l_discount < l_tax) THEN 'start' END, CASE WHEN floor(l_tax * 1000) - 1 < 50 THEN 'points' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem")
def sampling_faults(spark, d):
    return contracts.broken(tables.table(spark, d, "lineitem"), contracts.sampling_rules(F.col("l_discount"), F.col("l_tax"), F.lit(1000.0)), ["l_orderkey", "l_linenumber"])


@query("question_faults", """WITH q AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, string_split(coalesce(text, ''), ' ') AS words FROM conversations)
SELECT conv_id, turn, unnest(list_filter([CASE WHEN role NOT IN ('user', 'assistant') THEN 'context' END, CASE WHEN len(list_distinct(words)) <> len(words) THEN 'samples' END, CASE WHEN NOT list_contains(['the', 'and', 'of'], words[1]) THEN 'label' END, CASE WHEN trim(text) = '' OR regexp_matches(text, '\\n[ \\t]*\\n[ \\t]*\\n') THEN 'text' END], lambda x: x IS NOT NULL)) AS rule FROM q""")
def question_faults(spark, d):
    text = F.coalesce("text", F.lit(""))
    words = F.split(text, " ")
    rules = contracts.question_rules(F.col("role"), F.lit("none"), F.lit("data.parquet"), words, F.array(F.lit("the"), F.lit("and"), F.lit("of")), F.get(words, F.lit(0)), text, ["user", "assistant"], ["none"], "data.parquet")
    return contracts.broken(tables.table(spark, d, "conversations"), rules, ["conv_id", "turn"])


@query("run_spec_faults", """WITH s AS (SELECT l_orderkey, l_linenumber, l_discount AS t, l_tax AS e, l_linenumber % 4 AS n, l_returnflag = 'R' AS skipped, CASE WHEN l_returnflag = 'R' AND l_linenumber <> 3 THEN NULL WHEN l_linenumber = 2 THEN 'old' ELSE md5(l_orderkey::VARCHAR) END AS hash FROM lineitem)
SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN l_linenumber = 5 THEN 'forbidden' END, CASE WHEN n <> 1 THEN 'one_parameter' END, CASE WHEN NOT (t > 0 AND t < e) THEN 'start' END, CASE WHEN CASE WHEN skipped THEN hash IS NOT NULL ELSE coalesce(hash <> md5(l_orderkey::VARCHAR), true) END THEN 'hash' END], lambda x: x IS NOT NULL)) AS rule FROM s""")
def run_spec_faults(spark, d):
    li = tables.table(spark, d, "lineitem")
    good = F.md5(F.col("l_orderkey").cast("string"))
    skipped = F.col("l_returnflag") == "R"
    own = F.when(skipped & (F.col("l_linenumber") != 3), None).when(F.col("l_linenumber") == 2, "old").otherwise(good)
    given = F.create_map(F.when(F.col("l_linenumber") == 5, "seed").otherwise("mass"), F.lit(1))
    changed = F.slice(F.array(*map(F.lit, "abc")), F.lit(1), (F.col("l_linenumber") % 4).cast("int"))
    rules = contracts.run_spec_rules(given, ["seed", "t0"], changed, F.col("l_discount"), F.col("l_tax"), skipped, own, good)
    return contracts.broken(li, rules, ["l_orderkey", "l_linenumber"])


@query("profile_faults", "WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(p_type, ' ') AS b FROM part) SELECT p_partkey, unnest(list_filter([CASE WHEN p_partkey % 6 = 0 AND list_reverse(a) <> a THEN 'signals' END, CASE WHEN p_partkey % 10 = 0 AND b <> ['x'] THEN 'parameters' END, CASE WHEN len(list_filter(b[1:1], lambda x: NOT list_contains(a, x))) > 0 THEN 'observable' END], lambda x: x IS NOT NULL)) AS rule FROM p")
def profile_faults(spark, d):
    a, b = F.split("p_name", " "), F.split("p_type", " ")
    other_a = F.when(F.col("p_partkey") % 6 == 0, F.reverse(a)).otherwise(a)
    other_b = F.when(F.col("p_partkey") % 10 == 0, F.array(F.lit("x"))).otherwise(b)
    return contracts.broken(tables.table(spark, d, "part"), contracts.profile_rules(a, other_a, F.slice(b, 1, 1), b, other_b), ["p_partkey"])


@query("graph_faults", """WITH n AS (SELECT 'o' || o_orderkey AS id, o_orderstatus AS kind FROM orders UNION ALL SELECT 'o' || o_orderkey, 'F' FROM orders WHERE o_orderkey % 50 = 0), e AS (SELECT 'o' || l_orderkey AS source, 'o' || (l_orderkey + l_linenumber) AS target FROM lineitem)
SELECT id, 'repeated' AS rule FROM n GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'kind' FROM n WHERE kind NOT IN ('F', 'O') UNION ALL SELECT DISTINCT id, 'missing_end' FROM (SELECT source AS id FROM e UNION SELECT target FROM e) WHERE id NOT IN (SELECT id FROM n)""")
def graph_faults(spark, d):
    name = lambda x: F.concat(F.lit("o"), x.cast("string"))
    o, li = tables.table(spark, d, "orders"), tables.table(spark, d, "lineitem")
    nodes = o.select(name(F.col("o_orderkey")).alias("id"), F.col("o_orderstatus").alias("kind"))
    nodes = nodes.unionByName(o.where("o_orderkey % 50 = 0").select(name(F.col("o_orderkey")).alias("id"), F.lit("F").alias("kind")))
    edges = li.select(name(F.col("l_orderkey")).alias("source"), name(F.col("l_orderkey") + F.col("l_linenumber")).alias("target"))
    return contracts.graph_faults(nodes, edges, ["F", "O"])


@query("candidate_reasons", f"WITH {_VERDICTS}, r AS (SELECT o_orderkey AS child, o_orderstatus = 'P' AS skipped, CASE WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'Success ' END AS status FROM orders) SELECT child, CASE WHEN skipped THEN 'skipped' WHEN lower(trim(status)) <> 'success' THEN 'not simulated' WHEN vs_baseline IS NULL THEN 'not measured' WHEN vs_baseline <> 'yes' THEN 'like its baseline' WHEN vs_time0 <> 'yes' THEN 'like its time0 run' END AS reason FROM r LEFT JOIN (FROM v WHERE child % 9 <> 2) v USING (child)")
def candidate_reasons(spark, d):
    o = tables.table(spark, d, "orders")
    reg = o.select(F.col("o_orderkey").alias("child"), (F.col("o_orderstatus") == "P").alias("skipped"), F.when(F.col("o_orderkey") % 4 == 0, "failed").otherwise("Success ").alias("status"))
    return sampling.candidates(reg, verdicts(spark, d).where("child % 9 <> 2").drop("family"), ["child"]).select("child", "reason")
