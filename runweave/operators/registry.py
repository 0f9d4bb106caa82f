"""Registries of runs: status against data and hashes, choices per parameter, seeded choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .align import parts


def with_status(planned: DataFrame, runtime: DataFrame, available: DataFrame, key: str = "run_id") -> DataFrame:
    """planned (key, hash) with `status` and `stale_reason`. runtime: (key, status, runtime_hash), available: (key), each key once."""
    r = runtime.select(key, F.col("status").alias("__status"), F.col("runtime_hash").alias("__hash"), F.lit(True).alias("__ran"))
    rows = planned.join(r, key, "left").join(available.select(key, F.lit(True).alias("__data")), key, "left")
    has, ran = F.coalesce("__data", F.lit(False)), F.coalesce("__ran", F.lit(False))
    said = F.coalesce("__status", F.lit(""))
    differs = ran & (F.coalesce("__hash", F.lit("")) != "") & (F.coalesce("hash", F.lit("")) != "") & (F.lower("__hash") != F.lower("hash"))
    status = F.when(~ran, F.when(has, "success").otherwise("not_run")).when(differs, "not_run").when(said == "failed", "failed").when(has & said.isin("success", ""), "success").otherwise("not_run")
    stale = F.when(differs, "hash_mismatch").when(ran & (said == "success") & ~has, "missing_data")
    return rows.withColumn("status", status).withColumn("stale_reason", stale).drop("__status", "__hash", "__ran", "__data")


def match_once(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Each left row with the columns of its only partner; reading them where there is none, or several, is an error."""
    others = [c for c in right.columns if c not in keys]
    found = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(*others)).alias("__m"))
    n = F.coalesce("__n", F.lit(0))
    stop = F.raise_error(F.concat(F.lit("partners of a row: "), n.cast("string")))
    only = lambda c: F.when(n == 1, F.col(f"__m.{c}")).otherwise(stop.cast(dict(right.dtypes)[c])).alias(c)
    return left.join(found, keys, "left").select(*left.columns, *map(only, others))


def conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with more than one label."""
    return df.groupBy(key).agg(F.count_distinct(label).alias("labels")).where("labels > 1")


def uniform_outside(u: Column, low: Column, high: Column, centre: Column, gap: Column) -> Column:
    """Where a uniform u of [0, 1) falls on [low, high] less (centre - gap, centre + gap); NULL where nothing is left."""
    left = F.greatest(F.lit(0.0), F.least(centre - gap, high) - low)
    begin = F.greatest(centre + gap, low)
    right = F.greatest(F.lit(0.0), high - begin)
    at = u * (left + right)
    return F.when(left + right > 0, F.when(at < left, low + at).otherwise(begin + at - left))


def eligible_children(verdicts: DataFrame, baselines: DataFrame, family: str) -> DataFrame:
    """The children that are told from both references, of families that are eligible."""
    good = verdicts.where((F.col("vs_baseline") == "yes") & (F.col("vs_time0") == "yes"))
    return good.join(baselines.where("eligible").select(family), family)


def failed_children(verdicts: DataFrame, family: str) -> DataFrame:
    """(family, child, failed): whether a child isn't told from one of the references; a verdict other than yes, no and error is an error."""
    known = F.col("vs_baseline").isin("yes", "no", "error") & F.col("vs_time0").isin("yes", "no", "error")
    failed = (F.col("vs_baseline") != "yes") | (F.col("vs_time0") != "yes")
    return verdicts.select(family, "child", F.when(F.coalesce(known, F.lit(False)), failed).otherwise(F.raise_error(F.lit("unknown verdict")).cast("boolean")).alias("failed"))


def summary(verdicts: DataFrame, family: str, url: Column) -> DataFrame:
    """(family, children, told, unlike_time0, errors, urls): counts of a family's children, and sorted links to the first ten with errors."""
    error = (F.col("vs_baseline") == "error") | (F.col("vs_time0") == "error")
    place = F.row_number().over(Window.partitionBy(family, error).orderBy("child"))
    rows = verdicts.withColumn("url_", F.when(error & (place <= 10), url))
    return rows.groupBy(family).agg(F.count(F.lit(1)).alias("children"), F.count_if(F.col("vs_baseline") == "yes").alias("told"), F.count_if(F.col("vs_time0") == "yes").alias("unlike_time0"), F.count_if(error).alias("errors"), F.array_sort(F.collect_list("url_")).alias("urls"))


def merged(specs: DataFrame, runtime: DataFrame, key: str) -> DataFrame:
    """Planned runs with their runtime status ('not_run' without one) and its further fields, by name; runtime entries without a plan are left out."""
    extra = [c for c in runtime.columns if c not in (key, "status")]
    fields = F.map_filter(F.create_map(*(x for c in extra for x in (F.lit(c), F.col(c).cast("string")))), lambda _, v: v.isNotNull()) if extra else F.create_map()
    said = runtime.select(key, F.lower(F.trim("status")).alias("said"), fields.alias("fields"))
    return specs.join(said, key, "left").withColumn("status", F.coalesce("said", F.lit("not_run"))).drop("said")


def plan_of_families(baselines: DataFrame, edges: DataFrame, runtime: DataFrame, scores: DataFrame) -> DataFrame:
    """(baseline, children, status, start, score): each baseline with its children and time0 runs, their worst status, their common start (NULL unless all are equal), and the last score recorded.

    baselines: id; edges: source, target, kind, start; runtime: id, status; scores: id, at, score. Edges with an end that is no run are left out.
    """
    known = runtime.select(F.col("id").alias("target"), F.lower(F.trim("status")).alias("said"))
    ends = edges.join(baselines.select(F.col("id").alias("source")), "source").join(known, "target")
    rank = F.when(F.col("said") == "failed", 2).when(F.col("said") == "success", 1).otherwise(0)
    one_start = F.when(F.min("start").eqNullSafe(F.max("start")) & (F.count("start") == F.count(F.lit(1))), F.min("start"))
    of_kids = ends.groupBy(F.col("source").alias("id")).agg(F.count_if(F.col("kind") == "child").alias("children"), F.max(rank).alias("worst"), one_start.alias("start"))
    own = runtime.select("id", F.lower(F.trim("status")).alias("own"))
    last = scores.groupBy("id").agg(F.max(F.struct("at", "score"))["score"].alias("score"))
    every = baselines.join(own, "id", "left").join(of_kids, "id", "left").join(last, "id", "left")
    own_rank = F.when(F.col("own") == "failed", 2).when(F.col("own") == "success", 1).otherwise(0)
    worst = F.greatest(own_rank, F.coalesce("worst", F.lit(0)))
    status = F.when(worst == 2, "failed").when(worst == 1, "success").otherwise("not_run")
    return every.select(F.col("id").alias("baseline"), F.coalesce("children", F.lit(0)).alias("children"), status.alias("status"), "start", "score")


def truth_rows(families: DataFrame, children: DataFrame, first_diff: DataFrame, selected: DataFrame) -> DataFrame:
    """(family, id, kind, label, change_time) of the selected runs: baselines and time0 runs change nothing, children have their parameter and when it shows first.

    families: family, baseline; children: family, child, time0, parameter; first_diff: child, eligible, change_time. Children that are said not to be eligible are left out.
    """
    n = parts(children, first_diff)
    kept = children.repartition(n, "child").join(first_diff.repartition(n, "child"), "child", "left").where(F.coalesce("eligible", F.lit(True)))
    rows = families.select("family", F.col("baseline").alias("id"), F.lit("baseline").alias("kind"), F.lit("no change").alias("label"), F.lit(None).cast("double").alias("change_time"))
    kids = kept.select("family", F.col("child").alias("id"), F.lit("child").alias("kind"), F.col("parameter").alias("label"), F.col("change_time").cast("double").alias("change_time"))
    zero = kept.where("time0 IS NOT NULL").select("family", F.col("time0").alias("id"), F.lit("time0").alias("kind"), F.col("parameter").alias("label"), F.lit(0.0).alias("change_time"))
    every, own = rows.unionByName(kids).unionByName(zero), selected.select("id").repartition(n, "id").distinct()
    # ids are distinct, so this is a semi-join; one of that name would be done for each part of the union
    return every.repartition(n, "id").join(own, "id")


def referenced(*tables: tuple[DataFrame, list[str]]) -> DataFrame:
    """(id): all ids that any of the columns of the tables name."""
    parts = [df.select(F.explode(F.array(*(F.col(c).cast("string") for c in columns))).alias("id")) for df, columns in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("id IS NOT NULL AND id <> ''").distinct()


def compared(children: DataFrame, hashes: list[str], parameters: list[str]) -> DataFrame:
    """The children with one of the hashes or parameters asked for; a request that none has is an error."""
    asked = [("hash", h) for h in hashes] + [("parameter", p) for p in parameters]
    counts = children.agg(*(F.count_if(F.col(c) == v).alias(str(k)) for k, (c, v) in enumerate(asked))).first()
    if missing := [f"{c} {v}" for k, (c, v) in enumerate(asked) if not counts[k]]:
        raise ValueError(f"no child has {missing}")
    return children.where(F.col("hash").isin(hashes) | F.col("parameter").isin(parameters))


def selected_signals(signals: DataFrame, asked: list[str], impulses: bool | None = None) -> DataFrame:
    """The signals (signal, type) asked for, in that order; unknown or repeated names and an empty outcome are errors. impulses: keep only impulse-like ones, or only the others."""
    known = {r.signal: r.type for r in signals.select("signal", "type").collect()}  # a model's signals, a few
    bad = [s for s in asked if s not in known or asked.count(s) > 1]
    kept = [s for s in asked if impulses is None or (known.get(s) == "impulse_like") == impulses]
    if bad or not kept:
        raise ValueError(f"unknown or repeated signals: {bad}" if bad else "no signal is left")
    return signals.join(signals.sparkSession.createDataFrame([(s, k) for k, s in enumerate(kept)], "signal string, place int"), "signal")


def questions(df: DataFrame, question: str | None = None, row: str | None = None, shot: str | None = None) -> DataFrame:
    """The questions of exactly one selector (their own slug, their row's or their shot's), each once; a value that none has is an error."""
    given = [(c, v) for c, v in (("question", question), ("row", row), ("shot", shot)) if v is not None]
    if len(given) != 1:
        raise ValueError("give one of question, row and shot")
    found = df.where(F.col(given[0][0]) == given[0][1]).dropDuplicates(["question"])
    if found.isEmpty():
        raise ValueError(f"no {given[0][0]} {given[0][1]}")
    return found


def question_index(df: DataFrame) -> DataFrame:
    """(selector, slug, questions, first): how many questions each row, shot and question slug names, and the first of them."""
    each = df.select("question", F.explode(F.array(*(F.struct(F.lit(c).alias("selector"), F.col(c).alias("slug")) for c in ("question", "row", "shot")))).alias("s")).select("s.*", "question").distinct()
    return each.groupBy("selector", "slug").agg(F.count(F.lit(1)).alias("questions"), F.min("question").alias("first"))


def own_path(path: Column) -> Column:
    """Whether no part of a path is an attempt or a preserved copy."""
    return ~F.exists(F.split(path, "/"), lambda x: F.contains(x, F.lit("__attempt")) | F.endswith(x, F.lit("_preserved")))


def runnable(parameters: Column) -> Column:
    """Whether a child changes exactly one parameter, to a value."""
    return (F.size(parameters) == 1) & F.get(F.map_values(parameters), F.lit(0)).isNotNull()
