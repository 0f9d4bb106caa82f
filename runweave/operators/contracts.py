"""Contracts over any table: rules are columns, and what breaks them comes back as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import finite
from .align import parts


def broken(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """(keys, rule) for each row and each rule that isn't true of it; one pass over df."""
    names = F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()))
    return df.select(*keys, F.explode(F.filter(names, lambda n: n.isNotNull())).alias("rule"))


def repeated(df: DataFrame, keys: list[str], rule: str = "repeated") -> DataFrame:
    """(keys, rule) of keys that several rows have."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, F.lit(rule).alias("rule"))


def unknown(df: DataFrame, known: DataFrame, keys: list[str], rule: str = "unknown") -> DataFrame:
    """(keys, rule) of keys that the second table lacks."""
    return df.select(*keys).distinct().join(known.select(*keys).distinct(), keys, "left_anti").withColumn("rule", F.lit(rule))


def interval_rules(low: Column, high: Column, scale: Column) -> dict[str, Column]:
    """Of a parameter's distribution: two finite numbers in order, above 0 on a logarithmic scale, a known scale."""
    return {
        "interval": finite(low) & finite(high) & (low <= high),
        "scale": scale.isin("uniform", "loguniform"),
        "positive": (scale != "loguniform") | (low > 0),
    }


def threshold_rules(thresholds: Column, types: Column) -> dict[str, Column]:
    """Of a model's settings: finite thresholds of 0 or more by signal, and known types of signals."""
    return {
        "thresholds": F.forall(F.map_values(thresholds), lambda x: F.coalesce(finite(x) & (x >= 0), F.lit(False))),
        "types": F.forall(F.map_values(types), lambda x: F.coalesce(x.isin("continuous", "impulse_like"), F.lit(False))),
    }


def known_keys(given: Column, allowed: list[str]) -> Column:
    """Whether a map has no other keys."""
    return F.size(F.array_except(F.map_keys(given), F.array(*map(F.lit, allowed)))) == 0


def sampling_rules(start: Column, end: Column, rate: Column, least: int = 50) -> dict[str, Column]:
    """Of a run to be simulated: the change lies inside it, and its grid has enough points."""
    return {"start": finite(start) & finite(end) & (start > 0) & (start < end), "points": F.floor(end * rate) - 1 >= least}


def question_rules(context: Column, shot: Column, file: Column, samples: Column, choices: Column, label: Column, text: Column, contexts: list[str], shots: list[str], file_name: str) -> dict[str, Column]:
    """Of a question's payload."""
    return {
        "context": context.isin(contexts),
        "shot": shot.isin(shots),
        "file": file == file_name,
        "samples": (F.size(samples) > 0) & (F.size(F.array_distinct(samples)) == F.size(samples)),
        "choices": (F.size(choices) > 1) & (F.size(F.array_distinct(choices)) == F.size(choices)),
        "label": F.array_contains(choices, label),
        "text": (F.trim(text) != "") & ~text.rlike(r"\n[ \t]*\n[ \t]*\n"),
    }


def run_spec_rules(parameters: Column, forbidden: list[str], changed: Column, start: Column, end: Column, skipped: Column, hash_: Column, expected_hash: Column) -> dict[str, Column]:
    """Of a planned child: no forbidden parameter, one changed, a change inside the run, and its hash (NULL where it is skipped)."""
    return {
        "forbidden": F.size(F.array_intersect(F.map_keys(parameters), F.array(*map(F.lit, forbidden)))) == 0,
        "one_parameter": F.size(changed) == 1,
        "start": (start > 0) & (start < end),
        "hash": F.when(skipped, hash_.isNull()).otherwise(hash_ == expected_hash),
    }


def profile_rules(signals: Column, other_signals: Column, observable: Column, parameters: Column, other_parameters: Column) -> dict[str, Column]:
    """Of an environment's documents: equal lists of signals and parameters, in order, and no observable that isn't a signal."""
    return {
        "signals": signals == other_signals,
        "parameters": parameters == other_parameters,
        "observable": F.size(F.array_except(observable, signals)) == 0,
    }


def list_hash(ids: Column) -> Column:
    """SHA-256 of the sorted ids as a JSON list with blanks after its commas."""
    return F.sha2(F.concat(F.lit('["'), F.array_join(F.array_sort(ids), '", "'), F.lit('"]')), 256)


def manifest_rules(train: Column, test: Column, n_train: Column, n_test: Column, train_hash: Column, test_hash: Column) -> dict[str, Column]:
    """Of a row of a manifest: counts, order, uniqueness, no id in both sets, hashes."""
    each = {}
    for name, ids, n, h in (("train", train, n_train, train_hash), ("test", test, n_test, test_hash)):
        each |= {
            f"{name}_count": F.size(ids) == n,
            f"{name}_sorted": ids == F.array_sort(ids),
            f"{name}_unique": F.size(F.array_distinct(ids)) == F.size(ids),
            f"{name}_hash": list_hash(ids) == h,
        }
    return each | {"disjoint": ~F.arrays_overlap(train, test)}


def reused(manifest: DataFrame, keys: list[str], seed: str, train: str) -> DataFrame:
    """(keys, rule) where a training id serves several seeds of a key."""
    each = manifest.select(*keys, seed, F.explode(train).alias("id")).groupBy(*keys, "id").agg(F.count_distinct(seed).alias("n"))
    return each.where("n > 1").select(*keys).distinct().withColumn("rule", F.lit("train_reused"))


def totals_agree(stated: DataFrame, rows: DataFrame, keys: list[str], counts: dict[str, Column]) -> DataFrame:
    """(keys, rule) where a stated total isn't the count of the rows for which its condition holds; keys without rows count 0."""
    found = rows.groupBy(*keys).agg(*(F.count_if(c).alias(f"found_{n}") for n, c in counts.items()))
    both = stated.join(found, keys, "left")
    return broken(both, {n: F.col(n) == F.coalesce(f"found_{n}", F.lit(0)) for n in counts}, keys)


def graph_faults(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """(id, rule) of a graph's faults: repeated nodes, unknown kinds, ends of edges that are no nodes. nodes: id, kind; edges: source, target."""
    n = parts(nodes, edges, edges)
    own = nodes.select("id", F.lit(1).alias("node"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"), F.lit(0).alias("node"))
    counts = own.unionByName(ends).repartition(n, "id").groupBy("id").agg(F.sum("node").alias("nodes"), F.count_if(F.col("node") == 0).alias("ends"))
    missing = (F.col("ends") > 0) & ((F.col("nodes") == 0) | F.col("id").isNull())
    rules = F.array(F.when(F.col("nodes") > 1, "repeated"), F.when(missing, "missing_end"))
    found = counts.select("id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))
    return found.unionByName(broken(nodes, {"kind": F.col("kind").isin(kinds)}, ["id"]))


def results_faults(df: DataFrame, keys: list[str], required: list[str], metrics: list[str], allowed: DataFrame) -> DataFrame:
    """(keys, rule) of a results table read as texts: missing columns are an error; empty cells, metrics that are no share, pairs that aren't allowed."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    share = lambda c: F.col(c).try_cast("double").between(0, 1)
    rules = {f"empty {c}": F.trim(F.col(c).cast("string")) != "" for c in required} | {f"metric {m}": share(m) for m in metrics}
    pairs = df.join(allowed, allowed.columns, "left_anti").select(*keys, F.lit("pair").alias("rule"))
    return broken(df, rules, keys).unionByName(pairs)


def entry_state(status: Column, hash_: Column, run_id: Column) -> Column:
    """The state of a runtime entry: its status if that is known and hash and id have their forms, else 'malformed'."""
    said = F.lower(F.trim(status))
    good = said.isin("success", "failed", "not_run") & hash_.rlike("^[0-9a-f]{32}$") & run_id.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return F.when(F.coalesce(good, F.lit(False)), said).otherwise("malformed")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("k_", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order)))).where("k_ = 1").drop("k_")
