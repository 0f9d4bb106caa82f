"""What belongs to a run, a candidate, a question or a reader's state, looked up by keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import finite

#: How benchmarks of a kind begin, how variants with shots end, and how many shots a level has. Fixed values.
CLASSIFICATION = ("classification_", "equations_", "ucr_", "uea_")
EQUATIONS = ("equations_",)
ANOMALY = ("anomaly_", "tsb_ad_")
SHOT_ENDINGS = ("_one_shot", "_few_shot", "_many_shots", "_many_shot")
SHOTS = {"zero_shot": 0, "one_shot": 1, "few_shot": 3, "many_shots": 30}
ANOMALY_TASKS = ("anomaly_localization", "change_point_detection")


def child_contexts(specs: DataFrame, runtime: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(child, fault, baseline, time0, parameter, set_value, time, baseline_parameters, runtime) of each child asked for (child; without it, of every intervention of the runtime table).

    specs: (baseline, child, parameters as map, time0, time, baseline_parameters); runtime: (id, run_type, status and more).
    Ids count in lower case without blanks around. fault, the first that holds, leaves the rest null: no runtime entry,
    no intervention, not successful, no spec, not exactly one parameter with a value, no time. Of several specs of a
    child the one with the first baseline counts.
    """
    key = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    own = runtime.select(key(F.col("id")).alias("child"), F.struct(*(F.col(f"`{c}`") for c in runtime.columns)).alias("runtime")).dropDuplicates(["child"])
    wanted = own.where(F.lower(F.trim("runtime.run_type")) == "intervention").select("child") if asked is None else asked.select(key(F.col("child")).alias("child")).distinct()
    spec = F.struct(key(F.col("baseline")).alias("baseline"), key(F.col("time0")).alias("time0"), F.map_entries(F.map_filter("parameters", lambda k, v: (F.trim(k) != "") & v.isNotNull())).alias("changed"), F.col("time").cast("double").alias("time"), F.map_entries("baseline_parameters").alias("before"))
    first = specs.groupBy(key(F.col("child")).alias("child")).agg(F.min_by(spec, key(F.col("baseline"))).alias("s"))
    rows = wanted.join(own, "child", "left").join(first, "child", "left")
    kind, status = F.lower(F.trim("runtime.run_type")), F.lower(F.trim("runtime.status"))
    fault = (
        F.when(F.col("runtime").isNull(), "no runtime entry")
        .when(~F.coalesce(kind == "intervention", F.lit(False)), "no intervention")
        .when(~F.coalesce(status == "success", F.lit(False)), "not successful")
        .when(F.col("s").isNull(), "no spec")
        .when(F.coalesce(F.size("s.changed"), F.lit(0)) != 1, "not one parameter")
        .when(~finite(F.col("s.time")), "no time")
    )
    good = lambda c: F.when(F.col("fault").isNull(), c)
    change = F.get("s.changed", F.lit(0))
    return rows.withColumn("fault", fault).select(
        "child",
        "fault",
        good(F.col("s.baseline")).alias("baseline"),
        good(F.col("s.time0")).alias("time0"),
        good(F.trim(change["key"])).alias("parameter"),
        good(change["value"]).alias("set_value"),
        good(F.col("s.time")).alias("time"),
        good(F.map_from_entries("s.before")).alias("baseline_parameters"),
        good(F.col("runtime")).alias("runtime"),
    )


def candidate_bindings(parameters: DataFrame, bindings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parameter, place, low, high, strategy, fault, n, path, name, expression): each candidate parameter with its interval, once for each of its bindings.

    parameters: (keys, parameter, low, high[, strategy]); bindings: (keys, parameter, n, path, name, expression). place:
    of the parameter among those of its keys, in an order that ignores case (equal ones by their case). fault: bounds
    that aren't finite or are in the wrong order, no binding, a binding without path, name or expression.
    """
    own = Window.partitionBy(*keys).orderBy(F.lower("parameter"), "parameter")
    strategy = F.coalesce("strategy", F.lit("uniform")) if "strategy" in parameters.columns else F.lit("uniform")
    low, high = F.col("low").cast("double"), F.col("high").cast("double")
    rows = parameters.select(*keys, "parameter", (F.row_number().over(own) - 1).alias("place"), low.alias("low"), high.alias("high"), strategy.alias("strategy"))
    text = {c: F.nullif(F.trim(c), F.lit("")).alias(c) for c in ("path", "name", "expression")}
    found = rows.join(bindings.select(*keys, "parameter", "n", *text.values()), [*keys, "parameter"], "left")
    fault = F.when(~(finite(F.col("low")) & finite(F.col("high"))), "bounds").when(F.col("low") > F.col("high"), "interval").when(F.col("n").isNull(), "no binding").when(F.col("path").isNull() | F.col("name").isNull() | F.col("expression").isNull(), "binding")
    return found.withColumn("fault", fault).select(*keys, "parameter", "place", "low", "high", "strategy", "fault", "n", "path", "name", "expression")


def known_ids(registry: DataFrame) -> DataFrame:
    """(id, baseline): all runs that a registry (baseline, child, time0) names, and whether they are baselines."""
    each = F.explode(F.array(*(F.struct(F.trim(c).alias("id"), F.lit(c == "baseline").alias("baseline")) for c in ("baseline", "child", "time0"))))
    return registry.select(each.alias("x")).select("x.*").where("id IS NOT NULL AND id <> ''").groupBy("id").agg(F.bool_or("baseline").alias("baseline"))


def sanitised(states: DataFrame, registry: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """states with only such entries as the registry still has. fields: column -> run or baseline; a column is an array of ids, in whose order what stays remains, or a map by id."""
    known = known_ids(registry)
    kinds = dict(states.dtypes)
    out = states
    for column, of in fields.items():
        is_map = kinds[column].startswith("map")
        entries = F.map_entries(column) if is_map else F.col(column)
        each = states.select(key, F.posexplode(entries).alias("place", "entry")).withColumn("id", F.trim(F.col("entry.key") if is_map else F.col("entry")))
        kept = each.join(known.where("baseline") if of == "baseline" else known, "id", "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "id", "entry"))).alias("kept"))
        value = F.map_from_entries(F.transform("kept", lambda x: F.struct(x["id"].alias("key"), x["entry"]["value"].alias("value")))) if is_map else F.col("kept.entry")
        nothing = F.create_map().cast(kinds[column]) if is_map else F.array().cast(kinds[column])
        out = out.drop(column).join(kept.select(key, value.alias(column)), key, "left").withColumn(column, F.when(F.col(column).isNull(), nothing).otherwise(F.col(column)))
    return out.select(states.columns)


def begins_with(value: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a name begins with one of the prefixes, in any case, or is one without its last underscore."""
    found = F.lit(False)
    for p in prefixes:
        found = found | F.lower(value).startswith(p.lower()) | ((F.lower(value) == p.lower()[:-1]) if p.endswith("_") else F.lit(False))
    return F.coalesce(found, F.lit(False))


def benchmark_of(identity: Column, benchmark: Column, variant: Column) -> Column:
    """The name of a question's benchmark: its id, or benchmark and variant."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(identity), F.when(some(benchmark).isNotNull(), F.concat_ws("_", some(benchmark), some(variant))))


def kind_of_question(task: Column, benchmark: Column, more: tuple[str, ...] = ()) -> Column:
    """classification (with equations among it), anomaly or other: by the task where there is one, else by how the benchmark begins. more: further prefixes of classification, those of a project's own benchmarks."""
    task = F.nullif(task, F.lit(""))
    by_task = F.when(task == "classification", "classification").when(task.isin(*ANOMALY_TASKS), "anomaly").otherwise("other")
    by_name = F.when(begins_with(benchmark, (*CLASSIFICATION, *more)), "classification").when(begins_with(benchmark, ANOMALY), "anomaly").otherwise("other")
    return F.when(task.isNotNull(), by_task).otherwise(by_name)


def has_shots(variant: Column) -> Column:
    found = F.lit(False)
    for ending in SHOT_ENDINGS:
        found = found | variant.endswith(ending)
    return F.coalesce(found, F.lit(False))


def shot_fault(level: Column, n: Column, classes: Column, per_class: Column) -> Column:
    """What is wrong with a number of examples: an unknown level, counts below what they may be, or another total than the level's, or than that of all classes where it is given by class; null if nothing is."""
    name = F.lower(F.trim(level))
    totals = F.create_map(*(F.lit(x) for pair in SHOTS.items() for x in pair))
    by_class = per_class.isNotNull() & (name != "zero_shot")
    wanted = F.when(by_class, per_class * classes).otherwise(F.element_at(totals, name))
    return F.when(~F.coalesce(name.isin(*SHOTS), F.lit(False)), "level").when(by_class & (classes < 1), "classes").when(by_class & (per_class < 0), "per_class").when(n != wanted, "total")


def stepped(value: Column, time: Column, start: Column, end: Column) -> Column:
    """A signal that takes its end value from a time on; without a time it stays."""
    return F.when(time >= start, end).otherwise(value)


def json_safe(value: Column, kind: T.DataType) -> Column:
    """A value of any type as JSON can say it: numbers that aren't finite are null, binaries texts in base 64, dates and times texts, keys of maps texts."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(finite(value), value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), json_safe(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(entries)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(json_safe(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.BinaryType):
        return F.base64(value)
    if isinstance(kind, T.TimestampType):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return value.cast("string") if isinstance(kind, (T.DateType, T.TimestampNTZType, T.DayTimeIntervalType)) else value


def as_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Rows as JSON texts with sorted keys, nulls kept."""
    fields = sorted(columns or df.columns)
    return F.to_json(F.struct(*(json_safe(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) for c in fields)), {"ignoreNullFields": "false"})
