"""Distances of all pairs of runs of a family, and the choice of one run of each label whose nearest two are furthest apart."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Runs of a family that a block holds, about; blocks meet each other block of their family once.
BLOCK = 64
#: Parts that the search of a family is dealt into, at most.
PARTS = 16


def pairwise_mse(runs: DataFrame, family: str, start: int | float | str = 0, signal: str | None = None, block: int = BLOCK) -> DataFrame:
    """(family, a_id, b_id, [signal,] mse) of each pair of runs of a family, once: the mean squared difference from a place on.

    runs: (family, run_id, pos, value[, signal][, start]). start is a place for all, or a column with that of each run
    (null: its last place); a pair begins at the earlier of both. Places that either run lacks, or where a value is
    null or NaN, don't count; a pair without any has a null. The mean over signals is `over_signals`.

    A run becomes one row. Rows are dealt into blocks by a hash of the run; each pair of blocks is a group of at most
    two blocks' runs, so a family of n runs is sent n / block times, whatever its size, and no place is a key.
    """
    met = _blocks(runs, family, start, signal, block)
    kinds = dict(runs.dtypes)
    columns = [family, "a_id", "b_id", "signal", "mse"]

    def compare(table: pa.Table) -> pa.Table:
        ids, parts = table["run_id"].combine_chunks(), table["part"].to_numpy()
        values, starts, grid, names = _dense(table)
        sides = (np.flatnonzero(parts == table["low"][0].as_py()), np.flatnonzero(parts == table["high"][0].as_py()))
        left, right, out = [], [], []
        for i in sides[0]:
            others = sides[1][sides[1] > i] if sides[0] is sides[1] or np.array_equal(*sides) else sides[1]
            if len(others):
                left.append(np.full(len(others), i))
                right.append(others)
                out.append(_means(values[others] - values[i], np.searchsorted(grid, np.minimum(starts[others], starts[i]))))
        a, b, mse = (np.concatenate(x) if x else np.zeros((0, len(names)) if x is out else 0, float if x is out else int) for x in (left, right, out))
        key = ids.to_pylist()
        swap = np.array([key[x] > key[y] for x, y in zip(a, b, strict=True)], bool)
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        n = len(names)
        flat = pa.array(mse.ravel(), pa.float64(), from_pandas=True)
        same = pa.array([table[family][0].as_py()] * len(a) * n, table.schema.field(family).type)
        return pa.table([same, ids.take(pa.array(np.repeat(a, n))), ids.take(pa.array(np.repeat(b, n))), pa.array(np.tile(np.array(names, object), len(a)), pa.string()), flat], names=columns)

    found = met.groupBy(family, "low", "high").applyInArrow(compare, f"`{family}` {kinds[family]}, a_id {kinds['run_id']}, b_id {kinds['run_id']}, signal string, mse double")
    return found.withColumnRenamed("signal", signal) if signal else found.drop("signal")


def _blocks(runs: DataFrame, family: str, start: int | float | str, signal: str | None, block: int) -> DataFrame:
    """Runs as rows (family, low, high, run_id, part, start, samples), each once for every pair of blocks that its own belongs to."""
    own = F.col(start) if isinstance(start, str) else F.lit(float(start))
    sample = F.struct((F.col(signal).cast("string") if signal else F.lit("")).alias("signal"), F.col("pos").cast("double").alias("pos"), F.col("value").cast("double").alias("value"))
    rows = runs.groupBy(family, "run_id").agg(F.coalesce(F.min(own), F.max("pos")).cast("double").alias("start"), F.collect_list(sample).alias("samples"))
    sizes = rows.groupBy(F.col(family).alias("of")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = rows.join(sizes, F.col(family).eqNullSafe(F.col("of"))).withColumn("part", F.pmod(F.xxhash64("run_id"), F.col("blocks")).cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select(family, F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "run_id", "part", "start", "samples")


#: Runs of a family that a block holds, about, where only extremes are asked for; and rows of its tables of distances.
WIDE_BLOCK, TILE = 8192, 1024


def pairwise_extremes(runs: DataFrame, family: str, start: int | float | str = 0, block: int = WIDE_BLOCK) -> DataFrame:
    """(family, pairs, least, most): the number of pairs of a family, and the extremes of what `pairwise_mse` gives for them, for runs of one signal.

    No pair becomes a row. Tables of distances come from products of matrices; those that rounding could make an extreme
    are computed from the differences. Runs with gaps or starts of their own are compared one by one.
    """
    kinds = dict(runs.dtypes)

    def compare(table: pa.Table) -> pa.Table:
        parts = table["part"].to_numpy()
        values, starts, grid, names = _dense(table)
        sides = [np.flatnonzero(parts == table[c][0].as_py()) for c in ("low", "high")]
        same = np.array_equal(*sides)
        found = _Extremes(values, np.searchsorted(grid, starts))
        if len(names) == 1 and len(set(starts)) == 1 and not np.isnan(values).any():
            found.tiles(*sides, same)
        else:
            for i in sides[0]:
                others = sides[1][sides[1] > i] if same else sides[1]
                found.add(np.full(len(others), i), others)
        n = len(sides[0]) * (len(sides[0]) - 1) // 2 if same else len(sides[0]) * len(sides[1])
        return pa.table([pa.array([table[family][0].as_py()], table.schema.field(family).type), pa.array([n], pa.int64()), *(pa.array([x], pa.float64(), from_pandas=True) for x in (found.least, found.most))], names=[family, "pairs", "least", "most"])

    found = _blocks(runs, family, start, None, block).groupBy(family, "low", "high").applyInArrow(compare, f"`{family}` {kinds[family]}, pairs long, least double, most double")
    return found.groupBy(family).agg(F.sum("pairs").alias("pairs"), F.min("least").alias("least"), F.max("most").alias("most")).where("pairs > 0")


class _Extremes:
    """The least and the most distance of pairs of runs (run, signal, place) from places on; NaN without any."""

    def __init__(self, values: np.ndarray, begin: np.ndarray):
        self.values, self.begin, self.least, self.most = values, begin, np.nan, np.nan

    def add(self, a: np.ndarray, b: np.ndarray, size: int = 4096) -> None:
        for k in range(0, len(a), size):
            x, y = a[k : k + size], b[k : k + size]
            mse = _means(self.values[y] - self.values[x], np.minimum(self.begin[x], self.begin[y]))
            self.least, self.most = np.fmin(self.least, np.nanmin(mse, initial=np.inf)), np.fmax(self.most, np.nanmax(mse, initial=-np.inf))
        self.least, self.most = (np.nan if np.isinf(x) and not np.isinf(self.values).any() else x for x in (self.least, self.most))

    def tiles(self, rows: np.ndarray, columns: np.ndarray, same: bool) -> None:
        x = self.values[:, 0, self.begin[0] :]
        x = x - x.mean(axis=0)
        square = (x * x).sum(axis=1)
        n = x.shape[1]
        slack = 4e-15 * (n + 10) * square.max(initial=0)
        if not n or not np.isfinite(slack):
            return self.add(*(v.ravel() for v in np.meshgrid(rows, columns))) if n else None
        for i in range(0, len(rows), TILE):
            a = rows[i : i + TILE]
            for j in range(i if same else 0, len(columns), TILE):
                b = columns[j : j + TILE]
                d = square[a][:, None] + square[b] - 2 * (x[a] @ x[b].T)
                low = high = d
                if same and i == j:
                    other = np.tri(len(a), dtype=bool)
                    low, high = np.where(other, np.inf, d), np.where(other, -np.inf, d)
                least, most = low.min(initial=np.inf), high.max(initial=-np.inf)
                if least < np.inf and self.least != 0 and not least - slack > self.least * n:
                    p, q = np.nonzero(low <= least + slack)
                    self.add(a[p], b[q])
                if most > -np.inf and not most + slack < self.most * n:
                    p, q = np.nonzero(high >= most - slack)
                    self.add(a[p], b[q])


def wanted_mse(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (a_id, b_id) with mse, as `pairwise_mse` gives it for runs (run_id, pos, value) of one signal. Only the runs wanted become rows, and only the pairs wanted meet."""
    ids = wanted.select(F.col("a_id").alias("run_id")).union(wanted.select("b_id")).distinct()
    sample = F.struct(F.col("pos").cast("double").alias("pos"), F.col("value").cast("double").alias("value"))
    rows = runs.join(ids, "run_id", "left_semi").where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    rows = rows.groupBy("run_id").agg(F.array_sort(F.collect_list(sample)).alias("s_"))
    side = lambda x: rows.select(F.col("run_id").alias(f"{x}_id"), F.col("s_.pos").alias(f"{x}_pos"), F.col("s_.value").alias(f"{x}_value"))
    both = wanted.select("a_id", "b_id").join(side("a"), "a_id", "left").join(side("b"), "b_id", "left")

    @F.pandas_udf("double")
    def distance(a_pos: pd.Series, a: pd.Series, b_pos: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        for k, (p, x, q, y) in enumerate(zip(a_pos, a, b_pos, b, strict=True)):
            if p is not None and q is not None:
                if not np.array_equal(p, q):
                    _, i, j = np.intersect1d(p, q, return_indices=True)
                    x, y = x[i], y[j]
                out[k] = ((y - x) ** 2).sum() / len(x) if len(x) else np.nan
        return pd.Series(out)

    mse = distance("a_pos", "a_value", "b_pos", "b_value")
    return both.select("a_id", "b_id", F.nanvl(mse, F.lit(None).cast("double")).alias("mse"))


def _dense(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(values of run, signal and place, NaN where there is none; starts; places; signals) of a group's rows."""
    samples = table["samples"].combine_chunks()
    flat = samples.flatten()
    run = np.repeat(np.arange(len(samples)), np.diff(samples.offsets.to_numpy()))
    grid, at = np.unique(flat.field("pos").to_numpy(zero_copy_only=False), return_inverse=True)
    coded = flat.field("signal").dictionary_encode()
    out = np.full((len(samples), len(coded.dictionary), len(grid)), np.nan)
    out[run, coded.indices.to_numpy(), at] = flat.field("value").to_numpy(zero_copy_only=False)
    return out, table["start"].to_numpy(), grid, coded.dictionary.to_pylist()


def _means(differences: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Mean square along the last axis from each row's place on, NaN left out; NaN where nothing is left."""
    square = differences**2
    bad = np.isnan(square)
    square[bad | (np.arange(square.shape[2]) < begin[:, None, None])] = 0
    n = (~bad & (np.arange(square.shape[2]) >= begin[:, None, None])).sum(axis=2)
    return np.where(n > 0, square.sum(axis=2) / np.maximum(n, 1), np.nan)


def over_signals(pairs: DataFrame, family: str) -> DataFrame:
    """The mean of the signals' distances of each pair, those without one left out."""
    return pairs.groupBy(family, "a_id", "b_id").agg(F.avg("mse").alias("mse"))


def every_choice(runs: DataFrame, family: str, label: str) -> DataFrame:
    """(family, choice) for each way to take one run of each label; choice: run ids in the labels' order. It has as many rows as there are ways."""
    named = runs.where(F.col(label).isNotNull()).select(family, label, "run_id").distinct()
    turns = named.select(family, "run_id", F.dense_rank().over(Window.partitionBy(family).orderBy(label)).alias("turn"))
    most = turns.agg(F.max("turn")).first()[0] or 0
    out = turns.where("turn = 1").select(family, F.array("run_id").alias("choice"))
    ends = turns.groupBy(family).agg(F.max("turn").alias("turns"))
    for k in range(2, most + 1):
        more = turns.where(F.col("turn") == k).select(family, "run_id")
        out = out.join(more, family, "left").select(family, F.when(F.col("run_id").isNull(), F.col("choice")).otherwise(F.array_append("choice", F.col("run_id"))).alias("choice"))
    return out.join(ends, family).where(F.size("choice") == F.col("turns")).drop("turns")


def separation(choices: DataFrame, pairs: DataFrame, family: str) -> DataFrame:
    """(family, choice, separation): the least finite distance of two runs of each choice; without any, null."""
    places = F.transform(F.sequence(F.lit(1), F.size("choice")), lambda k: F.struct(F.element_at("choice", k).alias("x"), F.slice("choice", k + 1, F.size("choice")).alias("ys")))
    both = choices.select(family, "choice", F.explode(places).alias("p")).select(family, "choice", F.col("p.x").alias("x"), F.explode("p.ys").alias("y"))
    both = both.select(family, "choice", F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"))
    finite = F.when(F.abs("mse") < float("inf"), F.col("mse"))
    return both.join(pairs, [family, "a_id", "b_id"], "left").groupBy(family, "choice").agg(F.min(finite).alias("separation"))


def best_separated_choice(pairs: DataFrame, runs: DataFrame, family: str, label: str) -> DataFrame:
    """(family, choice, separation): the choice of one run of each label whose least finite distance is greatest, of equal ones the first by run ids in the labels' order.

    pairs: (family, a_id, b_id, mse), each pair once. Distances that are missing or not finite don't count; families of
    one label, or without a finite distance, have no choice.

    No choice is listed. A run is worth at most the least, over the other labels, of its best distance to one of
    their runs; taking the worthiest run of each label gives a separation that is reached. Runs worth less are left
    out, by aggregates over pairs. What is left is searched: by falling thresholds, for runs of all labels that lie
    that far apart, with backtracking over sets of compatible runs. The first label's runs are dealt into parts.
    """
    named = runs.where(F.col(label).isNotNull()).select(family, "run_id", F.col(label).alias("own")).distinct()
    of = [named.select(family, F.col("run_id").alias(f"{x}_id"), F.col("own").alias(f"{x}_label")) for x in "ab"]
    across = reduce(lambda p, x: p.join(x[0], [family, f"{x[1]}_id"]), zip(of, "ab", strict=True), pairs).where("a_label <> b_label")
    across = across.withColumn("d", F.when(F.abs("mse") < float("inf"), F.col("mse")))
    ways = [across.select(family, F.col(f"{x}_id").alias("run_id"), F.col(f"{x}_label").alias("own"), F.col(f"{y}_label").alias("other"), "d") for x, y in ("ab", "ba")]
    unknown = F.max(F.when(F.col("d").isNull(), F.lit(float("inf"))).otherwise(F.col("d")))
    best = ways[0].unionByName(ways[1]).groupBy(family, "run_id", "own", "other").agg(unknown.alias("d"))
    worth = best.groupBy(family, "run_id", "own").agg(F.min("d").alias("worth"))
    worthiest = worth.groupBy(family, "own").agg(F.min(F.struct(-F.col("worth"), "run_id"))["run_id"].alias("run_id"))
    picks = worthiest.groupBy(family).agg(F.collect_list("run_id").alias("choice"))
    reached = separation(picks, pairs, family).select(family, F.col("separation").alias("reached"))
    kept = worth.join(reached, family).where(F.col("worth") >= F.coalesce("reached", F.lit(0.0))).select(family, "run_id", "own")
    first = kept.groupBy(family).agg(F.min("own").alias("own"))
    dealt = F.pmod(F.xxhash64("run_id"), F.lit(PARTS)).cast("int")
    parts = kept.join(first, [family, "own"]).groupBy(family).agg(F.collect_set(dealt).alias("parts"))
    sides = [kept.select(family, F.col("run_id").alias(f"{x}_id"), F.col("own").alias(f"{x}_label")) for x in "ab"]
    left = reduce(lambda p, x: p.join(x[0], [family, f"{x[1]}_id"]), zip(sides, "ab", strict=True), across.select(family, "a_id", "b_id", "d"))
    problem = left.join(parts, family).select(family, F.explode("parts").alias("part"), "a_id", "a_label", "b_id", "b_label", "d", *(F.pmod(F.xxhash64(f"{x}_id"), F.lit(PARTS)).cast("int").alias(f"{x}_part") for x in "ab"))
    kinds = dict(pairs.dtypes)

    def search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = _search(table, key[1].as_py())
        ids = pa.array([found[1]] if found else [], pa.list_(table.schema.field("a_id").type))
        return pa.table([pa.array([key[0].as_py()] if found else [], key[0].type), ids, pa.array([found[0]] if found else [], pa.float64())], names=[family, "choice", "separation"])

    out = problem.groupBy(family, "part").applyInArrow(search, f"`{family}` {kinds[family]}, choice array<{kinds['a_id']}>, separation double")
    return out.groupBy(family).agg(F.min(F.struct((-F.col("separation")).alias("s"), "choice")).alias("best")).select(family, "best.choice", (-F.col("best.s")).alias("separation"))


def _search(table: pa.Table, part: int) -> tuple[float, list] | None:
    """(separation, choice) of the best choice whose first label's run belongs to the part."""
    label, dealt = {}, {}
    for x in "ab":
        label |= dict(zip(table[f"{x}_id"].to_pylist(), table[f"{x}_label"].to_pylist(), strict=True))
        dealt |= dict(zip(table[f"{x}_id"].to_pylist(), table[f"{x}_part"].to_pylist(), strict=True))
    labels = sorted(set(label.values()))
    runs = sorted((r for r in label if label[r] != labels[0] or dealt[r] == part), key=lambda r: (label[r], r))
    place = {r: k for k, r in enumerate(runs)}
    a, b = ([place.get(r, -1) for r in table[f"{x}_id"].to_pylist()] for x in "ab")
    rows = [(x, y, d) for x, y, d in zip(a, b, table["d"].to_pylist(), strict=True) if x >= 0 and y >= 0]
    levels = sorted({d for _, _, d in rows if d is not None})
    groups = [sum(1 << place[r] for r in runs if label[r] == own) for own in labels]
    known = {(x, y) for x, y, d in rows if d is not None} | {(y, x) for x, y, d in rows if d is not None}
    if not levels or not all(groups):
        return None

    def choice(least: float) -> list[int] | None:
        """The first choice whose finite distances are all at least so large."""
        near = [0] * len(runs)
        for x, y, d in rows:
            if d is not None and d < least:
                near[x] |= 1 << y
                near[y] |= 1 << x

        def extend(taken: list[int], free: int) -> list[int] | None:
            if len(taken) == len(groups):
                return taken if any((x, y) in known for x in taken for y in taken) else None
            own = groups[len(taken)] & free
            while own:
                run = (own & -own).bit_length() - 1
                own &= own - 1
                left = free & ~near[run]
                if all(g & left for g in groups[len(taken) + 1 :]) and (out := extend([*taken, run], left)):
                    return out
            return None

        return extend([], (1 << len(runs)) - 1)

    low, high, best = 0, len(levels) - 1, choice(levels[0])
    while low < high:
        middle = (low + high + 1) // 2
        if found := choice(levels[middle]):
            low, best = middle, found
        else:
            high = middle - 1
    return (levels[low], [runs[k] for k in best]) if best else None
