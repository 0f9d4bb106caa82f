"""Distances between runs held as arrays, and the classifiers on them."""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def truncated_rmse(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.sqrt(squared_distance(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)) / n)


def pearson(a: Column, b: Column) -> Column:
    """NULL if either is flat."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def around(m: Column) -> Column:
        start = F.struct(*(F.lit(0.0).alias(c) for c in ("ab", "aa", "bb")))

        def add(s: Column, v: Column) -> Column:
            x, y = v["x"] - m["a"], v["y"] - m["b"]
            return F.struct((s["ab"] + x * y).alias("ab"), (s["aa"] + x * x).alias("aa"), (s["bb"] + y * y).alias("bb"))

        sums = F.aggregate(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), start, add)
        return F.aggregate(F.array(sums), F.lit(None).cast("double"), lambda _, s: F.try_divide(s["ab"], F.sqrt(s["aa"] * s["bb"])))

    # the means are bound once, as members of an array of one
    means = F.array(F.struct((total(a) / F.size(a)).alias("a"), (total(b) / F.size(b)).alias("b")))
    return F.get(F.transform(means, around), F.lit(0))


#: Most runs of a support set. It is few shots of each class by contract; a larger one is an error.
MOST_SUPPORT = 10_000


def support_row(support: DataFrame) -> DataFrame:
    """One row with the support set as an array, after its size was checked."""
    if support.limit(MOST_SUPPORT + 1).count() > MOST_SUPPORT:
        raise ValueError(f"a support set has at most {MOST_SUPPORT} runs")
    each = F.struct(F.col("run_id").alias("s_id"), F.col("label").alias("s_label"), F.col("values").alias("s_values"))
    return support.agg(F.collect_list(each).alias("support"))


def pairs(queries: DataFrame, support: DataFrame) -> DataFrame:
    """Each query with each other run of a support set."""
    every = queries.crossJoin(F.broadcast(support_row(support)))  # of a single row
    return every.select(*queries.columns, F.inline("support")).where("s_id IS NULL OR run_id <> s_id")


def nearest_vote(queries: DataFrame, support: DataFrame, distance: Callable[[Column, Column], Column], k: int) -> DataFrame:
    """(run_id, predicted): of the k nearest other runs of the support, most votes, then least total distance, then smallest label. Nothing is shuffled."""
    every = queries.crossJoin(F.broadcast(support_row(support)))
    others = F.filter("support", lambda s: s["s_id"] != F.col("run_id"))
    near = F.transform(others, lambda s: F.struct(distance(F.col("values"), s["s_values"]).alias("distance"), s["s_id"].alias("s_id"), s["s_label"].alias("s_label")))
    near = every.select("run_id", F.slice(F.array_sort(near), 1, k).alias("near"))
    return near.select("run_id", voted("near").alias("predicted"))


def voted(near: str) -> Column:
    """What the neighbours of an array (distance, s_id, s_label) vote for: most votes, then least total distance, then smallest label."""
    def standing(label: Column) -> Column:
        own = F.filter(near, lambda n: n["s_label"] == label)
        total = F.aggregate(own, F.lit(0.0), lambda t, n: t + n["distance"])
        return F.struct((-F.size(own)).alias("n"), total.alias("total"), label.alias("label"))

    return F.array_min(F.transform(F.array_distinct(f"{near}.s_label"), standing))["label"]


def vote(distances: DataFrame, k: int) -> DataFrame:
    """Of the k nearest: most votes, then least total distance, then smallest label."""
    near = distances.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("distance", "s_id"))).where(F.col("place") <= k)
    votes = near.groupBy("run_id", "s_label").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("total"))
    return votes.groupBy("run_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "total", "s_label"))["s_label"].alias("predicted"))


def centroids(support: DataFrame) -> DataFrame:
    means = support.select("label", F.posexplode("values").alias("pos", "v")).groupBy("label", "pos").agg(F.avg("v").alias("v"))
    ordered = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("p"))
    return ordered.select(F.col("label").alias("run_id"), "label", F.col("p.v").alias("values"))


def few_shots(runs: DataFrame, shots: int) -> DataFrame:
    """The first runs of each class by id."""
    return runs.withColumn("shot", F.row_number().over(Window.partitionBy("label").orderBy("run_id"))).where(F.col("shot") <= shots).drop("shot")


#: Cells of a row up to which warping goes row by row: whole anti-diagonals pay only for wider bands.
NARROW = 48


def _dtw_narrow(a: list[float], b: list[float], band: int, best: float) -> float:
    """Warping of runs of one channel, row by row; every path crosses each row, so it ends once a row is not under `best`."""
    inf, m = float("inf"), len(b)
    before = [0.0] + [inf] * m
    for i, x in enumerate(a, 1):
        low, high = max(1, i - band), min(m, i + band)
        row, left = [inf] * (m + 1), inf
        for j in range(low, high + 1):
            least = before[j] if before[j] < before[j - 1] else before[j - 1]
            d = x - b[j - 1]
            left = row[j] = d * d + (left if left < least else least)
        if min(row[low : high + 1], default=inf) >= best:
            return inf
        before = row
    return before[m]


def dtw(a: np.ndarray, b: np.ndarray, band: int | None = None, best: float = np.inf) -> float:
    """Dynamic time warping of squared differences of runs (samples, channels) within a band.

    Narrow bands go row by row, wide ones by whole anti-diagonals. Infinite once no path can stay under `best`.
    """
    a, b = (x[:, None] if x.ndim == 1 else x for x in (a, b))
    n, m = len(a), len(b)
    band = max(n, m) if band is None else max(band, abs(n - m))
    if a.shape[1] == 1 and min(2 * band + 1, m) <= NARROW:
        return _dtw_narrow(a[:, 0].tolist(), b[:, 0].tolist(), band, best)
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0.0
    i = np.arange(1, n + 1)
    low = np.inf
    for s in range(2, n + m + 1):
        j = s - i
        some = (j >= 1) & (j <= m) & (np.abs(i - j) <= band)
        p, q = i[some], j[some]
        if not len(p):
            continue
        here = ((a[p - 1] - b[q - 1]) ** 2).sum(1) + np.minimum(np.minimum(cost[p - 1, q], cost[p, q - 1]), cost[p - 1, q - 1])
        cost[p, q] = here
        if min(low, here.min()) >= best:  # two diagonals hold a cell of each path
            return float("inf")
        low = here.min()
    return float(cost[n, m])


def dtw_distances(candidates: DataFrame, band: int | None, channels: int = 1) -> DataFrame:
    """DTW of candidate pairs (run_id, s_id, s_label, values, s_values), in Arrow batches. channels: of each sample, one after another in the arrays."""

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([dtw(np.asarray(x, float).reshape(-1, channels), np.asarray(y, float).reshape(-1, channels), band) for x, y in zip(a, b, strict=True)])

    return candidates.select("run_id", "s_id", "s_label", distance("values", "s_values").alias("distance"))


def greedy_matches(times: list, values: list[float], rt: list, rv: list[float], within: int, scale: float) -> tuple[int, float]:
    """(matches, loss) of greedy matching; both sides by time.

    What lies within reach of the next event is held by magnitude, each magnitude's events by time, and the magnitudes in
    a heap, so an event costs a search among those of one magnitude, not a look at all that are near.
    """
    held: dict[float, list[tuple]] = {}
    heap: list[float] = []
    n, loss, end = 0, 0.0, 0
    for t, v in zip(times, values, strict=True):
        while end < len(rt) and rt[end] < t + within + 1:
            size = abs(rv[end])
            size = -size if size == size else 1.0  # what is no number comes last
            if not held.setdefault(size, []):
                heapq.heappush(heap, size)
            held[size].append((rt[end], end))
            end += 1
        while heap:
            near = held[heap[0]]
            del near[: bisect.bisect_left(near, (t - within,))]
            if near:
                break
            heapq.heappop(heap)
        else:
            continue
        after = bisect.bisect_left(near, (t,))
        at = [after] if after < len(near) else []
        if after:
            at.append(bisect.bisect_left(near, (near[after - 1][0],)))  # the first of those at the same time
        s, k = near.pop(min(at, key=lambda p: (abs(near[p][0] - t), near[p][1])))
        if not near:
            heapq.heappop(heap)
        loss += abs(s - t) / within + abs(abs(v) - abs(rv[k])) / scale
        n += 1
    return n, loss


def match_events(df: DataFrame, keys: list[str], within: int) -> DataFrame:
    """(keys, matched, unmatched, loss): greedy one-to-one matching of events of side 'b' to those of side 'a' within a time: largest magnitude, then nearest.

    df: keys, side, t, value. The loss is, of each match, its distance as a share of `within` and the difference of
    magnitudes as a share of the largest of side a; and 1 for each event without a match. No match crosses a gap wider
    than `within`, so a task holds a stretch between such gaps at a time, however many events a key has.
    """
    schema = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys) + ", matched long, unmatched long, loss double"
    own = Window.partitionBy(*keys)
    gap = F.col("t") - F.lag("t").over(own.orderBy("t"))
    scale = F.greatest(F.lit(1e-9), F.coalesce(F.max(F.when(F.col("side") == "a", F.abs("value"))).over(own), F.lit(1.0)))
    fresh = F.coalesce(gap > within, F.lit(False)) | (F.row_number().over(own.orderBy("t")) == 1)
    ordered = df.select(*keys, "side", "t", "value", scale.alias("scale"), fresh.alias("fresh"))
    ordered = ordered.repartition(*keys).sortWithinPartitions(*keys, "t", F.desc("fresh"))
    kinds = [*(to_arrow_type(df.schema[k].dataType) for k in keys), pa.int64(), pa.int64(), pa.float64()]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows, stretch by stretch; only one stretch and a batch are held."""
        now, sides, untimed, last = None, {}, 0, 1.0

        def done() -> tuple:
            n, loss = greedy_matches(*sides["a"], *sides["b"], within, last)
            lost = len(sides["a"][0]) + len(sides["b"][0]) + untimed - 2 * n
            return (*now, n, lost, loss + lost)

        def packed(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*keys, "matched", "unmatched", "loss"])

        for batch in batches:
            out = []
            for *key, side, t, value, most, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first:
                    if now is not None:
                        out.append(done())
                    now, sides, untimed, last = key, {"a": ([], []), "b": ([], [])}, 0, most
                if side in sides and t is None:
                    untimed += 1
                elif side in sides:
                    sides[side][0].append(t)
                    sides[side][1].append(float("nan") if value is None else value)
            yield packed(out)
        if now is not None:
            yield packed([done()])

    parts = ordered.mapInArrow(match, schema)
    return parts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("matched", "unmatched", "loss")))


def truncated_centroids(support: DataFrame) -> DataFrame:
    """(run_id, label, values): the mean run of each class, as long as its shortest member."""
    shortest = support.groupBy("label").agg(F.min(F.size("values")).alias("n_"))
    cut = support.join(shortest, "label").withColumn("values", F.slice("values", F.lit(1), F.col("n_")))
    return centroids(cut.drop("n_"))


def truncated_pearson(a: Column, b: Column) -> Column:
    """Correlation over the shorter length; minus infinity where it isn't defined."""
    n = F.least(F.size(a), F.size(b))
    return F.coalesce(pearson(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)), F.lit(float("-inf")))


def lag_distance(a: np.ndarray, b: np.ndarray, most: int) -> float:
    """1 less the largest mean correlation of the channels over lags of up to `most` samples; overlaps of one sample and flat channels count 0. 0 to 2."""
    best = -1.0
    for lag in range(-most, most + 1):
        x, y = (a[max(0, -lag) :], b[max(0, lag) :])
        n = min(len(x), len(y))
        if n < 2:
            continue
        x, y = x[:n] - x[:n].mean(0), y[:n] - y[:n].mean(0)
        norm = np.sqrt((x**2).sum(0) * (y**2).sum(0))
        r = np.divide((x * y).sum(0), norm, out=np.zeros_like(norm), where=norm > 1e-12)
        best = max(best, float(r.mean()))
    return float(np.clip(1 - best, 0, 2))


def lag_distances(candidates: DataFrame, most: int, channels: int = 1) -> DataFrame:
    """Distances by lagged correlation of candidate pairs, in Arrow batches; channels of a sample stand one after another."""

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lag_distance(np.asarray(x, float).reshape(-1, channels), np.asarray(y, float).reshape(-1, channels), most) for x, y in zip(a, b, strict=True)])

    return candidates.select("run_id", "s_id", "s_label", distance("values", "s_values").alias("distance"))


def tuned(distances: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """(setting, k, runs, correct): leave-one-out accuracy of a support set by setting and number of neighbours (0: all), the best first by `place`.

    distances: (setting, run_id, s_id, s_label, distance) of the support's runs to its others; truth: (run_id, label).
    Equal accuracies go to the smaller setting, then to the smaller k.
    """
    near = distances.withColumn("rank", F.row_number().over(Window.partitionBy("setting", "run_id").orderBy("distance", "s_id")))
    each = near.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where((F.col("k") <= 0) | (F.col("rank") <= F.col("k")))
    votes = each.groupBy("setting", "k", "run_id", "s_label").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("total"))
    said = votes.groupBy("setting", "k", "run_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "total", "s_label"))["s_label"].alias("predicted"))
    score = said.join(truth, "run_id").groupBy("setting", "k").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("predicted") == F.col("label")).alias("correct"))
    order = Window.orderBy(F.desc(F.col("correct") / F.col("runs")), "setting", "k")  # a row for each of few settings
    return score.withColumn("place", F.row_number().over(order))


#: Named classifiers: distance, its settings, and numbers of neighbours (0: all shots). Fixed values.
METHODS = {
    "euclidean_1nn": ("euclidean", [0], [1]),
    "euclidean_allshots": ("euclidean", [0], [0]),
    "dtw_k1": ("dtw", [0, 5, 10, 25, 50], [1]),
    "dtw_allshots": ("dtw", [0, 5, 10, 25, 50], [0]),
    "xcorr_k1": ("xcorr", [0, 5, 10, 25, 50], [1]),
    "xcorr_allshots": ("xcorr", [0, 5, 10, 25, 50], [0]),
}


def distances_by(method: str, candidates: DataFrame, setting: int, channels: int = 1) -> DataFrame:
    """Distances of candidate pairs by a named one; setting: window (0: any shift, which comes last) or largest lag in samples."""
    if method == "dtw":  # a window of 1 is the straight path, one of 0 none at all
        found = dtw_distances(candidates, setting - 1 if setting > 0 else None, channels)
        setting = setting if setting > 0 else 1_000_000_000
    elif method == "xcorr":
        found = lag_distances(candidates, setting, channels)
    elif method == "euclidean":
        found = candidates.select("run_id", "s_id", "s_label", squared_distance(F.col("values"), F.col("s_values")).alias("distance"))
    else:
        raise ValueError(f"unknown distance: {method}")
    return found.withColumn("setting", F.lit(setting))


def chance(classes: Column) -> Column:
    """Expected accuracy without shots."""
    return F.when(classes > 0, 1.0 / classes)
