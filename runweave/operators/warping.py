"""Nearest runs under dynamic time warping, without computing most distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .classify import MOST_SUPPORT, tuned

#: Most bytes of a support set's values, which every worker holds.
MOST_SUPPORT_BYTES = 64 << 20
#: Values of both runs of the pairs that are warped together; what a worker holds is some times as much, or one pair.
CELLS = 1 << 18
#: A bound counts as over the best distance only by more than rounding.
_SLACK = 1 + 1e-9


def envelope(run: np.ndarray, band: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) of what each of `length` samples may be matched with: those of the run (samples, ...) within the band."""
    n, band = len(run), min(band, max(len(run), length))
    found, wide = [], 2 * band + 1
    for pick, none in ((np.minimum, np.inf), (np.maximum, -np.inf)):
        over = np.full((length + 2 * band, *run.shape[1:]), none)
        some = min(n, length + band)
        over[band : band + some] = run[:some]
        span = 1
        while 2 * span <= wide:  # of twice as many samples each time
            over = pick(over[:-span], over[span:])
            span *= 2
        found.append(pick(over[:length], over[wide - span :][:length]))
    return found[0], found[1]


def outside(run: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A lower bound of the squared warped distance of runs (samples, channels, ...): what the samples lie outside an envelope."""
    over = np.maximum(run - high, 0) + np.maximum(low - run, 0)
    return (over**2).sum((0, 1))


def dtw_of_pairs(a: np.ndarray, b: np.ndarray, band: int, best: np.ndarray) -> np.ndarray:
    """Squared warped distances of pairs of runs (samples, channels, pairs) within a band, all pairs by one anti-diagonal after another; three of them are held.

    Infinite for what is no number, and may be for pairs of which no path can stay under `best`; these are left out at times.
    """
    (n, _, pairs), m = a.shape, len(b)
    band = max(band, abs(n - m))
    out, alive = np.full(pairs, np.inf), np.arange(pairs)
    two, one, here = (np.full((n + 2, pairs), np.inf) for _ in range(3))
    two[0] = 0.0
    bounded, last = np.isfinite(best).any(), slice(0, 0)
    for s in range(2, n + m + 1):  # cells (i, s - i)
        lo, hi = max(1, s - m, (s - band + 1) // 2), min(n, s - 1, (s + band) // 2)
        if lo <= hi:
            square = (a[lo - 1 : hi] - b[s - hi - 1 : s - lo][::-1]) ** 2
            least = np.minimum(np.minimum(one[lo : hi + 1], one[lo - 1 : hi]), two[lo - 1 : hi])
            np.add(square[:, 0] if square.shape[1] == 1 else square.sum(1), least, out=here[lo : hi + 1])
        here[lo - 1] = here[hi + 1] = np.inf
        if bounded and s % 8 == 0:  # two diagonals hold a cell of each path
            low = np.minimum(here[lo : hi + 1].min(0, initial=np.inf), one[last].min(0, initial=np.inf))
            keep = low < best
            if 2 * keep.sum() <= len(keep):
                alive, a, b, best = alive[keep], a[..., keep], b[..., keep], best[keep]
                two, one, here = two[:, keep], one[:, keep], here[:, keep]
                if not len(alive):
                    return out
        last = slice(lo, hi + 1)
        two, one, here = one, here, two
    out[alive] = one[n]
    return np.where(np.isnan(out), np.inf, out)


class Support:
    """Runs (samples, channels) with the envelopes of a band, made when they are first needed."""

    def __init__(self, ids: list, labels: list, runs: list[np.ndarray], window: int | None):
        self.ids, self.labels, self.runs = ids, labels, runs
        self.window = window if window and window > 0 else None
        self.envelopes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.by_rank = np.argsort(np.array(ids, object), kind="stable")
        self.rank = self.by_rank.argsort()
        self.lengths = np.array([len(r) for r in runs], int)
        self.of_id: dict = {}
        for k, key in enumerate(ids):
            self.of_id.setdefault(key, []).append(k)

    def band(self, n: int, m: int) -> int:
        """Largest shift for runs of n and m samples: windows count it plus one, as a window of 1 is the straight path; no window, none."""
        return max(n, m) if self.window is None else max(self.window - 1, abs(n - m))

    def of(self, k: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        if (k, length) not in self.envelopes:
            self.envelopes[k, length] = envelope(self.runs[k], self.band(length, len(self.runs[k])), length)
        return self.envelopes[k, length]

    def bounds(self, keys: list, runs: np.ndarray) -> np.ndarray:
        """(queries, support): the larger of what the ends of both runs cost and what one lies outside the other's envelope; no number for a query's own run."""
        out = np.empty((runs.shape[2], len(self.runs)))
        for k, own in enumerate(self.runs):
            ends = ((runs[0] - own[0][:, None]) ** 2).sum(0)
            if len(runs) > 1 or len(own) > 1:
                ends = ends + ((runs[-1] - own[-1][:, None]) ** 2).sum(0)
            low, high = self.of(k, len(runs))
            out[:, k] = np.fmax(np.fmax(ends, outside(runs, low[..., None], high[..., None])), 0)
        for place, key in enumerate(keys):
            out[place, self.of_id.get(key, [])] = np.nan
        return out

    def distances(self, runs: np.ndarray, at: np.ndarray, k: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distances, which were computed) of pairs of queries and support runs; those that are over `worst` aren't, as far as the second envelope tells."""
        found, done, n = np.full(len(at), np.inf), np.zeros(len(at), bool), len(runs)
        for m in np.unique(self.lengths[k]):
            own = np.flatnonzero(self.lengths[k] == m)
            most = max(1, CELLS // ((n + m) * runs.shape[1]))
            for part in (own[i : i + most] for i in range(0, len(own), most)):
                band, limit = self.band(n, m), worst[part] * _SLACK
                which, own_of = np.unique(k[part], return_inverse=True)
                a, b = runs[..., at[part]], np.stack([self.runs[j] for j in which], -1)[..., own_of]
                if np.isfinite(limit).any():
                    near = ~(outside(b, *envelope(a, band, m)) > limit)
                    part, limit, a, b = part[near], limit[near], a[..., near], b[..., near]
                done[part], found[part] = True, dtw_of_pairs(a, b, band, limit + 1e-12)
        return found, done

    def nearest(self, keys: list, runs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(squared distances, places, how many distances were computed) of the nearest others of queries (samples, channels, queries), equal ones by id; infinite where there are fewer than `most`.

        Bounds from the cheapest on, each only where those before leave a run in the race: the ends of both runs, then
        what one lies outside the other's envelope. Runs are taken by their bounds, so the first distances are small:
        `most` of each query at once, then one, two, four and so on, of all queries together.
        """
        count, size = runs.shape[2], len(self.runs)
        bounds = self.bounds(keys, runs)
        order = np.lexsort((np.broadcast_to(self.rank, bounds.shape), bounds))
        bounds = np.take_along_axis(bounds, order, 1)
        best, rank = np.full((count, most), np.inf), np.full((count, most), size)
        computed, left = np.zeros(count, int), np.arange(count)
        begin, width, more = 0, most, 1
        while begin < size:
            left = left[bounds[left, begin] <= best[left, -1] * _SLACK]
            if not len(left):
                break
            part = slice(begin, begin + width)
            row, column = np.nonzero(bounds[left, part] <= best[left, -1:] * _SLACK)
            at, k = left[row], order[left, part][row, column]
            found, done = self.distances(runs, at, k, best[at, -1])
            computed += np.bincount(at[done], minlength=count)
            fresh = np.full((len(left), min(width, size - begin)), np.inf)
            theirs = np.full(fresh.shape, size)
            fresh[row, column], theirs[row, column] = found, self.rank[k]
            both, ranks = np.hstack([best[left], fresh]), np.hstack([rank[left], theirs])
            first = np.lexsort((ranks, both))[:, :most]
            best[left], rank[left] = np.take_along_axis(both, first, 1), np.take_along_axis(ranks, first, 1)
            begin, width, more = begin + width, more, 2 * more
        return best, np.append(self.by_rank, size)[rank], computed


def warped_nearest(queries: DataFrame, support: DataFrame, k: int, window: int | None = None, channels: int = 1) -> DataFrame:
    """(run_id, s_id, s_label, distance, computed): the k nearest other runs of a support set under dynamic time warping of squared differences.

    queries: (run_id, values); support: (run_id, label, values); channels of a sample stand one after another. window:
    shifts stay under it (or the difference of lengths); 0 or none: any shift. The distance is the root of the path's
    sum. computed: distances of the query that bounds didn't spare. The support is few shots, at most MOST_SUPPORT runs
    and MOST_SUPPORT_BYTES of values; a larger one is an error. Queries of one length are searched together.
    """
    size = support.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("values") * 8).alias("bytes")).first()
    if size.n > MOST_SUPPORT or (size.bytes or 0) > MOST_SUPPORT_BYTES:
        raise ValueError(f"a support set has at most {MOST_SUPPORT} runs and {MOST_SUPPORT_BYTES} bytes")
    rows = support.select("run_id", F.col("label").cast("string").alias("label"), "values").collect()
    held = queries.sparkSession.sparkContext.broadcast(([r.run_id for r in rows], [r.label for r in rows], [np.array(r["values"], float).reshape(-1, channels) for r in rows]))
    id_type, kinds = to_arrow_type(support.schema["run_id"].dataType), dict(queries.dtypes)
    names = ["run_id", "s_id", "s_label", "distance", "computed"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Support(*held.value, window)
        ids, labels = pa.array(own.ids, id_type), pa.array(own.labels, pa.string())
        for batch in batches:
            keys, values = batch.column(0).to_pylist(), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
            lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
            starts = lengths.cumsum() - lengths
            for n in np.unique(lengths[lengths > 0]):
                same = np.flatnonzero(lengths == n)
                block = max(1, CELLS * 4 // max(n, len(own.ids)))
                for rows in (same[i : i + block] for i in range(0, len(same), block)):
                    runs = values[starts[rows, None] + np.arange(n)].reshape(len(rows), -1, channels)
                    with np.errstate(invalid="ignore", over="ignore"):
                        best, place, computed = own.nearest([keys[r] for r in rows], np.ascontiguousarray(runs.transpose(1, 2, 0)), k)
                    at, column = np.nonzero(np.isfinite(best))
                    of = pa.array(place[at, column])
                    columns = [batch.column(0).take(pa.array(rows[at])), ids.take(of), labels.take(of), pa.array(np.sqrt(best[at, column])), pa.array(computed[at])]
                    yield pa.RecordBatch.from_arrays(columns, names)

    out = queries.select("run_id", "values").mapInArrow(find, f"run_id {kinds['run_id']}, s_id {dict(support.dtypes)['run_id']}, s_label string, distance double, computed long")
    return out.withColumn("s_label", F.col("s_label").cast(dict(support.dtypes)["label"]))


def tuned_windows(shots: DataFrame, windows: list[int], ks: list[int], channels: int = 1) -> DataFrame:
    """(setting, k, runs, correct, place): windows (0: any shift, the last among equals) and numbers of neighbours by leave-one-out accuracy over the shots; only the nearest max(ks) of each are looked for."""
    if min(ks) < 1:
        raise ValueError("numbers of neighbours are at least 1; all shots need all distances")
    every = None
    for window in windows:
        found = warped_nearest(shots, shots, max(ks), window, channels).withColumn("setting", F.lit(window if window > 0 else 1_000_000_000))
        every = found if every is None else every.unionByName(found)
    return tuned(every.drop("computed"), shots.select("run_id", "label"), ks)
