"""Toxicity by weak supervision.

1. Voters: patterns (capitals, exclamation marks, stretched letters, unusual characters), and many small lexicons,
   each of a word or of all words with one beginning (of 4 to 6 bytes), that mark toxic texts of a bounded sample of
   labelled rows; a greedy cover picks these. No word is given beforehand. Lexicons are cross-fitted: on a sampled
   text only those vote that mark toxic texts without the text's own fold.
2. A generative label model, fitted by expectation maximisation from the voters' own agreement and the given
   label, which is one more voter of unknown accuracy, has for each voter how often it fires on toxic and on other
   texts, and correlations of voters given the class: correlated voters share their evidence. It gives each
   sampled text a posterior label.
3. A logistic regression over the voters and their density learns the posterior labels and scores all texts.

Null and empty texts have no words and get the score of the intercept. Repeated texts count once in the
sample. Without labelled rows of both classes every score is the smoothed share of toxic labels. `score` leaves
extra columns out, `drop_toxic` keeps them, whatever their names; of an empty table nothing is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import ALNUM, Words

#: Most labelled rows that are learnt from, taken in the order of a hash of their id; units that the cover chooses from, and voters it picks.
SAMPLE_ROWS, CANDIDATES, MOST_VOTERS = 20_000, 2_048, 128
#: Fewest sampled toxic texts with a unit; most of its texts that may be labelled otherwise; voters that cover a text.
LEAST_TEXTS, MOST_OTHER, COVERED = 3, 0.15, 6
PREFIXES = (4, 5, 6)
PATTERNS, FOLDS = 4, 3

def units(words: Words) -> list[np.ndarray]:
    """Hashes of each word, and of its beginnings that are shorter than it (else of the word)."""
    beginnings = [words.span_hash(words.start, np.minimum(words.start + k, words.end)) for k in PREFIXES]
    return [words.hash, *(h ^ np.uint64(k) for k, h in zip(PREFIXES, beginnings, strict=True))]


def patterns(texts: list[str]) -> np.ndarray:
    """Votes of the pattern voters: much in capitals, exclamation marks, stretched letters, odd characters within words."""
    out = np.zeros((len(texts), PATTERNS), np.float32)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
        if not len(raw):
            continue
        capitals, small = ((raw >= 65) & (raw <= 90)).sum(), ((raw >= 97) & (raw <= 122)).sum()
        out[i, 0] = capitals > 0.5 * (capitals + small) and capitals > 10
        out[i, 1] = (raw == 33).sum() * 50 > len(raw)
        same = (raw[1:] == raw[:-1]) & (raw[1:] > 64)
        out[i, 2] = (same[3:] & same[2:-1] & same[1:-2] & same[:-3]).any() if len(same) > 3 else False
        out[i, 3] = ((raw == 36) | (raw == 42) | (raw == 64)).sum() * 50 > len(raw)
    return out


class Voters:
    """Lexicons by the hashes of their units. hashes: of units; columns: the voter that each makes fire; n: voters."""

    def __init__(self, hashes: np.ndarray, columns: np.ndarray, n: int):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.columns, self.n = hashes[order], columns[order], n
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(hashes >> np.uint64(48)).astype(np.int64)] = True

    @staticmethod
    def of(learnt: np.ndarray, voting: np.ndarray | None = None) -> Voters:
        """A voter for each learnt unit, of which only those of `voting` ever fire."""
        voting = np.ones(len(learnt), bool) if voting is None else voting
        return Voters(learnt[voting], np.flatnonzero(voting), len(learnt))

    def fired(self, words: Words, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each document the voters that fire, and how many of its words fire any."""
        fired, hit = np.zeros((n_docs, self.n), np.float32), np.zeros(len(words), bool)
        for h in units(words):
            some = np.flatnonzero(self.seen[(h >> np.uint64(48)).astype(np.int64)])
            first, last = (np.searchsorted(self.hashes, h[some], side) for side in ("left", "right"))
            for k in range(int((last - first).max(initial=0))):  # a word of several lexicons
                good = first + k < last
                fired[words.doc[some[good]], self.columns[first[good] + k]] = 1
                hit[some[good]] = True
        return fired, common.group_sums(hit, words.first)


def features(voters: Voters, texts: pa.Array) -> np.ndarray:
    """Votes, pattern votes, and the share and number of words that fire."""
    words = Words(texts, ALNUM)
    fired, hits = voters.fired(words, len(texts))
    n = np.maximum(1, np.diff(words.first))
    return np.hstack([fired, patterns(texts.to_pylist()), np.sqrt(hits / n)[:, None], np.log1p(hits)[:, None]]).astype(np.float32)


def count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, fold, texts labelled toxic, other texts) of each slice."""
    for batch in batches:
        for a, b in common.slices(batch.column(0)):
            words = Words(batch.column(0).slice(a, b - a), ALNUM)
            label, fold = (np.array(batch.column(k).slice(a, b - a).to_pylist(), np.int64) for k in (1, 2))
            unit = np.concatenate(units(words))
            order = np.argsort(unit, kind="stable")
            unit, doc = unit[order], np.tile(words.doc, 1 + len(PREFIXES))[order]
            order = np.lexsort((doc, fold[doc], unit))
            unit, doc = unit[order], doc[order]
            new = np.append(True, (unit[1:] != unit[:-1]) | (doc[1:] != doc[:-1])) if len(unit) else np.zeros(0, bool)
            unit, doc = unit[new], doc[new]
            head = np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]) | (fold[doc[1:]] != fold[doc[:-1]]))) if len(unit) else np.zeros(0, int)
            toxic = np.add.reduceat(label[doc], head) if len(head) else head
            other = np.diff(np.append(head, len(unit))) - toxic
            yield pa.RecordBatch.from_arrays([pa.array(unit[head].astype(np.int64)), pa.array(fold[doc[head]].astype(np.int32)), pa.array(toxic), pa.array(other)], ["unit", "fold", "toxic", "other"])


def label_model(votes: np.ndarray, label: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Posterior probability that each text is toxic, given its votes and its label. A voter that doesn't fire abstains; that none fires is evidence too."""
    none = votes.max(1) == 0
    posterior = 0.05 + 0.6 * (label == 1) + 0.3 * ~none
    for _ in range(rounds):
        n1, n0 = posterior.sum() + 2, (1 - posterior).sum() + 2
        p1, p0 = (posterior @ votes + 0.5) / n1, ((1 - posterior) @ votes + 0.5) / n0
        # correlations within either class: a voter shares its evidence with those that fire with it
        together = np.zeros((votes.shape[1],) * 2)
        for q, p, n in ((posterior, p1, n1), (1 - posterior, p0, n0)):
            spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
            together += 0.5 * ((votes * q[:, None]).T @ votes / n - np.outer(p, p)) / np.outer(spread, spread)
        np.fill_diagonal(together, 0)
        weight = 1 / (1 + np.clip(together, 0, 1).sum(1))
        right = np.clip([(posterior @ (label == 1) + 1) / n1, ((1 - posterior) @ (label == 0) + 1) / n0], 0.55, 0.99)
        odds = np.log(n1 / n0) + np.where(label == 1, np.log(right[0] / (1 - right[1])), np.log((1 - right[0]) / right[1]))
        odds = odds + votes @ (weight * np.log(p1 / p0))
        odds = odds + none * np.log((posterior @ none + 0.5) / n1 * n0 / ((1 - posterior) @ none + 0.5))
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return posterior


def regression(x: np.ndarray, target: np.ndarray, ridge: float = 2e-4, rounds: int = 40) -> np.ndarray:
    """Weights and, last, the intercept: logistic regression on soft labels by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(x))
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (target - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        x = features(self.voters, texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def pick_voters(fired: np.ndarray, label: np.ndarray) -> list[int]:
    """Greedy cover of the toxic texts: each time the unit with most texts that fewer than COVERED voters cover, less those labelled otherwise."""
    picked: list[int] = []
    toxic, other = fired[label == 1], fired[label == 0].sum(0)
    need = np.full(len(toxic), COVERED)
    while len(picked) < MOST_VOTERS and len(toxic):
        gain = (need > 0).astype(np.float32) @ toxic - 3 * other
        gain[picked] = -1
        best = int(gain.argmax())
        if gain[best] < LEAST_TEXTS:
            break
        picked.append(best)
        need -= toxic[:, best].astype(int)
    return picked


def fit(docs: DataFrame, labels: DataFrame, remainder: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from labelled rows whose id isn't held out; at most SAMPLE_ROWS of them, by a hash of the id."""
    common.small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~common.held_out(remainder, id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(SAMPLE_ROWS)
    texts = docs.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text")).join(F.broadcast(known), "id")
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")
    sample = common.materialise(texts.dropDuplicates(["text", "label"]).select("text", "label", fold))
    totals = dict(sample.groupBy("label").count().collect())
    if not totals.get(0) or not totals.get(1):
        share = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
        none = Voters.of(np.zeros(0, np.uint64))
        return Model(none, np.append(np.zeros(none.n + PATTERNS + 2), np.log(share / (1 - share))))
    counts = sample.mapInArrow(count_units, "unit long, fold int, toxic long, other long").groupBy("unit")
    own = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}_{k}") for c in ("toxic", "other") for k in range(FOLDS)]
    counts = counts.agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), *own)
    marks = counts.where((F.col("toxic") >= LEAST_TEXTS) & (F.col("other") <= MOST_OTHER * (F.col("toxic") + F.col("other"))))
    best = marks.orderBy(F.desc(F.col("toxic") - 3 * F.col("other")), "unit").limit(CANDIDATES).collect()
    units_ = np.array([r.unit for r in best], np.int64).astype(np.uint64)
    candidates = Voters(units_, np.arange(len(units_)), len(units_))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in common.slices(batch.column(0)):
                fired, _ = candidates.fired(Words(batch.column(0).slice(a, b - a), ALNUM), b - a)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array([np.flatnonzero(row).tolist() for row in fired], pa.list_(pa.int32()))], ["label", "fired"])

    rows = sample.mapInArrow(votes, "label int, fired array<int>").collect()  # at most SAMPLE_ROWS, as below
    label = np.array([r.label for r in rows])
    fired = np.zeros((len(rows), len(units_)), np.float32)
    for i, r in enumerate(rows):
        fired[i, r.fired] = 1
    picked = pick_voters(fired, label)
    learnt = units_[picked]
    # a unit votes on a fold's texts if it marks toxic texts in the other folds
    toxic, other = (np.array([[r[c] - r[f"{c}_{k}"] for k in range(FOLDS)] for r in best], np.int64).reshape(-1, FOLDS)[picked] for c in ("toxic", "other"))
    marking = (toxic >= LEAST_TEXTS / 2) & (other <= MOST_OTHER * (toxic + other))
    of_fold = [Voters.of(learnt, marking[:, k]) for k in range(FOLDS)]

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in common.slices(batch.column(0)):
                text, fold = batch.column(0).slice(a, b - a), np.array(batch.column(2).slice(a, b - a).to_pylist())
                x = np.stack([features(v, text) for v in of_fold])[fold, np.arange(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(x.tolist(), pa.list_(pa.float32()))], ["label", "x"])

    rows = sample.mapInArrow(described, "label int, x array<float>").collect()
    label, x = np.array([r.label for r in rows]), np.array([r.x for r in rows], np.float32)
    order = np.lexsort((label, *x.T))  # the same sums whatever the order of the rows
    label, x = label[order], x[order]
    posterior = label_model(x[:, :-2].astype(np.float64), label)
    return Model(Voters.of(learnt), regression(x, posterior))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each document, from its whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in common.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.score(batch.column(1).slice(a, b - a)), pa.float64())], [id_col, "score"])

    return docs.select(id_col, common.text_of(text_col).alias("text")).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, score double")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score under the threshold, unchanged, with all their columns."""

    rows, at = common.with_text(docs, text_col)
    n_columns = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rest = common.filled(batch.column(at)), batch.select(range(n_columns))
            for a, b in common.slices(texts):
                yield rest.slice(a, b - a).filter(pa.array(model.score(texts.slice(a, b - a)) < threshold))

    return rows.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    scored = score(docs, fit(docs, common.documents(spark, sf_dir, "labels")))
    return scored.select("doc_id", common.held_out(0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
