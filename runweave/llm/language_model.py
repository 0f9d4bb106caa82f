"""LM scoring with a hashed maximum-entropy model: P(word | context) = P(class | context) P(slot | class, context) P(word | slot).

Every word has a slot of a class. The most frequent words have a slot each, dealt by rank over head classes. All
others, known or not, share slots by their last bytes: buckets of endings with like contexts (counted over all
training texts) form a tail class, in which neighbouring buckets make a slot. Two hashed softmax layers have
features of the n-gram and skip kind: one over the classes (the slots of the words one, two and three before, and the
hashed pair before), one over the slots of a class (the slot before and the class two before, each with the class),
so context reaches every word. Within a shared slot a word has its
smoothed share, (c + 0.5) / (n + 0.5 (v + 1)); the last term is that of all words never seen. So the model is a
distribution, and its score comparable to that of the base.

Training goes once over all training texts, in rounds: each round's tasks sum what each hashed feature saw and
what the model expected there (the gradient), the sums meet block by block in a tree whose depth follows the number
of tasks, in a fixed order and in double precision, and the driver moves the weights, scaled for each feature as in
iterative scaling. Tables have fixed sizes, so what is broadcast is bounded: of the counts only the most common
words go to the tasks. Occurrences of the others join the counts in Spark.

Null and empty texts consist of their end token. Repeated rows are scored each; columns other than id and text are
left out. Without training texts all words are unknown. Of an empty table nothing is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import NON_SPACE, Words

#: Head classes, slots of a class, tail classes; hashed rows of the pair, and of the slot before with the class; rounds; most words whose counts are broadcast.
HEADS, WIDTH, TAILS, ROWS, SLOT_ROWS, ROUNDS, MOST_COMMON = 16, 32, 16, 2_048, 8_192, 2, 400_000
#: Buckets of word endings, and of the endings before them that describe them.
BUCKETS, BEFORE = 1_024, 64
#: Step of an update, and the pull towards no change in occurrences, for the classes and for the slots.
STEPS, PULLS = (0.35, 0.6), (30.0, 10.0)
CLASSES = HEADS + TAILS
#: Places of words, and a coarser code of them: eight neighbouring shared slots are one.
PLACES, CODES = CLASSES * WIDTH, HEADS * WIDTH + TAILS * WIDTH // 8
#: Tokens of one step, whose arrays stay in a core's cache.
STRIDE = 8_192
BLOCKS, FAN_IN = 32, 16

END, START = (common.mix(np.array([x], np.uint64))[0] for x in (0xE0D, 0x57A7))
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


@dataclass
class Tokens:
    """Words and ends of some texts, one after another."""

    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    bucket: np.ndarray

    @staticmethod
    def of(texts: pa.Array) -> Tokens:
        words, n_docs = Words(texts, NON_SPACE), len(texts)
        n = len(words) + n_docs
        place = np.arange(len(words)) + words.doc
        first = words.first + np.arange(n_docs + 1)
        h, doc, bucket = np.full(n, END, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        h[place] = words.hash
        doc[place], doc[first[1:] - 1] = words.doc, np.arange(n_docs)
        ending = words.span_hash(np.maximum(words.end - 3, words.start), words.end)
        bucket[place] = (ending >> np.uint64(32)).astype(np.int64) % BUCKETS
        return Tokens(h, doc, first, bucket)

    def back(self, k: int, values: np.ndarray, start: int) -> np.ndarray:
        """The value of the token k before each, or the start mark."""
        out = np.full(len(self.hash), start, values.dtype)
        out[k:] = values[:-k]
        for j in range(k):
            at = self.first[:-1] + j
            out[at[at < self.first[1:]]] = start
        return out


def contexts(t: Tokens, place: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of the features of each token, of the class layer and of the slot layer."""
    code = np.where(place < HEADS * WIDTH, place, HEADS * WIDTH + (place - HEADS * WIDTH) // 8)
    before = [t.back(k, place, PLACES) for k in (1, 2, 3)]
    pair = common.mix(t.back(1, t.hash, START) * _SALT[2] + t.back(2, t.hash, START) * _SALT[3])
    of_class = [x + k * (PLACES + 1) for k, x in enumerate(before)]
    of_class.append((pair >> np.uint64(40)).astype(np.int64) % ROWS + 3 * (PLACES + 1))
    kind = place // WIDTH
    with_class = common.mix((t.back(1, code, CODES) * CLASSES + kind).astype(np.uint64) * _SALT[0])
    two_before = np.where(before[1] < PLACES, before[1] // WIDTH, CLASSES)
    return of_class, [(with_class >> np.uint64(40)).astype(np.int64) % SLOT_ROWS, SLOT_ROWS + two_before * CLASSES + kind]


def softmax(bias: np.ndarray, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Probabilities, a row for each token. bias: for all, or a row for each."""
    z = weights[rows[0]]
    for r in rows[1:]:
        z += weights[r]
    z += bias
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def add_expected(out: np.ndarray, p: np.ndarray, rows: np.ndarray) -> None:
    """Adds the probabilities of each token to the row of its feature."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    ranked = rows[order]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    out[ranked[heads]] += np.add.reduceat(p[order], heads, axis=0)


@dataclass
class Model:
    """What the tasks need.

    known, count: the most common words; own: the place of those with a slot of their own, else -1; shared: the place
    of each bucket; slot_total: smoothed counts of the places; biases: log shares of classes, and of slots in their class.
    """

    known: np.ndarray
    count: np.ndarray
    own: np.ndarray
    shared: np.ndarray
    slot_total: np.ndarray
    class_bias: np.ndarray
    slot_bias: np.ndarray
    total: float
    classes: np.ndarray = field(default_factory=lambda: np.zeros((3 * (PLACES + 1) + ROWS, CLASSES), np.float32))
    slots: np.ndarray = field(default_factory=lambda: np.zeros((SLOT_ROWS + (CLASSES + 1) * CLASSES, WIDTH), np.float32))

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Places among the known words, else -1."""
        if not len(self.known):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, at, -1)

    def prepared(self, t: Tokens):
        """Places among the known words, whether the slot is a word's own, places, and rows of the features of either layer."""
        at = self.look_up(t.hash)
        own = np.where(at >= 0, self.own[at] if len(self.own) else -1, -1)
        place = np.where(own >= 0, own, self.shared[t.bucket])
        return at, own >= 0, place, *contexts(t, place)

    def zeros(self) -> list[np.ndarray]:
        """What was seen and what was expected, for either layer."""
        return [np.zeros(w.shape) for w in (self.classes, self.classes, self.slots, self.slots)]

    def add_sums(self, out: list[np.ndarray], t: Tokens) -> None:
        _, _, place, rows, slot_rows = self.prepared(t)
        kind = place // WIDTH
        layers = ((self.class_bias, self.classes, rows, kind), (self.slot_bias[kind], self.slots, slot_rows, place % WIDTH))
        for k, (bias, weights, own, target) in enumerate(layers):
            seen, model = out[2 * k : 2 * k + 2]
            for r in own:
                seen += np.bincount(r * weights.shape[1] + target, minlength=weights.size).reshape(weights.shape)
            for i in range(0, len(target), STRIDE):
                part = [r[i : i + STRIDE] for r in own]
                p = softmax(bias if bias.ndim == 1 else bias[i : i + STRIDE], weights, part)
                for r in part:
                    add_expected(model, p, r)

    @staticmethod
    def logs(bias: np.ndarray, weights: np.ndarray, rows: list[np.ndarray], target: np.ndarray) -> np.ndarray:
        """log10 of the probability of each target."""
        out = np.empty(len(target))
        for i in range(0, len(target), STRIDE):
            p = softmax(bias if bias.ndim == 1 else bias[i : i + STRIDE], weights, [r[i : i + STRIDE] for r in rows])
            out[i : i + STRIDE] = p[np.arange(len(p)), target[i : i + STRIDE]]
        return np.log10(out + 1e-30)

    def score(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the base score and the score, both without the counts of words that aren't known, and these words' places."""
        at, alone, place, rows, slot_rows = self.prepared(t)
        kind = place // WIDTH
        out = self.logs(self.class_bias, self.classes, rows, kind) + self.logs(self.slot_bias[kind], self.slots, slot_rows, place % WIDTH)
        known = np.where(at >= 0, np.log10(self.count[at] + 0.5) if len(self.count) else 0.0, 0.0)
        out[~alone] += known[~alone] - np.log10(self.slot_total[place[~alone]])
        base = known - np.log10(self.total)
        return common.group_sums(base, t.first), common.group_sums(out, t.first), np.flatnonzero(at < 0)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    pairs = np.zeros(BUCKETS * BEFORE, np.int64)

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, bucket, n = (np.concatenate(x) for x in zip(*held, strict=True))
        word, at, back = np.unique(h, return_index=True, return_inverse=True)
        return word, bucket[at], np.bincount(back, n).astype(np.int64)

    def out(word: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bucket.astype(np.int32)), pa.array(n)], ["word", "bucket", "n"])

    for batch in batches:
        for a, b in common.slices(batch.column(0)):
            t = Tokens.of(batch.column(0).slice(a, b - a))
            word, at, n = np.unique(t.hash, return_index=True, return_counts=True)
            held.append((word, t.bucket[at].astype(np.int16), n))
            inner = np.flatnonzero(t.doc[1:] == t.doc[:-1])
            pairs += np.bincount(t.bucket[inner + 1] * BEFORE + t.bucket[inner] % BEFORE, minlength=len(pairs))
            if sum(len(x[0]) for x in held) > 1_000_000:
                held = [merged()]
                if len(held[0][0]) > 500_000:
                    yield out(*held[0])
                    held = []
    if held:
        yield out(*merged())
        held = []
    common.release()
    cells = np.flatnonzero(pairs)
    yield out(cells, np.full(len(cells), -1), pairs[cells])


def count_words(texts: DataFrame) -> DataFrame:
    """(word, bucket, n) of every word of the texts and of their ends; with bucket -1, of each pair of buckets that follow each other."""
    return texts.mapInArrow(_count_words, "word long, bucket int, n long").groupBy("word", "bucket").agg(F.sum("n").alias("n"))


def shared_slots(pairs: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """The slot, of TAILS * WIDTH, of each bucket: classes are clusters of like contexts, slots are neighbours in them of like mass.

    pairs: (BUCKETS, BEFORE) counts. Buckets are described by how far their contexts depart from chance.
    """
    expected = (pairs.sum(1, keepdims=True) + 1) * (pairs.sum(0, keepdims=True) + 1) / (pairs.sum() + 1)
    x = (pairs - expected) / np.sqrt(expected)
    x /= np.sqrt(pairs.sum(1, keepdims=True) + 100)  # rare buckets say little
    u, size, _ = np.linalg.svd(x, full_matrices=False)
    sign = np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
    x = (u * sign * size)[:, :8]
    weight = mass + 1.0
    centres = [int(weight.argmax())]
    far = np.full(len(x), np.inf)
    for _ in range(TAILS - 1):  # the farthest mass each time
        far = np.minimum(far, ((x - x[centres[-1]]) ** 2).sum(1))
        centres.append(int((far * weight).argmax()))
    centre = x[centres]
    for _ in range(30):
        kind = ((x[:, None] - centre) ** 2).sum(2).argmin(1)
        for k in range(TAILS):
            own = kind == k
            if own.any():
                centre[k] = (x[own] * weight[own, None]).sum(0) / weight[own].sum()
    slot = np.zeros(len(x), np.int64)
    for k in range(TAILS):
        own = np.flatnonzero(kind == k)
        own = own[np.argsort(x[own, k % x.shape[1]] if len(own) else own, kind="stable")]
        upto = np.cumsum(weight[own])
        slot[own] = k * WIDTH + np.minimum(WIDTH - 1, ((upto - weight[own] / 2) / max(upto[-1] if len(own) else 1, 1e-9) * WIDTH).astype(np.int64))
    return slot


def untrained(counts: DataFrame) -> tuple[Model, int]:
    """The model without weights, and the least count of the words that it knows."""
    words = counts.where("bucket >= 0")
    level = F.floor(F.log2("n")).cast("int").alias("level")
    least, held = 0, 0
    for row in words.groupBy(level).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect():  # at most 64 rows
        held += row.words
        if held > MOST_COMMON:
            least = 2 ** (row.level + 1)
            break
    common_words = words.where(F.col("n") >= least).toPandas()
    word = common_words["word"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(word)
    word, count, bucket = word[order], common_words["n"].to_numpy(np.float64)[order], common_words["bucket"].to_numpy(np.int64)[order]
    ranked = np.lexsort((word, -count))[: HEADS * WIDTH]
    own = np.full(len(word), -1)
    own[ranked] = np.arange(len(ranked))
    sums = words.groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toPandas().set_index("bucket").reindex(range(BUCKETS), fill_value=0)
    total, distinct = float(sums["n"].sum()), float(sums["v"].sum())
    bucket_n = sums["n"].to_numpy(np.float64) - np.bincount(bucket[ranked], count[ranked], BUCKETS)
    bucket_v = sums["v"].to_numpy(np.float64) - np.bincount(bucket[ranked], minlength=BUCKETS)
    cells = counts.where("bucket = -1").toPandas()  # at most BUCKETS * BEFORE
    pairs = np.bincount(cells["word"].to_numpy(np.int64), cells["n"].to_numpy(np.float64), BUCKETS * BEFORE).reshape(BUCKETS, BEFORE)
    slot = shared_slots(pairs, bucket_n)
    n_slots = TAILS * WIDTH
    slot_total = np.bincount(slot, bucket_n, n_slots) + 0.5 * (np.bincount(slot, bucket_v, n_slots) + 1)
    head_count = np.zeros(HEADS * WIDTH)
    head_count[: len(ranked)] = count[ranked]
    mass = np.concatenate([head_count, slot_total]).reshape(CLASSES, WIDTH)
    class_bias = np.log(np.maximum(mass.sum(1), 1e-20) / mass.sum())
    slot_bias = np.where(mass > 0, np.log(np.maximum(mass, 1e-20)), -60.0)
    bias = (class_bias.astype(np.float32), (slot_bias - slot_bias.max(1, keepdims=True)).astype(np.float32))
    return Model(word, count, own, HEADS * WIDTH + slot, np.concatenate([head_count, slot_total]), *bias, total + 0.5 * (distinct + 1)), least


def _gradient(broadcast):
    def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, total = broadcast.value, None
        for batch in batches:
            for a, b in common.slices(batch.column(0)):
                total = total or model.zeros()
                model.add_sums(total, Tokens.of(batch.column(0).slice(a, b - a)))
        if total is not None:
            flat = np.array_split(np.concatenate([x.ravel() for x in total]).astype(np.float32), BLOCKS)
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([part] * BLOCKS, pa.int32()), pa.array([x.tobytes() for x in flat], pa.binary())], ["block", "part", "sums"])

    return gradient


def _add(last: bool):
    def add(frame: pd.DataFrame) -> pd.DataFrame:
        """Sums of the parts of a group, in their order; single precision on the way, as sums of tasks are."""
        frame = frame.sort_values("part")
        total = np.zeros(len(frame["sums"].iloc[0]) // 4)
        for sums in frame["sums"]:
            total += np.frombuffer(sums, np.float32)
        return pd.DataFrame({"block": frame["block"].iloc[:1], "part": frame["part"].iloc[:1] // FAN_IN, "sums": [(total if last else total.astype(np.float32)).tobytes()]})

    return add


def train(texts: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """One pass over all texts, a part of them (by hash) in each round."""
    spark = texts.sparkSession
    schema = "block int, part int, sums binary"
    tasks = texts.rdd.getNumPartitions()
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        own = texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k)
        sums, parts = own.mapInArrow(_gradient(shared), schema), tasks
        while parts > FAN_IN:
            sums = sums.groupBy("block", F.floor(F.col("part") / FAN_IN).alias("group")).applyInPandas(lambda key, frame: _add(False)(frame), schema)
            parts = -(-parts // FAN_IN)
        sums = sums.groupBy("block").applyInPandas(_add(True), schema)
        blocks = sorted(sums.collect(), key=lambda r: r.block)  # of a fixed size
        if blocks:
            flat = np.concatenate([np.frombuffer(r.sums, np.float64) for r in blocks])
            at = 0
            for table, bias, step, pull in zip((model.classes, model.slots), (model.class_bias, None), STEPS, PULLS, strict=True):
                seen, wanted = (flat[at + i * table.size : at + (i + 1) * table.size].reshape(table.shape) for i in (0, 1))
                at += 2 * table.size
                prior = np.exp(bias) if bias is not None else 1 / table.shape[1]
                table += (step * np.log((seen + pull * prior) / (wanted + pull * prior))).astype(np.float32)
        shared.unpersist()
    return model


def score(docs: DataFrame, model: Model, counts: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in common.slices(batch.column(1)):
                t = Tokens.of(batch.column(1).slice(a, b - a))
                base, own, rare = shared.value.score(t)
                n = np.diff(t.first)
                each = np.bincount(t.doc[rare], minlength=b - a)
                words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32)), pa.array(t.hash[rare].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(n - each), pa.array(base), pa.array(own), words], ["id", "n_tokens", "n_known", "base_score", "score", "rare"])

    partly = docs.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double, rare array<long>")
    partly = common.materialise(partly.withColumn("row", F.monotonically_increasing_id()))
    rare = common.materialise(partly.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times")))
    seen = counts.where((F.col("bucket") >= 0) & (F.col("n") < least)) if least else counts.limit(0)
    asked = rare.groupBy(F.col("word").alias("asked")).agg(F.count(F.lit(1)).alias("rows"))
    asked = common.materialise(asked.join(seen, F.col("asked") == F.col("word"), "left").select("asked", "rows", F.coalesce("n", F.lit(0)).alias("n")))
    n = F.col("n")
    more = common.join_keys(rare, asked, "word", "asked", "rows", "inner").groupBy("row").agg(F.sum(F.col("times") * F.log10(n + 0.5)).alias("logs"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("seen")).withColumnRenamed("row", "r")
    out, logs = partly.join(more, F.col("row") == F.col("r"), "left"), F.coalesce("logs", F.lit(0.0))
    return out.select(F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))


def fit(docs: DataFrame, held: Column, text_col: str = "text") -> tuple[Model, DataFrame, int, int]:
    """The model, the counts of all words, the least count that the model knows, and the number of training tokens."""
    texts = docs.where(~held).select(common.text_of(text_col).alias("text"))
    counts = common.materialise(count_words(texts))
    model, least = untrained(counts)
    tokens = counts.where("bucket >= 0").agg(F.sum("n")).first()[0] or 0
    return train(texts, model), counts, least, tokens


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = common.documents(spark, sf_dir), common.held_out(1)
    model, counts, least, tokens = fit(docs, held)
    scored = score(docs, model, counts, least)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
