"""Benchmark decontamination with an FM-index per shard of the documents.

Each slice of an Arrow batch is a shard. Its words that occur in the benchmark form runs; a compressed
text of these runs gets a suffix array, a Burrows-Wheeler transform in a wavelet matrix, and sampled suffix
positions. All benchmark windows are searched backwards at once; occurrences are located by walking to a
sampled position, and overlapping ones merge into removal spans. Nothing is shuffled where the benchmark is one
block. A larger one is searched block after block, each fetched, sent to the tasks and let go alone; what each
finds is written by file and place of the row, and only these finds meet by a shuffle.

Null and empty texts have no words and no spans. Items without words or without an id are never found.
Repeated rows are each searched. Extra columns are left out by `find_spans`, kept by `drop_contaminated`,
whatever their names. Empty tables give empty results, an empty benchmark contaminates nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import ALNUM, Words

WINDOW = 13
SHARD_BYTES = 1 << 20
SAMPLE_RATE = 16
#: Benchmark text, in bytes, that a block holds (or one item); a larger benchmark is searched in blocks.
BLOCK_BYTES = 8 << 20

#: Bits that tell which pairs of neighbouring words a shard has; windows with other pairs aren't searched in it.
PAIR_CELLS = 1 << 22

SPANS = "spans array<struct<first_word:long,last_word:long,start:long,end:long>>, items array<string>"


class Phrases:
    """Windows of a block of benchmark items, over the ids 1, 2, ... of their words.

    sets: for each length the distinct windows, and of window p the items, which are owners[begin[p]:begin[p + 1]];
    last, cells of some of its pairs of neighbouring words.
    """

    def __init__(self, rows: list[tuple[str | None, str]], window: int):
        words = Words(pa.array([text for _, text in rows], pa.string()), ALNUM)
        self.vocabulary, symbols = np.unique(words.hash, return_inverse=True)
        symbols = (symbols + 1).astype(np.int32)
        self.items = np.array([item for item, _ in rows], object)
        sizes = np.minimum(np.diff(words.first), window)
        self.sets = []
        for n in np.unique(sizes[sizes > 0]).tolist():
            own = np.flatnonzero(sizes == n)
            counts = words.first[own + 1] - words.first[own] - n + 1
            item = np.repeat(own, counts)
            start = np.arange(counts.sum()) + np.repeat(words.first[own] - np.cumsum(counts) + counts, counts)
            matrix = symbols[start[:, None] + np.arange(n)]
            _, at, phrase = np.unique(matrix.view(np.dtype((np.void, 4 * n))).ravel(), return_index=True, return_inverse=True)
            pairs = np.unique(phrase.astype(np.int64) * len(rows) + item)
            begin = np.searchsorted(pairs // len(rows), np.arange(len(at) + 1))
            matrix = matrix[at]
            told = [neighbours(matrix[:, k], matrix[:, k + 1]) for k in sorted({0, (n - 1) // 2, n - 2})] if n > 1 else []
            self.sets.append((n, matrix, begin, pairs % len(rows), told))
        self.shortest = min((n for n, *_ in self.sets), default=0)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def neighbours(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A cell of PAIR_CELLS for each pair of neighbouring words."""
    return common.mix(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) % np.uint64(PAIR_CELLS)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; every 0 is a symbol of its own, in order of place."""
    n, zero = len(text), text == 0
    keys = np.where(zero, np.cumsum(zero) - 1, text + zero.sum())
    order = np.argsort(keys, kind="stable")
    placed = keys[order]
    heads = np.concatenate([[True], placed[1:] != placed[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    step = 1
    while not heads.all():
        tied = np.flatnonzero(~heads | ~np.append(heads[1:], True))  # places in groups of more than one
        own = order[tied]
        after = rank[np.minimum(own + step, n)]
        new = np.lexsort((after, rank[own]))
        own, after, old = own[new], after[new], rank[own[new]]
        order[tied] = own
        heads[tied] = np.concatenate([[True], (old[1:] != old[:-1]) | (after[1:] != after[:-1])])
        rank[own] = np.maximum.accumulate(np.where(heads[tied], tied, 0))
        step *= 2
    return order


class FMIndex:
    """Backward search and locate over a text of symbols; 0 separates and is never searched."""

    def __init__(self, text: np.ndarray, symbols: int, rate: int = SAMPLE_RATE):
        order = suffix_array(text)
        self.last = text[order - 1]  # the first suffix wraps round to the closing 0
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.levels = []
        level = self.last
        for bit in reversed(range(max(1, int(symbols).bit_length()))):
            ones = (level >> bit) & 1
            ranks = np.concatenate([[0], np.cumsum(ones)])
            self.levels.append((bit, ranks, len(level) - int(ranks[-1])))
            level = np.concatenate([level[ones == 0], level[ones == 1]])
        starts = np.concatenate([[True], text[:-1] == 0])
        self.sampled = (order % rate == 0) | starts[order]
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        low = np.zeros_like(row)
        for bit, ranks, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            row = np.where(one, zeros + ranks[row], row - ranks[row])
            low = np.where(one, zeros + ranks[low], low - ranks[low])
        return row - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (numbers) that occur, with the rows [low, high) of their occurrences."""
        found = np.arange(len(phrases))
        c = phrases[:, -1]
        low, high = self.before[c], self.before[c + 1]
        for k in reversed(range(phrases.shape[1] - 1)):
            some = low < high
            found, low, high = found[some], low[some], high[some]
            if not len(found):
                break
            c = phrases[found, k]
            low, high = self.before[c] + self.rank(c, low), self.before[c] + self.rank(c, high)
        some = low < high
        return found[some], low[some], high[some]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes in these rows."""
        out, steps, left, rows = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(left):
            done = self.sampled[rows]
            out[left[done]] = self.samples[self.sample_rank[rows[done]]] + steps
            left, rows = left[~done], rows[~done]
            c = self.last[rows]
            rows = self.before[c] + self.rank(c, rows)
            steps += 1
        return out


def occurrences(words: Words, phrases: Phrases) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first word of each occurrence, words in it, number of its phrase, begin and owners as in Phrases) by length of phrase."""
    if not phrases.sets or not len(words):
        return
    symbols = phrases.symbols(words.hash)
    cut = np.concatenate([[True], (words.doc[1:] != words.doc[:-1]) | (symbols[1:] == 0) | (symbols[:-1] == 0)])
    heads = np.flatnonzero(cut)
    sizes = np.diff(np.append(heads, len(symbols)))
    long = (symbols[heads] > 0) & (sizes >= phrases.shortest)
    heads, sizes = heads[long], sizes[long]
    if not len(heads):
        return
    # a run after another, each closed by a 0
    places = np.repeat(heads - np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]), sizes + 1) + np.arange((sizes + 1).sum())
    text = symbols[np.minimum(places, len(symbols) - 1)]
    text[np.cumsum(sizes + 1) - 1] = 0
    index = FMIndex(text, len(phrases.vocabulary))
    pairs = np.zeros(PAIR_CELLS, bool)
    pairs[neighbours(text[:-1], text[1:])] = True
    for n, matrix, begin, owners, told in phrases.sets:
        some = np.arange(len(matrix))
        for cells in told:  # most windows have a pair of words that the shard hasn't
            some = some[pairs[cells[some]]]
        found, low, high = index.search(matrix[some])
        found = some[found]
        if len(found):
            counts = high - low
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            yield places[index.locate(rows)], n, np.repeat(found, counts), begin, owners


def find(words: Words, phrases: Phrases, n_docs: int) -> tuple[list, list]:
    """Spans and items of each document."""
    delta = np.zeros(len(words) + 1, np.int64)
    names: list[list[str]] = [[] for _ in range(n_docs)]
    pairs = []
    for first, n, phrase, begin, owners in occurrences(words, phrases):
        np.add.at(delta, first, 1)
        np.add.at(delta, first + n, -1)
        seen = np.unique(np.stack([words.doc[first], phrase], 1), axis=0)
        counts = begin[seen[:, 1] + 1] - begin[seen[:, 1]]
        item = owners[np.arange(counts.sum()) + np.repeat(begin[seen[:, 1]] - np.cumsum(counts) + counts, counts)]
        pairs.append(np.stack([np.repeat(seen[:, 0], counts), item], 1))
    for doc, item in np.unique(np.concatenate(pairs), axis=0).tolist() if pairs else ():
        if phrases.items[item] is not None:
            names[doc].append(phrases.items[item])
    hit = np.cumsum(delta[:-1]) > 0
    border = np.concatenate([[True], words.doc[1:] != words.doc[:-1]]) if len(words) else np.zeros(0, bool)
    heads = np.flatnonzero(hit & (border | ~np.concatenate([[False], hit[:-1]]))) if len(words) else np.zeros(0, int)
    tails = np.flatnonzero(hit & (np.append(border[1:], True) | ~np.append(hit[1:], False))) if len(words) else heads
    out: list[list[dict]] = [[] for _ in range(n_docs)]
    for h, t in zip(heads.tolist(), tails.tolist(), strict=True):
        doc = int(words.doc[h])
        base, at = int(words.first[doc]), int(words.at[doc])
        out[doc].append({"first_word": h - base, "last_word": t - base, "start": int(words.start[h]) - at, "end": int(words.end[t]) - at})
    return out, [sorted(set(x)) for x in names]


def _searcher(phrases: Phrases, every: bool, names: list[str]):
    """The columns before the text, which is the last one, with n_words, spans and items: of every document, or of those with a span."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in common.slices(texts, SHARD_BYTES):
                words = Words(texts.slice(a, b - a), ALNUM)
                spans, items = find(words, phrases, b - a)
                new = [pa.array(np.diff(words.first)), pa.array(spans, _SPAN_TYPE), pa.array(items, pa.list_(pa.string()))]
                out = pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], *new], [*names, "n_words", "spans", "items"])
                yield out if every else out.filter(pa.array([bool(x) for x in spans], pa.bool_()))

    return search


_SPAN_TYPE = pa.list_(pa.struct([(x, pa.int64()) for x in ("first_word", "last_word", "start", "end")]))


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> tuple[int, Iterator[Phrases]]:
    """How many blocks of about BLOCK_BYTES (or one item) the benchmark has, and the blocks, each fetched when it is asked for."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), common.text_of(text_col).alias("text")).where("text <> ''").distinct()
    n = int((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES) + 1
    return n, (Phrases([tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()], window) for k in range(n))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and items of a row from all blocks: overlapping and adjoining spans become one."""
    for batch in batches:
        spans, items = [], []
        for found in batch.column(2).to_pylist():
            out: list[dict] = []
            for s in sorted((s for f in found for s in f["spans"]), key=lambda s: (s["first_word"], s["last_word"])):
                if out and s["first_word"] <= out[-1]["last_word"] + 1:
                    if s["last_word"] > out[-1]["last_word"]:
                        out[-1] |= {"last_word": s["last_word"], "end": s["end"]}
                else:
                    out.append(dict(s))
            spans.append(out)
            items.append(sorted({i for f in found for i in f["items"]}))
        new = [batch.column(3), pa.array(spans, _SPAN_TYPE), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *new], ["file", "place", "n_words", "spans", "items"])


def _finds(docs: DataFrame, blocks: Iterator[Phrases], text_col: str) -> DataFrame:
    """(file, place, n_words, spans, items) of the rows with a span; docs is a plain read of Parquet files, of which each block makes one pass."""
    kinds, out = "file string, place long", None
    rows = docs.select(*common.address(docs), common.text_of(text_col).alias("text"))
    for phrases in blocks:
        found = common.materialise(rows.mapInArrow(_searcher(phrases, False, ["file", "place"]), f"{kinds}, n_words long, {SPANS}"))
        out = found if out is None else out.unionByName(found)
    grouped = out.groupBy("file", "place").agg(F.collect_list(F.struct("spans", "items")).alias("found"), F.first("n_words").alias("n_words"))
    grouped = common.materialise(grouped)  # of a row, one list for each block
    return grouped.select("file", "place", "found", "n_words").mapInArrow(_merged, f"{kinds}, n_words long, {SPANS}")


def find_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(id, n_words, spans, items) of each document: the merged spans of words (and of UTF-8 bytes) inside any benchmark window, and the items with a window there.

    A window is `window` consecutive words of an item; an item of fewer words is one window. Texts are whole.
    """
    kind = dict(docs.dtypes)[id_col]
    n, blocks = benchmark_blocks(benchmark, item_col, text_col, window)
    texts = docs.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"))
    if n == 1:
        found = texts.mapInArrow(_searcher(next(blocks), True, ["id"]), f"id {kind}, n_words long, {SPANS}")
    else:
        texts = common.materialise(texts)
        places = _finds(texts, blocks, "text").select(F.col("file").alias("f"), F.col("place").alias("p"), "spans", "items")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in common.slices(batch.column(3), SHARD_BYTES):
                    n_words = pa.array(np.diff(Words(batch.column(3).slice(a, b - a), ALNUM).first))
                    yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:3], n_words], ["id", "file", "place", "n_words"])

        rows = texts.select("id", *common.address(texts), "text").mapInArrow(count, f"id {kind}, file string, place long, n_words long")
        rows = rows.join(places, (F.col("file") == F.col("f")) & (F.col("place") == F.col("p")), "left")
        empty = {c: F.coalesce(c, F.array().cast(places.schema[c].dataType)).alias(c) for c in ("spans", "items")}
        found = rows.select("id", "n_words", empty["spans"], empty["items"])
    return found.withColumnRenamed("id", id_col)


def contamination(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_hit, n_items and the verdict: hit words are a twentieth of all words at least."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)
    return spans.select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, stored: bool = False) -> DataFrame:
    """The documents that are not contaminated, unchanged, with all their columns. No document is shuffled.

    stored: whether docs is a plain read of Parquet files; else it is written first where the benchmark has several blocks.
    """
    common.small_batches(docs.sparkSession)
    n, blocks = benchmark_blocks(benchmark, item_col, text_col, window)
    if n > 1:
        docs = docs if stored else common.materialise(docs)
        found = _finds(docs, blocks, text_col)
        n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)
        return common.at_places(docs, found.where(20 * n_hit >= F.col("n_words")), kept=False)
    phrases, (rows, at), n_columns = next(blocks), common.with_text(docs, text_col), len(docs.columns)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rest = common.filled(batch.column(at)), batch.select(range(n_columns))
            for a, b in common.slices(texts, SHARD_BYTES):
                words = Words(texts.slice(a, b - a), ALNUM)
                spans, _ = find(words, phrases, b - a)
                hits = np.array([sum(s["last_word"] - s["first_word"] + 1 for s in own) for own in spans])
                yield rest.slice(a, b - a).filter(pa.array((hits == 0) | (20 * hits < np.diff(words.first))))

    return rows.mapInArrow(clean, docs.schema)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(find_spans(common.documents(spark, sf_dir), common.documents(spark, sf_dir, "benchmark")))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS phrase
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS r(k) WHERE len(w) > 0
), phrases AS (
  SELECT DISTINCT n, phrase FROM windows
), places AS (
  SELECT doc_id, k, l.n, array_to_string(w[k : k + l.n - 1], ' ') AS phrase
  FROM (SELECT DISTINCT n FROM phrases) l, d, unnest(range(1, len(w) - l.n + 2)) AS r(k) WHERE len(w) >= l.n
), found AS (
  SELECT doc_id, k, n, phrase FROM places SEMI JOIN phrases USING (n, phrase)
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(k, k + n)) AS r(p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found JOIN windows USING (n, phrase) WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
