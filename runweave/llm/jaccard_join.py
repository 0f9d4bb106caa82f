"""N-gram Jaccard join: a grouped prefix join over word shingles.

A text's set holds the 64-bit hashes of its distinct shingles. Equal sets are one node. All sets are sorted in
one order: the rarer shingles come before the more common, so that passages of many documents come late. Two sets that link share a shingle of their prefixes; nodes with
an equal prefix and size form one group, and only groups are indexed and paired.

Links are found in two steps, so that a large family of near copies never becomes all its pairs: first each
group is verified against a neighbour of like size in the lists of its prefix and against the hub that most of
these lists name (if their prefixes allow a link), members against their group's first node; components follow. Then every pair of groups that
meets in a list and still has members in different components is filtered by size, place and prefix overlap,
expanded, and verified. What is not verified is connected already, so no link between different components is lost.

Lists and groups of any length are dealt over tasks: neighbours and hubs come from dealt parts of a list, whose hubs
meet the whole list's, and pairs of a long list from its parts against the whole. Rows are named by file and place, so whole texts
are never shuffled: those to verify are read again by bitmaps of their places.

Texts without words have an empty set and link with nothing; null counts as empty. Rows with a null id link like
others but are nobody's component id; a component of null ids alone has a null id. Repeated rows, of one id or
not, share a node. Extra columns are left out by `link_texts` and kept by `drop_near_copies`, whatever their
names. Empty tables stay empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import NON_SPACE, Words
from .components import components

#: Common shingles that the order knows at most.
MOST_COMMON = 500_000
#: Groups of a list, or members of a group, that one task pairs or ranks.
LIST_PART = 4_000

_WEIGHTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; a text of fewer words is one shingle."""
    words = Words(texts, NON_SPACE)
    h, n = words.hash, len(words)
    whole = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        whole += common.mix(h[k : k + len(whole)] + np.uint64(k)) * _WEIGHTS[k % 5]
    whole = common.mix(whole)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            part = sum((common.mix(h[a + k : a + k + 1] + np.uint64(k)) * _WEIGHTS[k] for k in range(b - a)), np.full(1, b - a, np.uint64))
            out.append(common.mix(part))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(s: np.ndarray) -> int:
    return int(common.mix(np.array([common.mix(s ^ _WEIGHTS[3]).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].astype(np.int64))


def _key(shingles: np.ndarray) -> np.ndarray:
    """40 bits of a hash, by which shingles are counted: the counts only order them."""
    return shingles >> np.uint64(24)


def _bytes_of(values: np.ndarray, width: int) -> bytes:
    """The low bytes of the values; those of a rank stand together, which compresses well."""
    return values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _packed(keys: np.ndarray, counts: np.ndarray, n_blocks: int) -> pa.RecordBatch:
    """Sorted keys and their counts, cut into blocks of the key range."""
    cut = np.searchsorted(keys, np.arange(n_blocks + 1, dtype=np.uint64) * np.uint64((1 << 40) // n_blocks + 1))
    blocks = [k for k in range(n_blocks) if cut[k] < cut[k + 1]]
    planes = [_bytes_of(keys[cut[k] : cut[k + 1]], 5) for k in blocks]
    times = [counts[cut[k] : cut[k + 1]].astype(np.uint32).tobytes() for k in blocks]
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(planes, pa.binary()), pa.array(times, pa.binary())], ["block", "planes", "times"])


def _unpacked(planes: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view(np.uint64)


def _count(size: int, n_blocks: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for a, b in common.slices(batch.column(0)):
                held += shingle_sets(batch.column(0).slice(a, b - a), size)
                n += sum(map(len, held[-(b - a) :]))
                if n > 1_000_000:
                    yield _packed(*np.unique(_key(np.concatenate(held)), return_counts=True), n_blocks)
                    held, n = [], 0
        if n:
            yield _packed(*np.unique(_key(np.concatenate(held)), return_counts=True), n_blocks)

    return count


def _often(frame: pd.DataFrame) -> pd.DataFrame:
    """Keys of a block that at least 4 texts hold, and log2 of how many."""
    keys = np.concatenate([_unpacked(x, 5) for x in frame["planes"]])
    times = np.concatenate([np.frombuffer(x, np.uint32) for x in frame["times"]])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n = np.add.reduceat(times[order].astype(np.int64), heads)
    return pd.DataFrame({"key": keys[heads][n >= 4].astype(np.int64), "level": np.log2(n[n >= 4]).astype(np.int32)})


def common_shingles(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of shingles of many texts, sorted, and log2 of their counts: all those over the lowest power of two that leaves at most MOST_COMMON.

    Tasks send their distinct keys as packed blocks of the key range; a block holds a fixed part of what a
    partition of the texts holds, however many there are, as each task sends a key once.
    """
    n_blocks = 4 * max(16, texts.rdd.getNumPartitions())
    packed = texts.mapInArrow(_count(size, n_blocks), "block int, planes binary, times binary")
    counts = common.materialise(packed.groupBy("block").applyInPandas(_often, "key long, level int"))
    level, total = 0, 0
    for row in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # at most 48 rows
        total += row["count"]
        if total > MOST_COMMON:
            break
        level = row.level
    kept = counts.where(F.col("level") >= level).toPandas() if level else counts.limit(0).toPandas()
    keys = kept["key"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(keys)
    return keys[order], kept["level"].to_numpy(np.int64)[order]


def _prefixes(size: int, percent: int, broadcast):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, level = broadcast.value
        for batch in batches:
            for a, b in common.slices(batch.column(3)):
                sets = shingle_sets(batch.column(3).slice(a, b - a), size)
                sizes = np.array([len(s) for s in sets])
                every = np.concatenate(sets)
                rank = np.zeros(len(every), np.int64)
                if len(keys):
                    own = _key(every)
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    rank = np.where(keys[at] == own, level[at], 0)
                every = every[np.argsort(np.repeat(np.arange(len(sets)), sizes) * 64 + rank, kind="stable")]
                first = np.concatenate([[0], np.cumsum(sizes)])
                lengths = np.where(sizes > 0, sizes - -(-percent * sizes // 100) + 1, 0)
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                values = every[np.repeat(first[:-1] - offsets[:-1], lengths) + np.arange(offsets[-1])]
                nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
                prefix = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:3], nodes, pa.array(sizes, pa.int64()), prefix], ["id", "file", "place", "node", "n", "prefix"])

    return prefixes


def _enough(percent: int) -> Column:
    """Sizes a_n >= b_n of sets that may link."""
    return F.col("b_n") * 100 >= F.col("a_n") * percent


def _overlap(percent: int) -> Column:
    """The least overlap of linked sets of sizes a_n and b_n."""
    return F.ceil((F.col("a_n") + F.col("b_n")) * percent / F.lit(100.0 + percent) - F.lit(1e-9)).cast("long")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = _unpacked(x.as_py(), 6), _unpacked(y.as_py(), 6)
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
            common.release()

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("s")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("set").alias("t")), "b")
    return both.select("a", "b", "s", "t").mapInArrow(check, "a long, b long").distinct()


def _sets_of(nodes: DataFrame, firsts: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(node, set) of these nodes, read again from the text of each node's first row. A set is held as 48 bits of each hash."""
    wanted = nodes.select("node").distinct().join(firsts, "node").select("first.file", "first.place")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in common.slices(batch.column(0)):
                found = shingle_sets(batch.column(0).slice(a, b - a), size)
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in found], pa.int64()), pa.array([_bytes_of(s >> np.uint64(16), 6) for s in found], pa.binary())], ["node", "set"])

    return common.materialise(common.at_places(texts.select("text"), wanted, kept=True).mapInArrow(sets, "node long, set binary"))


def _parts(length: Column) -> Column:
    """In how many parts a list of this length is dealt."""
    return F.ceil(length / F.lit(LIST_PART)).cast("int")


def _part_of(value: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(value), F.col(parts)).cast("int")


def _first_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """(a_group, b_group) of groups and the neighbour and the hub that they meet in most lists."""
    shared = postings.groupBy("group").agg(F.count(F.lit(1)).alias("shared")).withColumnRenamed("group", "g")
    ranked = postings.join(shared, F.col("group") == F.col("g")).select("shingle", "lists", "group", "n", (F.col("shared") / F.col("n")).alias("shared"))
    ranked = ranked.withColumn("part", F.pmod(F.xxhash64("group"), _parts(F.col("lists"))).cast("int"))
    this = F.struct(F.col("group").alias("b"), F.col("n").alias("b_n"))
    by_size, by_share = (Window.partitionBy("shingle", "part").orderBy(*o) for o in (("n", "group"), (F.desc("shared"), "n", "group")))
    a = [F.col("group").alias("a"), F.col("n").alias("a_n")]
    met = ranked.select(*a, F.lag(this).over(by_size).alias("beside"), F.first(this).over(by_share).alias("hub"))
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(c).alias("with")) for k, c in enumerate(("beside", "hub"))]
    meets = met.select("a", "a_n", F.inline(F.filter(F.array(*kinds), lambda x: x["with"].isNotNull() & (x["with"]["b"] != F.col("a")))))
    # the parts of a long list: each part's hub with the whole list's
    long = ranked.where(F.col("lists") > LIST_PART)
    best = F.min(F.struct((-F.col("shared")).alias("s"), "n", "group")).alias("best")
    hubs = long.groupBy("shingle", "part").agg(best)
    top = hubs.groupBy("shingle").agg(F.min("best").alias("top"))
    hubs = hubs.join(top, "shingle").select(F.col("best.group").alias("a"), F.col("best.n").alias("a_n"), F.lit(2).alias("kind"), F.struct(F.col("top.group").alias("b"), F.col("top.n").alias("b_n")).alias("with"))
    meets = meets.unionByName(hubs)
    larger, smaller = F.greatest("a_n", "with.b_n"), F.least("a_n", "with.b_n")
    meets = meets.where((F.col("with.b") != F.col("a")) & (smaller * 100 >= larger * percent))
    times = meets.groupBy("a", "kind", F.col("with.b").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    most = times.groupBy("a", "kind").agg(F.max(F.struct("times", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    return most.select(F.greatest("a", "b").alias("a_group"), F.least("a", "b").alias("b_group")).distinct()


def _prefixes_of(rows: DataFrame, leads: DataFrame) -> DataFrame:
    """(group, n, prefix) of these groups, from the stored row of each one's first node."""
    return common.at_places(rows, leads.select("row.file", "row.place"), kept=True).select(F.col("node").alias("group"), "n", "prefix")


def _by_prefix(pairs: DataFrame, rows: DataFrame, leads: DataFrame, percent: int) -> DataFrame:
    """The pairs (a_group, b_group), stored, that may still link: what their prefixes share, and all that stands behind the prefix that ends last, is enough."""
    asked = pairs.select(F.col("a_group").alias("group")).unionByName(pairs.select(F.col("b_group").alias("group"))).distinct()
    prefix = common.materialise(_prefixes_of(rows, leads.join(asked, "group", "left_semi")))
    a, b = (prefix.select(F.col("group").alias(f"{x}_group"), F.col("n").alias(f"{x}_n"), F.col("prefix").alias(f"{x}_prefix")) for x in "ab")
    both = pairs.join(a, "a_group").join(b, "b_group")
    rest = F.greatest(F.col("a_n") - F.size("a_prefix"), F.col("b_n") - F.size("b_prefix"))
    return both.where(F.size(F.array_intersect("a_prefix", "b_prefix")) + rest >= _overlap(percent)).select("a_group", "b_group")


def _open_pairs(postings: DataFrame, placed: DataFrame, rows: DataFrame, leads: DataFrame, percent: int) -> DataFrame:
    """(a, b) of nodes in different components whose groups meet in a list and may link by size, place and prefix, or are one group."""
    sides = placed.select("group", "component").distinct()
    listed = common.materialise(postings.drop("lists").join(sides, "group"))
    mixed = listed.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("lists")).where("low <> high")
    mixed = common.materialise(mixed.select(F.col("shingle").alias("of_list"), "lists"))
    # sizes that may link differ by one step at most
    step = F.floor(F.log("n") / F.lit(1.0001 * math.log(100 / percent))).cast("int")
    listed = common.join_keys(listed, mixed, "shingle", "of_list", "lists", "inner").select("shingle", "group", "n", "place", "component", step.alias("step"), _parts(F.col("lists")).alias("parts"))
    a, b = (listed.select("shingle", "step", "parts", *(F.col(c).alias(f"{x}_{c}") for c in ("group", "n", "place", "component"))) for x in "ab")
    a = a.select("*", _part_of("a_group", "parts").alias("part")).drop("parts")
    b = b.select(*b.columns[3:], "shingle", "parts", F.explode(F.array("step", F.col("step") + 1)).alias("step"))
    b = b.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).drop("parts")
    larger = (F.col("a_n") > F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_group") > F.col("b_group")))
    near = (F.col("a_place") <= F.col("a_n") - _overlap(percent)) & (F.col("b_place") <= F.col("b_n") - _overlap(percent))
    met = a.join(b, ["shingle", "step", "part"]).where((F.col("a_component") != F.col("b_component")) & larger & _enough(percent) & near)
    met = common.materialise(met.select("a_group", "b_group").distinct())
    met = common.materialise(_by_prefix(met, rows, leads, percent))
    of_a, of_b = (placed.select(F.col("group").alias(f"{x}_group"), F.col("node").alias(x), F.col("component").alias(f"{x}_component")) for x in "ab")
    across = met.join(of_a, "a_group").join(of_b, "b_group").where(F.col("a_component") != F.col("b_component")).select("a", "b")
    many = leads.where("members > 1").select(F.col("group").alias("g"), _parts(F.col("members")).alias("parts"))
    inside = placed.join(many, F.col("group") == F.col("g"))
    one = inside.select("group", _part_of("node", "parts").alias("part"), F.col("node").alias("a"), F.col("component").alias("a_component"))
    two = inside.select("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("node").alias("b"), F.col("component").alias("b_component"))
    same = one.join(two, ["group", "part"]).where((F.col("a") < F.col("b")) & (F.col("a_component") != F.col("b_component"))).select("a", "b")
    return across.unionByName(same).distinct()


def _linked(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, file, place, node, n) of every row of docs, and (of, component, rows) of every node; docs is a plain read of Parquet files."""
    common.small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(common_shingles(texts.select("text"), size))
    placed_texts = texts.select("id", *common.address(texts), "text")
    rows = placed_texts.mapInArrow(_prefixes(size, percent, known), f"id {kind}, file string, place long, node long, n long, prefix array<long>")
    rows = common.materialise(rows.withColumn("key", F.xxhash64("n", "prefix")))
    own_place = F.struct(*common.address(rows)).alias("own")
    full = rows.where("n > 0").select("node", "key", F.struct("file", "place").alias("first"), own_place)
    nodes = full.groupBy("node").agg(F.min("first").alias("first"), F.min("own").alias("row"), F.first("key").alias("key"), F.count(F.lit(1)).alias("rows"))
    nodes = common.materialise(nodes)
    firsts = nodes.select("node", "first")
    several = nodes.groupBy("key").agg(F.min("node").alias("group"), F.count(F.lit(1)).alias("members"))
    several = common.materialise(several.where("members > 1").withColumnRenamed("key", "of"))
    member = common.join_keys(nodes, several, "key", "of", "members").select("node", F.coalesce("group", "node").alias("group"), "members", "row")
    member = common.materialise(member)
    leads = member.where("node = group").select("group", F.coalesce("members", F.lit(1)).alias("members"), "row")
    postings = _prefixes_of(rows, leads).select("group", "n", F.posexplode("prefix").alias("place", "shingle"))
    often = postings.groupBy("shingle").agg(F.count(F.lit(1)).alias("lists")).where("lists > 1")
    often = common.materialise(often.select(F.col("shingle").alias("of_list"), "lists"))
    postings = common.materialise(common.join_keys(postings, often, "shingle", "of_list", "lists", "inner").drop("of_list"))

    near = _by_prefix(common.materialise(_first_pairs(postings, percent)), rows, leads, percent)
    inside = member.where("node <> group").select(F.col("node").alias("a"), F.col("group").alias("b"))
    first_pairs = common.materialise(near.select(F.col("a_group").alias("a"), F.col("b_group").alias("b")).unionByName(inside))
    sets = _sets_of(first_pairs.select(F.col("a").alias("node")).unionByName(first_pairs.select(F.col("b").alias("node"))), firsts, texts, size)
    links = common.materialise(_verify(first_pairs, sets, percent))
    found = components(links)

    placed = common.materialise(member.join(found, "node", "left").select("node", "group", F.coalesce("component", "node").alias("component")))
    more = common.materialise(_open_pairs(postings, placed, rows, leads, percent))
    if not more.isEmpty():
        sets = _sets_of(more.select(F.col("a").alias("node")).unionByName(more.select(F.col("b").alias("node"))), firsts, texts, size)
        extra = common.materialise(_verify(more, sets, percent))
        if not extra.isEmpty():
            found = components(links.unionByName(extra))
    final = nodes.select("node", "rows").join(found, "node", "left").select(F.col("node").alias("of"), F.coalesce("component", "node").alias("component"), "rows")
    return rows.drop("prefix"), common.materialise(final)


def _least(rows: DataFrame, final: DataFrame) -> DataFrame:
    """Each row with the least row of its component, by id (nulls last), file and place; without one where its set is empty."""
    known = common.materialise(common.join_keys(rows, final, "node", "of", "rows"))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "place")
    least = known.where("component IS NOT NULL").groupBy("component").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("size"))
    least = common.materialise(least.select(F.col("component").alias("in"), "least", "size"))
    return common.join_keys(known, least, "component", "in", "size")


def link_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85, stored: bool = False) -> DataFrame:
    """(id, n_shingles, component) of every row: texts link if the Jaccard similarity of their sets is percent / 100 at least; the component is the smallest id reachable.

    stored: whether docs is a plain read of Parquet files; else its ids and texts are written first.
    """
    docs = docs if stored else common.materialise(docs.select(F.col(id_col), F.col(text_col)))
    found = _least(*_linked(docs, id_col, text_col, size, percent))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least.id", "id").alias("component"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, stored: bool = False) -> DataFrame:
    """One row of each component, that with the smallest id (of several, one of them), with all its columns; rows without words stay. No row is shuffled.

    stored: whether docs is a plain read of Parquet files; else it is written first.
    """
    docs = docs if stored else common.materialise(docs)
    found = _least(*_linked(docs, id_col, text_col, size, percent))
    gone = found.where(F.col("least").isNotNull() & ~((F.col("file") == F.col("least.file")) & (F.col("place") == F.col("least.place"))))
    return common.at_places(docs, gone.select("file", "place"), kept=False)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_texts(common.documents(spark, sf_dir), stored=True).withColumnRenamed("component", "component_id")
