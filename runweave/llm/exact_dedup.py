"""Exact dedup in two passes over Bloom filters, with DataFrame functions only.

Each whole text is read once: its normalised SHA-256, length and id make a narrow row, and the narrow rows are
written. Pass 1 folds their hashes into the cells of a first Bloom filter; cells that were hit more than once make
the second filter, that of the possibly repeated hashes. Pass 2 tests each narrow row against it: rows that miss
have no equal and pass straight through; only the rest is grouped by SHA-256. The filter grows with the rows.
A small one is broadcast, a larger one joined by its blocks, which shuffles narrow rows, never texts.

`drop_copies` names the rows that go by file and place there, and takes them out by bitmaps of the places: whole
texts are never shuffled, at any size.

Equal texts are those identical without blanks, tabs and line ends; null counts as empty, and all empty texts
are equal. The row with most code points, then the smallest id (null smallest) stays. Repeated rows, equal in
id and length, share that row's verdict in `mark_copies`; `drop_copies` keeps one of them. Extra columns are
left out by `mark_copies` and kept by `drop_copies`, whatever their names. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Cells of the filters for each row, and the fewest; a block of 64 cells holds both cells of a hash.
CELLS_PER_ROW, LEAST_CELLS = 16, 1 << 16
#: Most blocks of the filter that are broadcast; more are joined with the narrow rows by shuffling.
MOST_BROADCAST_BLOCKS = 1 << 21

_BLANKS = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]


def normalised(text: Column) -> Column:
    for blank in _BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks))


def _cells(h: Column) -> list[Column]:
    """Two cells of a hash's block; they come from other bits than the block."""
    other = F.xxhash64(h)
    return [F.pmod(other, F.lit(64)).cast("int"), F.pmod(F.shiftright(other, 32), F.lit(64)).cast("int")]


def repeated_cells(hashes: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): the second Bloom filter, whose set bits are cells that more than one row's hash fell into."""
    h = F.col("h")
    first, second = _cells(h)
    hit = hashes.select(_block(h, blocks).alias("block"), F.explode(F.array_distinct(F.array(first, second))).alias("cell"))
    often = hit.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return often.groupBy("block").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("cell"))).alias("bits"))


def possibly_repeated(narrow: DataFrame) -> DataFrame:
    """The narrow rows (which have a hash h) with the column maybe: false only if no other row has this hash."""
    rows = narrow.count()
    blocks = max(LEAST_CELLS, CELLS_PER_ROW * rows) // 64
    filter_ = common.materialise(repeated_cells(narrow.select("h"), blocks))
    side = filter_.select(F.col("block").alias("of_filter"), "bits")
    side = F.broadcast(side) if filter_.count() <= MOST_BROADCAST_BLOCKS else side
    probed = narrow.join(side, _block(F.col("h"), blocks) == F.col("of_filter"), "left")
    hit = [F.getbit("bits", cell) == 1 for cell in _cells(F.col("h"))]
    return probed.withColumn("maybe", F.coalesce(hit[0] & hit[1], F.lit(False))).drop("of_filter", "bits")


def _narrow(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(id, sha, len, h, ...) of each row, from its whole text, written."""
    text = common.text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(text), 256)).alias("sha"), F.char_length(text).alias("len"), *more)
    return common.materialise(rows.withColumn("h", F.xxhash64("sha")))


def _groups(shared: DataFrame, *order: str) -> DataFrame:
    """(of, keep, n) of each text that several rows have: the least row in this order, and how many there are. Written."""
    groups = shared.groupBy("sha").agg(F.min(F.struct((-F.col("len")).alias("len"), *order)).alias("keep"), F.count(F.lit(1)).alias("n"))
    return common.materialise(groups.where("n > 1").withColumnRenamed("sha", "of"))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row. Texts are read once and never shuffled."""
    rows = possibly_repeated(_narrow(docs, id_col, text_col))
    digest = F.lower(F.hex("sha")).alias("text_sha256")
    alone = rows.where(~F.col("maybe")).select(F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest)
    shared = rows.where("maybe")
    more = common.join_keys(shared, _groups(shared, "id"), "sha", "of", "n")
    single = F.col("of").isNull()
    kept = single | (F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("len") == -F.col("keep.len")))
    keep_id = F.when(single, F.col("id")).otherwise(F.col("keep.id"))
    return alone.unionByName(more.select(F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), digest))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> DataFrame:
    """One row of each text, with all its columns; no row is shuffled.

    stored: whether docs is a plain read of Parquet files, whose rows have a place that stays; else it is written first.
    """
    if not stored:
        docs = common.materialise(docs)
    shared = possibly_repeated(_narrow(docs, id_col, text_col, *common.address(docs))).where("maybe")
    found = common.join_keys(shared, _groups(shared, "id", "file", "place"), "sha", "of", "n")
    gone = found.where(F.col("of").isNotNull() & ~((F.col("file") == F.col("keep.file")) & (F.col("place") == F.col("keep.place"))))
    return common.at_places(docs, gone, kept=False)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(common.documents(spark, sf_dir))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, sha256(norm) AS text_sha256, length(t) AS len,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
