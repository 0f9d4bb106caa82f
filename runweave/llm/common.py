"""What the operators of this subpackage share: columns, word spans of Arrow batches, the shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; its arrays take about 40 times as much.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 1_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words `[^\x20\x09-\x0D]+`.
NON_SPACE = ~_SPACE
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z became a-z.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_POWERS: dict[str, np.ndarray] = {}


def text_of(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def with_text(docs: DataFrame, text_col: str) -> tuple[DataFrame, int]:
    """docs, and the place among its columns of the text, which is docs' own column (nulls not yet filled) if that is a string."""
    if dict(docs.dtypes)[text_col] == "string":
        return docs, docs.columns.index(text_col)
    return docs.withColumn(free_name(docs, "text"), text_of(text_col)), len(docs.columns)


def filled(texts: pa.Array) -> pa.Array:
    """The texts, null counting as empty."""
    return pc.fill_null(texts, "") if texts.null_count else texts


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from now on: with long texts or sets, Spark's default of 10,000 rows takes hundreds of MB on either side."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Where it is unset a local one is set, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="runweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/runweave-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows, written as a table in the shared folder and read back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def address(docs: DataFrame) -> list[Column]:
    """(file, place) of the rows of a table that is a plain read of Parquet files; a column of docs may be named _metadata."""
    source = docs.metadataColumn("_metadata")
    return [source["file_path"].alias("file"), source["row_index"].alias("place")]


def is_stored(docs: DataFrame) -> bool:
    """Whether the rows of docs have a file and a place: it reads Parquet files, with nothing above but filters and projections."""
    try:
        return bool(docs.select(*address(docs)).columns and docs.inputFiles())
    except AnalysisException:
        return False


#: Places that a bitmap covers (fixed by Spark), and most bitmaps (of 4 KB) that are broadcast at once.
PLACES, MOST_BITMAPS = 32_768, 16_384


def at_places(docs: DataFrame, rows: DataFrame, kept: bool, *more: Column) -> DataFrame:
    """The rows of docs, a plain read of Parquet files, that stand (kept) or don't stand in rows (file, place), with the columns `more`.

    No row of docs is shuffled: rows become bitmaps of places, and the files are dealt into groups whose bitmaps
    have a bounded size; each group is read once, with its own bitmaps broadcast.
    """
    bitmaps = rows.groupBy("file", F.floor(F.col("place") / PLACES).alias("part")).agg(F.bitmap_construct_agg(F.col("place") % PLACES).alias("places"))
    bitmaps = materialise(bitmaps.select(F.col("file").alias("of_file"), "part", "places"))
    n_groups = -(-2 * bitmaps.count() // MOST_BITMAPS) or 1
    out = None
    for k in range(n_groups):
        own = docs.where(F.pmod(F.xxhash64(docs.metadataColumn("_metadata")["file_path"]), F.lit(n_groups)) == k) if n_groups > 1 else docs
        side = bitmaps.where(F.pmod(F.xxhash64("of_file"), F.lit(n_groups)) == k) if n_groups > 1 else bitmaps
        found = own.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns], *more).alias("row"), *address(own))
        here = (F.col("file") == F.col("of_file")) & (F.floor(F.col("place") / PLACES) == F.col("part"))
        found = found.join(F.broadcast(side), here, "inner" if kept else "left")
        byte = F.conv(F.hex(F.substring("places", ((F.col("place") % PLACES) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = found.where(F.coalesce(F.getbit(byte, (F.col("place") % 8).cast("int")), F.lit(0)) == int(kept)).select("row.*")
        out = found if out is None else out.unionByName(found)
    return out


def join_keys(rows: DataFrame, side: DataFrame, key: str, side_key: str, n: str, how: str = "left") -> DataFrame:
    """rows joined (left or inner) with side, a stored table with one row for each key, and in column n how many rows have it.

    Keys of a thousandth of all rows (at most 1,000 keys) are broadcast, so that no key is hot where the others are shuffled.
    """
    on = F.col(key) == F.col(side_key)
    least = max(2, (side.agg(F.sum(n)).first()[0] or 0) / HOT)
    hot = F.col(n) >= least
    cold = rows.join(F.broadcast(side.where(hot).select(side_key)), on, "left_anti")
    return rows.join(F.broadcast(side.where(hot)), on).unionByName(cold.join(side.where(~hot), on, how))


#: A key is hot from this part of all rows on.
HOT = 1_000


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters the bits of 64-bit hashes."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def release() -> None:
    """Gives memory that allocators hold back to the system: workers live on, and their executor's share is bounded."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _P), ("down", _P_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or one row."""
    sizes = np.diff(offsets_of(texts))
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield begin, i
            begin, held = i, 0
        held += int(size)
    if begin < len(sizes):
        yield begin, len(sizes)
    release()


def offsets_of(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type)
    return np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


class Words:
    """Word spans of an Arrow array of texts without nulls: A-Z lower-cased, cut at bytes outside `inside`.

    start, end: byte spans in `data`; doc: the row of each word; first: the first word of each row (one more at the end); hash: 64 bits of each word.
    """

    def __init__(self, texts: pa.Array, inside: np.ndarray):
        at = offsets_of(texts)
        body = texts.buffers()[2]
        raw = np.frombuffer(body, np.uint8)[at[0] : at[-1]] if body is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.data, self.at = _LOWER[raw], at - at[0]
        n = len(raw)
        kept = inside[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        before = np.zeros(n + 1, bool)
        before[1:] = kept
        here = np.zeros(n + 1, bool)
        here[:n] = kept
        self.start = np.flatnonzero(here & (~before | edge))
        self.end = np.flatnonzero(before & (~here | edge))
        self.first = np.searchsorted(self.start, self.at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        up, self._down = _powers(n + 1)
        self._total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODE[self.data] * up[:n], out=self._total[1:])
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64 bits of the bytes of each span."""
        size = (end - start).astype(np.uint64)
        return mix((self._total[end] - self._total[start]) * self._down[start] + size * np.uint64(0xD6E8FEB86659FD93))

    def __len__(self) -> int:
        return len(self.start)


def word_hashes(words: list[str]) -> np.ndarray:
    """The hash that Words gives each word, each without white space and not empty."""
    return Words(pa.array([w for w in words]), NON_SPACE).hash if words else np.zeros(0, np.uint64)


def group_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each row, where row i has values[first[i]:first[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def held_out(remainder: int, id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text has this remainder modulo 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == remainder, F.lit(False))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
