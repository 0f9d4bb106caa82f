"""Document fingerprints that say what differs: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line; long lines end a paragraph after the words whose hash is divisible by PIECE_WORDS, too, so an
edit changes the paragraphs around it alone. The digest of a paragraph (48 bits; a repeated one counts its
occurrences in) goes into one cell of each of three tables; a cell holds a count and the exclusive or of its digests,
each beside 16 bits that check it. Cells of two versions subtract; what is left holds the differing digests alone.
Peeling takes out a digest that is alone in a cell, which uncovers others, until nothing is left. If something is, the
versions are sketched again in four times as many cells; digests that no size tells apart (more cells than FULL for
each paragraph) are compared one by one. Likeness is the Jaccard similarity of the paragraphs that this recovers.

Texts whose words and lines agree have equal fingerprints; white space around a paragraph doesn't count. Null counts as
empty; texts without words have no paragraphs and are alike (1). Repeated rows are rows each. Empty tables stay empty.
Columns other than id and text are left out.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

#: Cells of each of a fingerprint's tables (a power of two), and how many times as many the next try has.
CELLS, LARGER = 8, 4
#: Tables of a sketch: a digest stands in one cell of each.
TABLES = 3
#: Cells of a table for each paragraph from which on digests are compared one by one.
FULL = 8
#: A line also ends a paragraph after every word whose hash this number divides.
PIECE_WORDS = 16

_DIGEST = np.uint64((1 << 48) - 1)
_CHECK = np.uint64((1 << 16) - 1)
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def checked(digests: np.ndarray) -> np.ndarray:
    """Digests beside their check bits, as cells hold them."""
    return digests << np.uint64(16) | common.mix(digests ^ _SALTS[3]) >> np.uint64(48)


def places(digests: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each table that a digest goes to, as places in the row of all cells; tables come first."""
    own = common.mix(digests[None, :] + _SALTS[:TABLES, None]) & np.uint64(cells - 1)
    return own.astype(np.int64) + np.arange(TABLES)[:, None] * cells


def paragraphs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, digest) of every paragraph. Digests of a row differ."""
    words = common.Words(texts, common.NON_SPACE)
    at, n = common.offsets_of(texts), len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    body = texts.buffers()[2].to_pybytes()[at[0] : at[-1]]
    lines = np.concatenate([[0], np.cumsum(np.frombuffer(body, np.uint8) == 0x0A)])
    ends = words.hash % np.uint64(PIECE_WORDS) == 0
    ends[:-1] |= (lines[words.start[1:]] > lines[words.end[:-1]]) | (words.doc[1:] > words.doc[:-1])
    ends[-1] = True
    last = np.flatnonzero(ends)
    first = np.concatenate([[0], last[:-1] + 1])
    digests = b"".join([blake2b(body[a:b], digest_size=8).digest() for a, b in zip(words.start[first].tolist(), words.end[last].tolist(), strict=True)])
    digests, rows = np.frombuffer(digests, "<u8") & _DIGEST, words.doc[last]
    order = np.lexsort((digests, rows))
    new = np.ones(len(order), bool)
    new[1:] = (digests[order][1:] != digests[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    times = np.zeros(len(order), np.uint64)
    times[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return rows, np.where(times > 0, common.mix(digests + times * _SALTS[0]) & _DIGEST, digests)


def sketch(rows: np.ndarray, digests: np.ndarray, n_rows: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts modulo 256, exclusive ors) of the cells of each row."""
    width = TABLES * cells
    at = (rows[None, :] * width + places(digests, cells)).ravel()
    counts = np.bincount(at, minlength=n_rows * width).astype(np.uint8)
    sums = np.zeros(n_rows * width, np.uint64)
    np.bitwise_xor.at(sums, at, np.tile(checked(digests), TABLES))
    return counts.reshape(n_rows, width), sums.reshape(n_rows, width)


def peel(counts: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whole, pair, digest, gone) from differences of sketches: which pairs peeled whole, and each digest taken out: of which pair, and whether of its first side alone."""
    counts, sums = counts.copy(), sums.copy()
    width = counts.shape[1]
    found = []
    for _ in range(2 * width + 8):  # a cell that passes the check by chance may come again and again
        pair, cell = np.nonzero((counts == 1) | (counts == 255))
        word = sums[pair, cell]
        digest = word >> np.uint64(16)
        good = checked(digest) == word
        pair, cell, digest = pair[good], cell[good], digest[good]
        good = places(digest, width // TABLES)[cell * TABLES // width, np.arange(len(cell))] == cell
        pair, cell, digest = pair[good], cell[good], digest[good]
        if not len(pair):
            break
        _, once = np.unique(np.stack([pair.astype(np.uint64), digest]), axis=1, return_index=True)
        pair, cell, digest = pair[once], cell[once], digest[once]
        first = counts[pair, cell] == 1
        at = (pair[None, :] * width + places(digest, width // TABLES)).ravel()
        np.subtract.at(counts.reshape(-1), at, np.tile(np.where(first, 1, 255).astype(np.uint8), TABLES))
        np.bitwise_xor.at(sums.reshape(-1), at, np.tile(checked(digest), TABLES))
        found.append((pair, digest, first))
    pair, digest, first = (np.concatenate(x) if found else np.zeros(0, kind) for x, kind in zip(zip(*found, strict=True) if found else ((), (), ()), (np.int64, np.uint64, bool), strict=True))
    return ~(counts.any(axis=1) | sums.any(axis=1)), pair, digest, first


def numbers_of_differences(rows: np.ndarray, digests: np.ndarray, n_rows: int, pairs: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """(differing digests, cells of the last try) of each pair (left row, right row); pairs that don't peel whole are tried again in more cells."""
    n = np.bincount(rows, minlength=n_rows)
    out, size = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    order = np.argsort(rows, kind="stable")
    start = np.concatenate([[0], np.cumsum(n)])
    open_ = np.arange(len(pairs))
    while len(open_):
        left, right = pairs[open_].T
        full = cells > FULL * (n[left] + n[right])
        for k in open_[full]:
            a, b = (digests[order[start[r] : start[r + 1]]] for r in pairs[k])
            out[k], size[k] = len(np.setxor1d(a, b)), cells
        open_ = open_[~full]
        used, place = np.unique(pairs[open_], return_inverse=True)
        place = place.reshape(-1, 2)
        of = np.full(n_rows, -1)
        of[used] = np.arange(len(used))
        own = of[rows] >= 0
        counts, sums = sketch(of[rows[own]], digests[own], len(used), cells)
        whole, pair, _, _ = peel(counts[place[:, 0]] - counts[place[:, 1]], sums[place[:, 0]] ^ sums[place[:, 1]])
        out[open_[whole]] = np.bincount(pair, minlength=len(open_))[whole]
        size[open_[whole]] = cells
        open_, cells = open_[~whole], cells * LARGER
    return out, size


def likeness(n_left: np.ndarray, n_right: np.ndarray, differing: np.ndarray) -> np.ndarray:
    """Jaccard similarity of two sets of these sizes; 1 if both are empty."""
    both = n_left + n_right
    return np.where(both > 0, (both - differing) / np.maximum(both + differing, 1), 1.0)


def as_text(n: int, counts: np.ndarray, sums: np.ndarray) -> str:
    """The fingerprint of a row: its number of paragraphs, a point, its cells."""
    return f"{n}." + base64.b64encode(counts.tobytes() + sums.astype("<u8").tobytes()).decode()


def cells_of(fingerprint: str | None, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of paragraphs, counts and sums of a fingerprint; none is that of an empty text."""
    n, cells = fingerprint.split(".") if fingerprint else ("0", "")
    raw = base64.b64decode(cells) or bytes(9 * width)
    return int(n), np.frombuffer(raw, np.uint8, width), np.frombuffer(raw, "<u8", width, width)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """(id, n_paragraphs, fingerprint) of each row."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in common.slices(batch.column(1)):
                rows, digests = paragraphs(batch.column(1).slice(a, b - a))
                n = np.bincount(rows, minlength=b - a)
                text = [as_text(*x) for x in zip(n.tolist(), *sketch(rows, digests, b - a, cells), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(text, pa.string())], [id_col, "n_paragraphs", "fingerprint"])

    return docs.select(id_col, common.text_of(text_col)).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_paragraphs long, fingerprint string")


def differences(old: DataFrame, new: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS, most_cells: int = 1 << 14) -> DataFrame:
    """(id, likeness, removed, added, cells) of each id: digests of the paragraphs that only the old or only the new version has.

    Only fingerprints are joined. Ids whose difference does not peel whole are tried again, with their texts read
    again; beyond most_cells their digests are joined instead. An id of one version is compared with an empty text,
    and so is a null id. Of several rows of an id each is compared with each of the other version.
    """
    kind = dict(old.dtypes)[id_col]
    names = f"`{id_col}` {kind}, likeness double, removed array<long>, added array<long>, cells int"
    out = None
    while True:
        small = cells <= most_cells
        sides = [fingerprints(x, id_col, text_col, cells).drop("n_paragraphs") if small else digest_lists(x, id_col, text_col) for x in (old, new)]
        a, b = (x.toDF(f"{name}_id", name) for x, name in zip(sides, "ab", strict=True))
        pairs = a.join(b, F.col("a_id") == F.col("b_id"), "full").select(F.coalesce("a_id", "b_id").alias(id_col), "a", "b")
        done = common.materialise(pairs.mapInArrow(_peeled(id_col, cells) if small else _compared(id_col, cells), names))
        whole = done.where(F.col("likeness").isNotNull())
        out = whole if out is None else out.unionByName(whole)
        failed = done.where(F.col("likeness").isNull()).select(F.col(id_col).alias("of")).distinct()
        if failed.isEmpty():
            return out
        again = common.materialise(failed)
        old, new = (x.select(id_col, text_col).join(again, F.col(id_col).eqNullSafe(F.col("of")), "left_semi") for x in (old, new))
        out = out.join(again, F.col(id_col).eqNullSafe(F.col("of")), "left_anti")
        cells *= LARGER


def digest_lists(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digests) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in common.slices(batch.column(1)):
                rows, digests = paragraphs(batch.column(1).slice(a, b - a))
                order = np.argsort(rows, kind="stable")
                start = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=b - a))])
                lists = pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(digests[order].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], [id_col, "digests"])

    return docs.select(id_col, common.text_of(text_col)).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, digests array<long>")


def _peeled(id_col: str, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (n, counts, sums), (m, less, other) = (map(np.array, zip(*(cells_of(x, TABLES * cells) for x in column.to_pylist()), strict=True)) if len(column) else (np.zeros(0),) * 3 for column in (batch.column(1), batch.column(2)))
            if not len(n):
                continue
            whole, pair, digest, first = peel(counts - less, sums ^ other)
            near = likeness(n, m, np.bincount(pair, minlength=len(n)))
            gone, added = ([np.sort(digest[(pair == k) & (first == side)]).astype(np.int64) if whole[k] else None for k in range(len(n))] for side in (True, False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.float64(), mask=~whole), pa.array(gone, pa.list_(pa.int64())), pa.array(added, pa.list_(pa.int64())), pa.array([cells] * len(n), pa.int32())], [id_col, "likeness", "removed", "added", "cells"])

    return run


def _compared(id_col: str, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.array(x or [], np.int64) for x in batch.column(k).to_pylist()] for k in (1, 2)]
            gone, added = ([np.setdiff1d(x, y) for x, y in zip(*s, strict=True)] for s in (sides, sides[::-1]))
            n, m, d = (np.array([len(x) for x in xs]) for xs in (*sides, [np.concatenate(x) for x in zip(gone, added, strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(likeness(n, m, d), pa.float64()), pa.array(gone, pa.list_(pa.int64())), pa.array(added, pa.list_(pa.int64())), pa.array([cells] * len(n), pa.int32())], [id_col, "likeness", "removed", "added", "cells"])

    return run


def _edited_rows(texts: list[str]) -> list[tuple]:
    """(n_chars, sha-256 of the edited text, both fingerprints, likeness to the edited text and the next, paragraphs, cells of the last try) of all texts but the last, the next of each being the one behind it."""
    halves = [len(t) // 2 for t in texts]
    edited = [t[: len(t) - h] + after[:h] for t, after, h in zip(texts, texts[1:], halves, strict=False)]
    r = len(edited)
    rows, digests = paragraphs(pa.array(texts + edited, pa.large_string()))
    n = np.bincount(rows, minlength=2 * r + 1)
    marks = [as_text(*x) for x in zip(n.tolist(), *sketch(rows, digests, 2 * r + 1, CELLS), strict=True)]
    k = np.arange(r)
    pairs = np.concatenate([np.stack([k, k + r + 1], 1), np.stack([k, k + 1], 1)])
    differing, cells = numbers_of_differences(rows, digests, 2 * r + 1, pairs)
    near = likeness(n[pairs[:, 0]], n[pairs[:, 1]], differing).tolist()
    shas = [sha256(t.encode()).hexdigest() for t in edited]
    return list(zip(map(len, texts[:-1]), shas, marks, marks[r + 1 :], near[:r], near[r:], n.tolist(), cells[:r].tolist(), strict=False))


_COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long, cells_edited long"
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, and of it with its last half replaced by the start of the next document's text, with likenesses.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs, cells_edited).
    Documents go by descending id (null last), those of one id by a hash of the text; after the last comes the first.

    Texts are range-sorted once, compressed. Each task reads its part in order; the first text of a part and the last
    one, which needs the first of the next part, are handed on through a stored table.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    kind = dict(docs.dtypes)[id_col]
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    names = [x.split()[0] for x in _COLUMNS.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            raw = batch.column(2).cast(pa.binary()).to_pylist()
            packed = [codec.compress(x, asbytes=True) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in raw], pa.int64()), pa.array(packed, pa.binary())], ["id", "h", "size", "packed"])

    def table(ids: list, rows: list[tuple], part: int, edge: str | None, texts: list[str | None]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else []
        values = [pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)] if rows else [pa.nulls(len(ids), t) for t in _KINDS]
        extra = [pa.array([part] * len(ids), pa.int64()), pa.array([edge] * len(ids), pa.string()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *values, *extra], ["id", *names, "part", "edge", "edge_text"])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part = pa.Codec("zstd"), TaskContext.get().partitionId()
        ids, texts, size = [], [], 0
        for batch in batches:
            for key, n, packed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                text = codec.decompress(packed.as_py(), n, asbytes=True).decode() if n else ""
                if not ids:  # only at the start: the last row of a slice stays
                    yield table([key], [], part, "first", [text])
                ids.append(key)
                texts.append(text)
                size += n
                if size > common.SLICE_BYTES and len(ids) > 1:
                    yield table(ids[:-1], _edited_rows(texts), part, None, [None] * (len(ids) - 1))
                    ids, texts, size = ids[-1:], texts[-1:], n
            common.release()
        if len(ids) > 1:
            yield table(ids[:-1], _edited_rows(texts), part, None, [None] * (len(ids) - 1))
        if ids:
            yield table(ids[-1:], [], part, "last", texts[-1:])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, after in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                yield table([key], _edited_rows([text, after]), 0, None, [None])

    schema = f"id {kind}, {_COLUMNS}, part long, edge string, edge_text string"
    packed = docs.select(F.col(id_col).alias("id"), F.xxhash64(common.text_of(text_col)).alias("h"), common.text_of(text_col).alias("text")).mapInArrow(pack, f"id {kind}, h long, size long, packed binary")
    order = [F.col("id").desc_nulls_last(), F.col("h").desc()]
    done = common.materialise(packed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(edit, schema))
    edges = done.where(F.col("edge").isNotNull())
    parts = sorted(r.part for r in edges.where("edge = 'first'").select("part").collect())  # as many as there are tasks
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "own long, following long")
    lasts = edges.where("edge = 'last'").select("id", "part", "edge_text").join(follows, F.col("part") == F.col("own"))
    firsts = edges.where("edge = 'first'").select(F.col("part").alias("of"), F.col("edge_text").alias("after"))
    joined = lasts.join(firsts, F.col("following") == F.col("of")).select("id", "edge_text", "after").mapInArrow(finish, schema)
    rows = done.where(F.col("edge").isNull()).unionByName(joined)
    return rows.select(F.col("id").alias(id_col), *names)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(common.documents(spark, sf_dir))
