"""Fill-in-the-middle: each text is cut at two ends of its units, and the middle is moved behind prefix and suffix.

Bit-parallel over whole texts as big integers, of which bit i stands for byte i: `bytes.translate` makes the mask of
a class of bytes, shifts and boolean operations turn it into the mask of the units' ends, `bit_count` gives their
number, and halving the mask again and again, with a count of the lower half each time, selects the end of a rank.
Code points before a cut are counted in the mask of their first bytes.

A unit is a line with its line feed, a word with the white space behind it (white space at the start is a unit
too), or a code point. Cuts and forms come from a hash of seed and id, so repeated rows and a run again agree; a
null id counts as an empty one, a null text as an empty text. Empty texts, texts that hold a marker and the share
beyond `rate` stay plain. Nothing is shuffled. Other columns than id and text are left out. Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")


def _class(inside: set[int]) -> bytes:
    return bytes(48 + (b in inside) for b in range(256))


_LINE_FEED = _class({0x0A})
_SPACE = _class({0x20, *range(0x09, 0x0E)})
_FIRST = _class(set(range(256)) - set(range(0x80, 0xC0)))


def mask_of(raw: bytes, of: bytes) -> int:
    """The bytes of a class: bit i is byte i. `of` maps bytes to the digits 0 and 1."""
    return int(raw[::-1].translate(of), 2) if raw else 0


def unit_ends(raw: bytes, unit: str) -> int:
    """The mask of the last bytes of the units."""
    last = 1 << len(raw) >> 1
    if unit == "line":
        return mask_of(raw, _LINE_FEED) | last
    if unit == "word":
        space = mask_of(raw, _SPACE)
        return space & ~(space >> 1) | last
    return mask_of(raw, _FIRST) >> 1 | last


def select(mask: int, rank: int, width: int) -> int:
    """The place of the set bit that has `rank` set bits below it."""
    at = 0
    while width > 1:
        half = width // 2
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            mask, width = low, half
        else:
            mask, width, rank, at = mask >> half, width - half, rank - below, at + half
    return at


def cut(raw: bytes, ends: int, units: int) -> int:
    """Bytes of the first so many units."""
    return select(ends, units - 1, len(raw)) + 1 if units else 0


def _checked(markers: tuple[str, str, str]) -> list[bytes]:
    """The markers' bytes. A marker that starts as it ends could be found across a cut, so the text could not be restored."""
    if len(set(markers)) < 3 or any(not m or any(m.startswith(m[k:]) for k in range(1, len(m))) for m in markers):
        raise ValueError("markers must differ, and none may start with what it ends with")
    return [m.encode() for m in markers]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of each row.

    n: units. form: plain, psm (prefix, suffix, middle) or spm (suffix first). rate, spm: per cent of texts that are
    transformed, and of these of form spm. Cuts stand after min and max of two hashes modulo n + 1.
    """
    if unit not in ("line", "word", "char"):
        raise ValueError("unit is line, word or char")
    p, s, m = _checked(markers)
    common.small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col), common.text_of(text_col), *(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))

    def transformed(raw: bytes, h: list[int]) -> tuple:
        ends = unit_ends(raw, unit)
        n = ends.bit_count()
        if not raw or any(x in raw for x in (p, s, m)) or h[2] % 100 >= rate:
            return n, "plain", None, None, raw
        a, b = (cut(raw, ends, k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
        first = mask_of(raw[:b], _FIRST)
        before = (first & ((1 << a) - 1)).bit_count()
        form = "spm" if h[3] % 100 < spm else "psm"
        head = (p, raw[:a], s, raw[b:]) if form == "psm" else (s, raw[b:], p, raw[:a])
        return n, form, before, first.bit_count() - before, b"".join((*head, m, raw[a:b]))

    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in common.slices(batch.column(1)):
                own = batch.slice(a, b - a)
                hashes = zip(*(own.column(k).to_pylist() for k in range(2, 6)), strict=True)
                rows = [transformed(raw, h) for raw, h in zip(own.column(1).cast(pa.binary()).to_pylist(), hashes, strict=True)]
                out = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([own.column(0), *out[:-1], out[-1].cast(pa.string())], [id_col, *names])

    kind = dict(docs.dtypes)[id_col]
    return rows.mapInArrow(batches_of, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made from: its parts, found between the markers, put back in place."""
    _checked(markers)
    p, s, m = markers

    def split(text: Column, mark: str) -> tuple[Column, Column]:
        head = F.substring_index(text, mark, 1)
        return head, F.substr(text, F.char_length(head) + len(mark) + 1)

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        one, rest = split(split(output, first)[1], second)
        return one, *split(rest, m)

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(common.documents(spark, sf_dir))
    text = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), k AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, u,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM k
), p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""
