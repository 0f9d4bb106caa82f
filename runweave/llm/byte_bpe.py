"""Byte-level BPE: encoding by overlapping chunks, decoding by concatenation of raw bytes.

Long texts become chunks that overlap. Where two chunks meet, the pre-token boundaries of the later one are
compared with those of a run that began further left; the first common boundary is where they resynchronise,
and both chunks compute the same one from the text they share. Each chunk pre-tokenises from its own such
place and keeps what ends at the next chunk's place if its own boundaries hold that place too; so by
induction from the first chunk all places are boundaries of the whole text. If a chunk's don't, the text is
encoded as one. Pre-tokens depend only on the text to their right, so encoded pieces add up exactly.

Null counts as empty; empty texts have no ids. Repeated rows are encoded each.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Code points of a chunk, and of the overlap on either side of a place where two chunks meet.
CHUNK, OVERLAP = 16_384, 512
#: Boundaries so near to the end of a cut text may come from the cut: the longest look ahead of the patterns is 3.
_MARGIN = 4


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    """The ranks in a file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def tokens_of(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in ranks_of(path).items()}


def raw_of(ids: bytes, path: str) -> bytes:
    """The raw bytes of all tokens, one after another."""
    return b"".join(map(tokens_of(path).__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})


def boundaries(text: str, begin: int, pattern: regex.Pattern) -> list[int]:
    """Ends of the pre-tokens of text[begin:]."""
    return [m.end() for m in pattern.finditer(text, begin)]


def meeting(left: str, right: str, pattern: regex.Pattern) -> int | None:
    """Where, in `right`, boundaries of a run from the start of `left` and of one from the start of `right` agree first.

    Only those after a character that is not white space: a run of white space needs what follows it.
    """
    both, n = left + right, len(left)
    most = len(both) - _MARGIN
    far = {b - n for b in boundaries(both, 0, pattern) if n <= b <= most}
    return next((b for b in [0, *(x - n for x in boundaries(both, n, pattern))] if b in far and not both[n + b - 1 : n + b].isspace()), None)


def piece_of(text: str, first: bool, last: bool, pattern: regex.Pattern, chunk: int = CHUNK, overlap: int = OVERLAP) -> str | None:
    """The part that a chunk has to encode. text: `overlap` code points before it (unless first), its own, and as many after it."""
    own = 0 if first else overlap
    begin = 0 if first else meeting(text[:own], text[own : own + overlap], pattern)
    if begin is None:
        return None
    begin += own
    if last:
        return text[begin:]
    end = own + chunk
    meet = meeting(text[end - overlap : end], text[end : end + overlap], pattern)
    if meet is None or begin > end + meet:
        return None
    held = begin == end + meet or any(m.end() == end + meet for m in pattern.finditer(text, begin))
    return text[begin : end + meet] if held else None


def encode_documents(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> DataFrame:
    """(id, ids) of each document; ids are its tokens as little-endian unsigned 32-bit integers. The file must be on every executor.

    With decoded, also bytes, decoded from these ids beside them: a decoder behind the encoder in one stage would
    be a second Python worker of each task. Only texts of more than one chunk are shuffled, to put their pieces together.
    """
    common.small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(id_col, common.text_of(text_col).alias("text")).withColumn("size", F.char_length("text"))

    def ids_of(text: str) -> bytes:
        return np.array(_encoding(ranks_file, pattern).encode_ordinary(text), "<u4").tobytes()

    def out(keys: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
        raw = [pa.array([raw_of(x, ranks_file) for x in ids], pa.binary())] if decoded else []
        return pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary()), *raw], [id_col, "ids", "bytes"][: 2 + decoded])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in common.slices(batch.column(1)):
                yield out(batch.column(0).slice(a, b - a), [ids_of(t) for t in batch.column(1).slice(a, b - a).to_pylist()])
        _encoding.cache_clear()  # it takes far more memory than the ranks, and the worker lives on

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chunks of each text, encoded one by one; a chunk sees only itself and the overlaps."""
        compiled = regex.compile(pattern)
        for batch in batches:
            for uid, key, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                text = text.as_py()
                n = -(-len(text) // chunk)
                for k in range(n):
                    seen = text[max(0, k * chunk - overlap) : (k + 1) * chunk + overlap]
                    piece = piece_of(seen, k == 0, k == n - 1, compiled, chunk, overlap)
                    row = [uid.as_py()], [k], [None if piece is None else ids_of(piece)], [text[k * chunk : (k + 1) * chunk]]
                    uids, ks, ids, core = (pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.string()), strict=True))
                    yield pa.RecordBatch.from_arrays([uids, pa.array([key.as_py()], batch.column(1).type), ks, ids, core], ["uid", id_col, "k", "ids", "core"])
        _encoding.cache_clear()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for pieces in batch.column(1).to_pylist():
                good = all(p["ids"] is not None for p in pieces)
                ids.append(b"".join(p["ids"] for p in pieces) if good else ids_of("".join(p["core"] for p in pieces)))
            yield out(batch.column(0), ids)

    schema = f"{id_col} {kind}, ids binary" + ", bytes binary" * decoded
    short = texts.where(F.col("size") <= chunk).select(id_col, "text").mapInArrow(whole, schema)
    chunks = texts.where(F.col("size") > chunk).select(F.monotonically_increasing_id().alias("uid"), id_col, "text")
    pieces = chunks.mapInArrow(parts, f"uid long, {id_col} {kind}, k int, ids binary, core string")
    stitched = pieces.groupBy("uid", id_col).agg(F.array_sort(F.collect_list(F.struct("k", "ids", "core"))).alias("pieces"))
    return short.unionByName(stitched.select(id_col, "pieces").mapInArrow(join, schema))


def decode_documents(encoded: DataFrame, ranks_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes): the raw bytes of all tokens, one after another. Ids that the ranks lack are an error."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [raw_of(x.as_py() or b"", ranks_file) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], [id_col, "bytes"])

    return encoded.select(id_col, ids_col).mapInArrow(decode, f"{id_col} {dict(encoded.dtypes)[id_col]}, bytes binary")


def digests(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the ids and of what they decode to."""
    encoded = encode_documents(docs, ranks_file, pattern, decoded=True)
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
