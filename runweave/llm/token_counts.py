"""Token counts: lengths only, from batches of pieces that are balanced by bytes.

Texts are cut where a character that is not white space stands before a blank, and where an ASCII letter stands
before a stop. No token of a byte-level tokenizer whose words are ` ?letters`, ` ?digits`, ` ?other` or white
space crosses such a place, so lengths of the pieces add up to that of the text. A run without such a place (a text
without blanks) is one piece. If the file's tokenizer normalises, splits otherwise, puts a blank before texts, or has
an added token with such a place, texts are not cut. Equal pieces of a batch are encoded once, and a
worker remembers the lengths of the pieces that it met first, up to a bound.

Null counts as empty; empty texts have no tokens. Repeated rows are counted each.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LIMIT = 1024
#: Bytes of new pieces that one call encodes, and the most pieces that a worker remembers.
BATCH_BYTES, REMEMBERED = 128 << 10, 1_000_000

#: Safe places. Python's white space covers all that other rules call white space.
_SAFE = re.compile(r"(?<=\S)(?= )|(?<=[A-Za-z])(?=[.,;:!?])")


class Counter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        rules = parts.get("pre_tokenizer") or {}
        usual = parts.get("normalizer") is None and rules.get("type") == "ByteLevel" and rules.get("use_regex", True) and not rules.get("add_prefix_space", False)
        self.safe = usual and not any(_SAFE.search(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.known: dict[str, int] = {}

    def _encode(self, pieces: list[str]) -> list[int]:
        out, batch, held = [], [], 0
        for piece in [*pieces, None]:
            if batch and (piece is None or held + len(piece) > BATCH_BYTES):
                out += map(len, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False))
                batch, held = [], 0
            if piece is not None:
                batch.append(piece)
                held += len(piece)
        return out

    def lengths(self, texts: list[str]) -> list[int]:
        """Lengths in tokens."""
        pieces = [_SAFE.split(text) if self.safe else [text] for text in texts]
        new = sorted(set().union(*pieces) - self.known.keys(), key=len)
        known = self.known
        known.update(zip(new, self._encode(new), strict=True))
        out = [sum(map(known.__getitem__, own)) for own in pieces]
        for piece in new[max(0, len(new) - max(0, len(known) - REMEMBERED)) :]:
            del known[piece]
        return out


@lru_cache(maxsize=2)
def counter_of(path: str) -> Counter:
    """One for each file and worker: later tasks profit from what earlier ones remembered."""
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of each document; no shuffle. The file must be at this path on every executor."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer_file)
        for batch in batches:
            texts = batch.column(1)
            for a, b in common.slices(texts):
                n = counter.lengths(texts.slice(a, b - a).to_pylist())
                sizes = common.offsets_of(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes[1:] - sizes[:-1]), pa.array(n, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, common.text_of(text_col).alias("text")).mapInArrow(count, f"{id_col} {kind}, n_bytes long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = count_tokens(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
