"""A training corpus from documents: toxic ones go, copies go, near copies go, contaminated ones go, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result to the shared folder
and reads it back as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runweave.llm import byte_bpe, common, decontaminate, exact_dedup, jaccard_join, toxicity


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among docs, does not call toxic."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, common.documents(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside."""
    return exact_dedup.drop_copies(docs, stored=common.is_stored(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more."""
    return jaccard_join.drop_near_copies(docs, stored=common.is_stored(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return decontaminate.drop_contaminated(docs, common.documents(spark, sf_dir, "benchmark"), stored=common.is_stored(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left."""
    import public_tokenizers

    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("decontamination", decontamination),
    ("byte_bpe", encoding),
]

#: No SQL expresses the trained classifier or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir))
    return docs
