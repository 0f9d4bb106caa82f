"""Queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, exact_dedup, fill_in_middle, fingerprints, html_text, jaccard_join, language_model, licenses, merkle, sharding, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": language_model.op1_lm_scoring,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_shard_placement": sharding.op3_shard_placement,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_html_text": html_text.op5_html_text,
        "op6_ngram_jaccard_join": jaccard_join.op6_ngram_jaccard_join,
        "op7_byte_bpe": byte_bpe.op7_byte_bpe,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_fingerprints": fingerprints.op11_fingerprints,
        "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_exact_dedup": exact_dedup.ORACLE, "op10_decontaminate": decontaminate.ORACLE, "op12_fill_in_middle": fill_in_middle.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
