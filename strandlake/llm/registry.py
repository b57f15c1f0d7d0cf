"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    op1_packing,
    op2_quality_rules,
    op3_quality_classifier,
    op4_decontamination,
    op5_toxicity,
    op6_simhash,
    op7_token_counts,
    op8_substring_dedup,
    op9_sharding,
    op10_language_id,
    op11_token_files,
    op12_hard_negatives,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing.query,
        "op2_quality_rules": op2_quality_rules.query,
        "op3_quality_classifier": op3_quality_classifier.query,
        "op4_decontamination": op4_decontamination.query,
        "op5_toxicity": op5_toxicity.query,
        "op6_simhash_dedup": op6_simhash.query,
        "op7_token_counts": op7_token_counts.query,
        "op8_substring_dedup": op8_substring_dedup.query,
        "op9_sharding": op9_sharding.query,
        "op10_language_id": op10_language_id.query,
        "op11_token_files": op11_token_files.query,
        "op12_hard_negatives": op12_hard_negatives.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": op4_decontamination.SQL, "op12_hard_negatives": op12_hard_negatives.SQL}
