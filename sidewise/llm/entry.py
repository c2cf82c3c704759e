"""Queries of this folder and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    fingerprints,
    language_id,
    line_dedup,
    mixing,
    near_dedup,
    packing,
    substring_dedup,
    token_counts,
    token_files,
    top_k,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_token_files": token_files.op3_token_files,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_exact_top_k": top_k.op8_exact_top_k,
    "op9_near_duplicates": near_dedup.op9_near_duplicates,
    "op10_language_id": language_id.op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op6_substring_dedup": substring_dedup.OP6_SQL,
    "op8_exact_top_k": top_k.OP8_SQL,
    "op9_near_duplicates": near_dedup.OP9_SQL,
}


def oracle_sql() -> dict[str, str]:
    """SQL by query; that of operator 2 holds its vocabulary, so it is made when asked for."""
    return {**ORACLE_SQL, "op2_token_counts": token_counts.op2_sql()}
