"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnfold.llm import html_extract, jaccard_join, langid, lm_scoring, media, mixing, packing, quality, sharding, suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": jaccard_join.op1_jaccard_join,
        "op2_best_fit_pack": packing.op2_best_fit_pack,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_html_extract": html_extract.op4_html_extract,
        "op5_media_columns": media.op5_media_columns,
        "op6_language_id": langid.op6_language_id,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_shard_balanced": sharding.op8_shard_balanced,
        "op9_lm_scores": lm_scoring.op9_lm_scores,
        "op10_mix_sources": mixing.op10_mix_sources,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": jaccard_join.ORACLE, "op7_quality_rules": quality.ORACLE, "op10_mix_sources": mixing.ORACLE}
