"""The queries of this folder and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, exact_dedup, language_id, lm_scoring, near_dedup, packing, quality, sentencepiece_codec, toxicity, url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_sentencepiece": sentencepiece_codec.op4_sentencepiece,
        "op5_language_id": language_id.op5_language_id,
        "op6_quality": quality.op6_quality,
        "op7_url_filters": url_filters.op7_url_filters,
        "op8_near_dedup": near_dedup.op8_near_dedup,
        "op9_packing": packing.op9_packing,
        "op10_lm_scoring": lm_scoring.op10_lm_scoring,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_dedup": embedding_dedup.SQL,
        "op2_exact_dedup": exact_dedup.SQL,
        "op7_url_filters": url_filters.SQL,
        "op8_near_dedup": near_dedup.SQL,
        "op10_lm_scoring": lm_scoring.SQL,
    }
