"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, fingerprints, language_id, language_model, mixing, near_dedup, pii, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.query,
    "op2_chat_format": chat_format.query,
    "op3_scaled_sketch": fingerprints.query,
    "op4_decontaminate": decontaminate.query,
    "op5_mix_sources": mixing.query,
    "op6_toxicity": toxicity.query,
    "op7_pii": pii.query,
    "op8_suffix_dedup": suffix_dedup.query,
    "op9_perplexity": language_model.query,
    "op10_simhash_dedup": near_dedup.query,
}

ORACLE_SQL: dict[str, str] = {"op2_chat_format": chat_format.SQL, "op5_mix_sources": mixing.SQL}
