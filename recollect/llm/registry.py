"""The registered queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recollect.llm import alignment, decontaminate, embedding_dedup, extraction, language_id, licenses, mixing, negatives, preferences, simhash, sql, token_counts, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_language_id": language_id.op2_language_id,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_embedding_near_dedup": embedding_dedup.op4_embedding_near_dedup,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_license_scan": licenses.op9_license_scan,
        "op10_preference_format": preferences.op10_preference_format,
        "op11_hard_negatives": negatives.op11_hard_negatives,
        "op12_html_extraction": extraction.op12_html_extraction,
        "op13_token_alignment": alignment.op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
