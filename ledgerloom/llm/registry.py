"""The training-data queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embeddings, jaccard, langid, lexical, licenses, mixing, pii, preferences, quality, rules, urls, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": langid.language_query,
        "op2_url_cascade": urls.url_query,
        "op3_temperature_mixing": mixing.mixing_query,
        "op4_quality_gam": quality.quality_query,
        "op5_sorted_projections": embeddings.embedding_query,
        "op6_byte_bpe": bpe.digest_query,
        "op7_preference_pairs": preferences.preference_query,
        "op8_divergence_rules": rules.rules_query,
        "op9_jaccard_join": jaccard.jaccard_query,
        "op10_license_scan": licenses.license_query,
        "op11_whitening": whitening.whitening_query,
        "op12_weak_pii": pii.pii_query,
        "op13_ranked_search": lexical.search_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_cascade": urls.ORACLE,
        "op5_sorted_projections": embeddings.ORACLE,
        "op7_preference_pairs": preferences.ORACLE,
        "op9_jaccard_join": jaccard.ORACLE,
        "op13_ranked_search": lexical.ORACLE,
    }
