"""The registered queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, hard_negatives, html_text, licenses, line_dedup, media, packing, quality_rules, sharding, simhash, spelling, token_store, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.query,
        "op2_best_fit_packing": packing.query,
        "op3_html_extraction": html_text.query,
        "op4_sharding": sharding.query,
        "op5_media_columns": media.query,
        "op6_simhash_near_dedup": simhash.query,
        "op7_token_ids": token_store.query,
        "op8_benchmark_decontamination": decontamination.query,
        "op9_license_scan": licenses.query,
        "op10_toxicity": toxicity.query,
        "op11_spelling_variants": spelling.query,
        "op12_hard_negatives": hard_negatives.query,
        "op13_quality_rules": quality_rules.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": sharding.SQL, "op9_license_scan": licenses.sql(), "op11_spelling_variants": spelling.SQL, "op12_hard_negatives": hard_negatives.SQL, "op13_quality_rules": quality_rules.SQL}
