"""The queries of the corpus operators by name, and SQL for DuckDB where it can express them."""

from __future__ import annotations

from . import compression_quality, filter_audit, language, media, mixing, packing, quality, resampling, secret_scan, sharding, simhash, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_secret_scan": secret_scan.op1_secret_scan,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_sharding": sharding.op3_sharding,
        "op4_simhash": simhash.op4_simhash,
        "op5_mixing": mixing.op5_mixing,
        "op6_language": language.op6_language,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_media": media.op9_media,
        "op10_packing": packing.op10_packing,
        "op11_importance_resampling": resampling.op11_importance_resampling,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_compression_quality": compression_quality.op13_compression_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_importance_resampling": resampling.OP11_SQL, "op12_filter_audit": filter_audit.OP12_SQL}
