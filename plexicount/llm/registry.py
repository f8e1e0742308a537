"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, license_scan, lm_scoring, near_dup, packing, pii, quality_rules, token_counts, url_filter


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_pii": pii.op2_pii,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_lm_scoring": lm_scoring.op4_lm_scoring,
        "op5_chat_format": chat_format.op5_chat_format,
        "op6_near_duplicates": near_dup.op6_near_duplicates,
        "op7_decontamination": decontaminate.op7_decontamination,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_quality_rules": quality_rules.op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_scan": license_scan.OP3_SQL,
        "op5_chat_format": chat_format.OP5_SQL,
        "op7_decontamination": decontaminate.OP7_SQL,
        "op8_url_filter": url_filter.OP8_SQL,
        "op10_quality_rules": quality_rules.OP10_SQL,
    }
