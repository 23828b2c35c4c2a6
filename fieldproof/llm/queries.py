"""Registered corpus queries and their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, fill_middle, license_scan, line_dedup, lm_score, minhash, packing, quality, quality_model, spelling, suffix_dedup, url_filter


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_minhash": minhash.op3_minhash,
        "op4_packing": packing.op4_packing,
        "op5_decontamination": decontaminate.op5_decontamination,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_license_scan": license_scan.op7_license_scan,
        "op8_lm_score": lm_score.op8_lm_score,
        "op9_chat_format": chat_format.op9_chat_format,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_fill_in_middle": fill_middle.op12_fill_in_middle,
        "op13_quality_classifier": quality_model.op13_quality_classifier,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": suffix_dedup.ORACLE,
        "op2_url_filter": url_filter.ORACLE,
        "op3_minhash": minhash.ORACLE,
        "op6_quality_rules": quality.ORACLE,
        "op9_chat_format": chat_format.ORACLE,
        "op10_line_dedup": line_dedup.ORACLE,
        "op11_spelling_variants": spelling.ORACLE,
        "op12_fill_in_middle": fill_middle.ORACLE,
    }
