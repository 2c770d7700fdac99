"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, hidden_markov, jaccard_join, language_id, license_scan, line_dedup, nearest, packing, sharding, spelling, substring_dedup, token_counts, whitening


def queries() -> dict:
    return {
        "op1_nearest": nearest.op1_nearest,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_packing": packing.op4_packing,
        "op5_language_id": language_id.op5_language_id,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_sharding": sharding.op7_sharding,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_lm_scoring": hidden_markov.op9_lm_scoring,
        "op10_substring_dedup": substring_dedup.op10_substring_dedup,
        "op11_whitening": whitening.op11_whitening,
        "op12_token_counts": token_counts.op12_token_counts,
        "op13_spelling": spelling.op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_nearest": nearest.OP1_SQL,
        "op3_line_dedup": line_dedup.OP3_SQL,
        "op6_jaccard_join": jaccard_join.OP6_SQL,
        "op8_decontamination": decontamination.OP8_SQL,
        "op10_substring_dedup": substring_dedup.OP10_SQL,
        "op13_spelling": spelling.OP13_SQL,
    }
