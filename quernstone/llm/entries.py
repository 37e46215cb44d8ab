"""The queries of this subpackage, and their SQL where it can say them."""

from __future__ import annotations

from quernstone.llm import bit_codes, decontaminate, filter_audit, host_rules, html_text, licences, line_crf, lm_score, mixing, near_dups, pii, sharding, turn_repair

QUERIES = {
    "op1_near_dups": near_dups.op1_near_dups,
    "op2_lm_score": lm_score.op2_lm_score,
    "op3_shards": sharding.op3_shards,
    "op10_html_text": html_text.op10_html_text,
    "op4_pii": pii.op4_pii,
    "op5_licences": licences.op5_licences,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_line_quality": line_crf.op7_line_quality,
    "op8_host_rules": host_rules.op8_host_rules,
    "op9_mix": mixing.op9_mix,
    "op11_turn_repair": turn_repair.op11_turn_repair,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_bit_codes": bit_codes.op13_bit_codes,
}
ORACLES: dict[str, str] = {
    "op6_decontaminate": decontaminate.ORACLE_SQL,
    "op8_host_rules": host_rules.ORACLE_SQL,
    "op11_turn_repair": turn_repair.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
    "op13_bit_codes": bit_codes.ORACLE_SQL,
}
