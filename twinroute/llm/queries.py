"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, html_extraction, language_id, maxent_lm, packing, quality_rules, ranked_search, simhash_dedup, structure_repair, substring_dedup, toxicity, url_filters

QUERIES = {
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_structure_repair": structure_repair.op12_structure_repair,
    "op13_html_extraction": html_extraction.op13_html_extraction,
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_language_id": language_id.op4_language_id,
    "op5_simhash_dedup": simhash_dedup.op5_simhash_dedup,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_maxent_lm": maxent_lm.op8_maxent_lm,
    "op9_toxicity": toxicity.op9_toxicity,
}

ORACLES = {
    "op11_ranked_search": ranked_search.ORACLE,
    "op1_chat_format": chat_format.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op7_url_filters": url_filters.ORACLE,
}
