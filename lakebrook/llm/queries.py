"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, chat_format, html_extract, jaccard_join, line_dedup, packing, quality_classifier, quality_rules, suffix_dedup, top_k, turn_repair, url_filter, whitening

QUERIES = {
    "op1_html_extract": html_extract.query,
    "op2_line_dedup": line_dedup.query,
    "op3_jaccard_join": jaccard_join.query,
    "op4_quality_rules": quality_rules.query,
    "op5_quality_classifier": quality_classifier.query,
    "op6_packing": packing.query,
    "op7_byte_bpe": byte_bpe.query,
    "op8_top_k": top_k.query,
    "op9_chat_format": chat_format.query,
    "op10_url_filter": url_filter.query,
    "op11_whitening": whitening.query,
    "op12_suffix_dedup": suffix_dedup.query,
    "op13_turn_repair": turn_repair.query,
}

ORACLES = {
    "op8_top_k": top_k.ORACLE,
    "op9_chat_format": chat_format.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
}
