"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import op01_line_dedup, op02_jaccard, op03_packing, op04_quality, op05_media, op06_exact_dedup, op07_language, op08_pii, op09_toxicity, op10_mixing, op11_spelling, op12_filter_audit, op13_tokens

QUERIES = {
    "op1_line_dedup": op01_line_dedup.op1_line_dedup,
    "op2_jaccard": op02_jaccard.op2_jaccard,
    "op3_packing": op03_packing.op3_packing,
    "op4_quality": op04_quality.op4_quality,
    "op5_media": op05_media.op5_media,
    "op6_exact_dedup": op06_exact_dedup.op6_exact_dedup,
    "op7_language": op07_language.op7_language,
    "op8_pii": op08_pii.op8_pii,
    "op9_toxicity": op09_toxicity.op9_toxicity,
    "op10_mixing": op10_mixing.op10_mixing,
    "op11_spelling": op11_spelling.op11_spelling,
    "op12_filter_audit": op12_filter_audit.op12_filter_audit,
    "op13_tokens": op13_tokens.op13_tokens,
}

ORACLE_SQL = {
    "op1_line_dedup": op01_line_dedup.SQL,
    "op2_jaccard": op02_jaccard.SQL,
    "op6_exact_dedup": op06_exact_dedup.SQL,
    "op11_spelling": op11_spelling.SQL,
    "op12_filter_audit": op12_filter_audit.SQL,
}
