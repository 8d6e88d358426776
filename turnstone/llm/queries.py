"""The queries of this subpackage and the SQL of those that SQL can express.

Toxicity (a trained model), the Jaccard join and the byte repeats (all pairs and all windows are too much for SQL on
whole tables), the line rules and the packing (any numbers are right) are held against brute force in tests/llm."""

from __future__ import annotations

from . import best_fit_packing, chat_format, code_compression, embedding_dedup, exact_dedup, hard_negatives, jaccard_join, license_scan, quality_rules, source_mixing, suffix_dedup, toxicity, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        source_mixing.op1_source_mixing,
        url_filter.op2_url_filter,
        quality_rules.op3_quality_rules,
        license_scan.op4_license_scan,
        jaccard_join.op5_jaccard_join,
        chat_format.op6_chat_format,
        exact_dedup.op7_exact_dedup,
        suffix_dedup.op8_suffix_dedup,
        toxicity.op9_toxicity,
        best_fit_packing.op10_best_fit_packing,
        hard_negatives.op11_hard_negatives,
        code_compression.op12_vector_codes,
        embedding_dedup.op13_embedding_dedup,
    )
}

ORACLE_SQL = {
    "op1_source_mixing": source_mixing.ORACLE,
    "op2_url_filter": url_filter.ORACLE,
    "op4_license_scan": license_scan.ORACLE,
    "op6_chat_format": chat_format.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_vector_codes": code_compression.ORACLE,
    "op13_embedding_dedup": embedding_dedup.ORACLE,
}
