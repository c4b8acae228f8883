"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from stockroom.llm import (
    chat_format,
    decontaminate,
    filter_audit,
    html_extract,
    language_id,
    pivot_clusters,
    quality_rules,
    secret_scan,
    sentencepiece_lattice,
    simhash,
    suffix_dedup,
    token_counts,
    topk_search,
)

QUERIES = {
    "op1_chat_formatting": chat_format.op1_chat_formatting,
    "op2_sentencepiece": sentencepiece_lattice.op2_sentencepiece,
    "op3_language_id": language_id.op3_language_id,
    "op4_secret_scans": secret_scan.op4_secret_scans,
    "op5_suffix_array_dedup": suffix_dedup.op5_suffix_array_dedup,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_html_extraction": html_extract.op8_html_extraction,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
    "op11_exact_top_k": topk_search.op11_exact_top_k,
    "op12_filter_interaction_audit": filter_audit.op12_filter_interaction_audit,
    "op13_centroid_clustering": pivot_clusters.op13_centroid_clustering,
}

ORACLE_SQL = {
    "op9_quality_rules": quality_rules.ORACLE,
    "op10_benchmark_decontamination": decontaminate.ORACLE,
    "op11_exact_top_k": topk_search.ORACLE,
    "op12_filter_interaction_audit": filter_audit.ORACLE,
    "op13_centroid_clustering": pivot_clusters.ORACLE,
}
