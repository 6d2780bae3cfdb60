"""The queries of this subpackage by name, and their DuckDB oracles."""

from __future__ import annotations

from . import op1_exact_dedup, op2_language_id, op3_exact_topk, op4_jaccard_join, op5_mixing, op6_suffix_dedup, op7_secrets, op8_quality, op9_pii, op10_bpe, op11_whitening, op12_prefix_trie, op13_substring_dedup

MODULES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_language_id": op2_language_id,
    "op3_exact_topk": op3_exact_topk,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_mixing_sources": op5_mixing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_secrets": op7_secrets,
    "op8_quality": op8_quality,
    "op9_pii_surrogates": op9_pii,
    "op10_byte_bpe": op10_bpe,
    "op11_whitening": op11_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_substring_dedup": op13_substring_dedup,
}


def queries() -> dict:
    return {name: m.query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.ORACLE for name, m in MODULES.items() if getattr(m, "ORACLE", None)}
