"""Queries of this subpackage, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, chat_format, decontaminate, exact_dedup, hard_negatives, jaccard_join, language_gru, pii_crf, pitman_yor, secret_scan, simhash, token_align, token_planes

QUERIES = {
    "op1_secret_scan": secret_scan.query,
    "op2_chat_format": chat_format.query,
    "op3_token_planes": token_planes.query,
    "op4_jaccard_join": jaccard_join.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_language_gru": language_gru.query,
    "op7_decontaminate": decontaminate.query,
    "op8_pii_crf": pii_crf.query,
    "op9_pitman_yor": pitman_yor.query,
    "op10_byte_bpe": byte_bpe.query,
    "op11_simhash_golay": simhash.query,
    "op12_token_align": token_align.query,
    "op13_hard_negatives": hard_negatives.query,
}

ORACLE_SQL = {
    "op2_chat_format": chat_format.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
