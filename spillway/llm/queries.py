"""The queries of this folder and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import (
    byte_bpe,
    chat_format,
    fingerprint,
    language,
    mixture,
    periodic_runs,
    quality_model,
    quality_rules,
    simhash_dedup,
    substring_dedup,
    token_align,
    token_count,
    toxicity,
)

QUERIES = {
    "op1_token_counts": token_count.op1_token_counts,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_simhash_dedup": simhash_dedup.op3_simhash_dedup,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_mixture": mixture.op5_mixture,
    "op6_quality_model": quality_model.op6_quality_model,
    "op7_language": language.op7_language,
    "op8_fingerprints": fingerprint.op8_fingerprints,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_chat_format": chat_format.op12_chat_format,
    "op13_token_align": token_align.op13_token_align,
}

ORACLE_SQL = {
    "op4_substring_dedup": substring_dedup.SQL,
    "op5_mixture": mixture.SQL,
    "op12_chat_format": chat_format.SQL,
}
