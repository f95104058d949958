"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from nearscore.llm import chat, exact, packing, quality, rules, sharding, simhash, suffix, tokens, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_bpe": tokens.op2_bpe,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_simhash": simhash.op4_simhash,
    "op5_suffix_dedup": suffix.op5_suffix_dedup,
    "op6_chat_windows": chat.op6_chat_windows,
    "op7_exact_dedup": exact.op7_exact_dedup,
    "op8_warc": warc.op8_warc,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_quality_rules": rules.op10_quality_rules,
}

ORACLE_SQL = {
    "op7_exact_dedup": exact.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
}
