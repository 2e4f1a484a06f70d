"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from fieldlab.llm import decontamination, embedding_dedup, exact_dedup, hard_negatives, language_id, line_dedup, mixing, near_dedup, secrets, sharding, substring_dedup, token_counts, whitening

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_sharding": sharding.op3_sharding,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_language_id": language_id.op9_language_id,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_embedding_dedup": embedding_dedup.op11_embedding_dedup,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLES = {
    "op2_near_dedup": near_dedup.OP2_SQL,
    "op4_decontamination": decontamination.OP4_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op6_mix_sources": mixing.OP6_SQL,
    "op8_substring_dedup": substring_dedup.OP8_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_embedding_dedup": embedding_dedup.OP11_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
