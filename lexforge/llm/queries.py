"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import op1_decontaminate, op2_tokens, op3_substrings, op4_mix, op5_quality, op6_minhash, op7_lm, op8_lines, op9_secrets, op10_toxicity

QUERIES = {
    "op1_decontaminate": op1_decontaminate.op1_decontaminate,
    "op2_token_counts": op2_tokens.op2_token_counts,
    "op3_substring_dedup": op3_substrings.op3_substring_dedup,
    "op4_mix": op4_mix.op4_mix,
    "op5_quality": op5_quality.op5_quality,
    "op6_minhash": op6_minhash.op6_minhash,
    "op7_lm_scores": op7_lm.op7_lm_scores,
    "op8_line_dedup": op8_lines.op8_line_dedup,
    "op9_secrets": op9_secrets.op9_secrets,
    "op10_toxicity": op10_toxicity.op10_toxicity,
}

ORACLES = {
    "op1_decontaminate": op1_decontaminate.SQL,
    "op3_substring_dedup": op3_substrings.SQL,
    "op4_mix": op4_mix.SQL,
    "op5_quality": op5_quality.SQL,
    "op6_minhash": op6_minhash.SQL,
}
