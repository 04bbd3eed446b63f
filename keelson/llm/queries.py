"""Queries of the training-data operators (``opN_<name>``) and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, dedup, html, linededup, lm, mixing, neardup, phrases, quality, secrets, tokenfile, toxicity, whitening

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_token_files": tokenfile.op2_token_files,
    "op3_exact_dedup": dedup.op3_exact_dedup,
    "op4_html": html.op4_html,
    "op5_bpe": bpe.op5_bpe,
    "op6_language_model": lm.op6_language_model,
    "op7_quality": quality.op7_quality,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_near_duplicates": neardup.op9_near_duplicates,
    "op10_secrets": secrets.op10_secrets,
    "op11_line_dedup": linededup.op11_line_dedup,
    "op12_whitening": whitening.op12_whitening,
    "op13_phrases": phrases.op13_phrases,
}
ORACLES = {
    "op3_exact_dedup": dedup.OP3_SQL,
    "op7_quality": quality.OP7_SQL,
    "op9_near_duplicates": neardup.OP9_SQL,
    "op11_line_dedup": linededup.OP11_SQL,
    "op13_phrases": phrases.OP13_SQL,
}
