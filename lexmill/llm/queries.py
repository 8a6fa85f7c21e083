"""The registered queries of this subpackage and the SQL that some of them are compared with."""

from __future__ import annotations

from . import counts, decontaminate, exact, html, jaccard, pitmanyor, quality, resampling, secrets, sentencepieces, substring, suffix, whitening

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_suffix_array_dedup": suffix.op3_suffix_array_dedup,
    "op4_html_extraction": html.op4_html_extraction,
    "op5_substring_dedup": substring.op5_substring_dedup,
    "op6_lm_scoring": pitmanyor.op6_lm_scoring,
    "op7_ngram_jaccard_join": jaccard.op7_ngram_jaccard_join,
    "op8_exact_dedup": exact.op8_exact_dedup,
    "op9_token_counts": counts.op9_token_counts,
    "op10_sentencepiece_encoding_decoding": sentencepieces.op10_sentencepiece_encoding_decoding,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_secret_scans": secrets.op12_secret_scans,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}

ORACLES = {
    "op8_exact_dedup": exact.OP8_SQL,
    "op13_importance_resampling": resampling.OP13_SQL,
}
