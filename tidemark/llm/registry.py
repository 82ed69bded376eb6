"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import decontaminate, hilbert_ann, language_id, license_scan, mix_sources, near_dedup, ngram_lm, revisits, substring_dedup, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_mix_sources": mix_sources.query,
    "op3_toxicity": toxicity.query,
    "op4_language_id": language_id.query,
    "op5_warc_revisits": revisits.query,
    "op6_hilbert_ann": hilbert_ann.query,
    "op7_license_scan": license_scan.query,
    "op8_near_dedup": near_dedup.query,
    "op9_decontamination": decontaminate.query,
    "op10_ngram_lm": ngram_lm.query,
}

SQL: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op2_mix_sources": mix_sources.SQL,
    "op5_warc_revisits": revisits.SQL,
    "op7_license_scan": license_scan.SQL,
    "op9_decontamination": decontaminate.SQL,
}
