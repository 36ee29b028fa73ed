"""Queries of this subpackage and the SQL another engine runs on the same tables."""

from __future__ import annotations

from scenespark.llm import (
    collocations, decontamination, language_id, packing, piece_encoding, quality_rules, secret_scan, simhash, suffix_dedup,
    token_alignment, url_filter,
)
from scenespark.llm.quality_classifier import op8_quality_classifier
from scenespark.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_language_id": language_id.op5_language_id,
    "op6_simhash": simhash.op6_simhash,
    "op7_packing": packing.op7_packing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_piece_encoding": piece_encoding.op11_piece_encoding,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_collocations": collocations.op13_collocations,
}
SQL: dict[str, str] = {
    "op1_secret_scan": secret_scan.SQL,
    "op2_quality_rules": quality_rules.SQL,
    "op3_suffix_dedup": suffix_dedup.SQL,
    "op4_decontamination": decontamination.SQL,
    "op9_url_filter": url_filter.SQL,
    "op13_collocations": collocations.SQL,
}
