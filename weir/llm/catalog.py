"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from weir.llm import decontaminate, exact_dedup, html_text, langid, near_dedup, packing, pii, quality, token_files, toxicity

QUERIES = {
    "op1_near_dedup": near_dedup.query,
    "op2_packing": packing.query,
    "op3_toxicity": toxicity.query,
    "op4_quality": quality.query,
    "op5_html_text": html_text.query,
    "op6_decontaminate": decontaminate.query,
    "op7_pii": pii.query,
    "op8_language_id": langid.query,
    "op9_token_files": token_files.query,
    "op10_exact_dedup": exact_dedup.query,
}
SQL = {
    "op1_near_dedup": near_dedup.SQL,
    "op5_html_text": html_text.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
