"""The queries of the text operators and their SQL."""

from __future__ import annotations

from . import alignment, conversations, exact_dedup, language_id, mixing, ngram_jaccard, packing, quality, records, substring_dedup, suffix_dedup, topk, url_filter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_topk": topk.op3_topk,
    "op4_packing": packing.op4_packing,
    "op5_language_id": language_id.op5_language_id,
    "op6_binary_records": records.op6_binary_records,
    "op7_mixing": mixing.op7_mixing,
    "op8_ngram_jaccard": ngram_jaccard.op8_ngram_jaccard,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_substring_dedup": substring_dedup.op11_substring_dedup,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_conversations": conversations.op13_conversations,
}
ORACLES = {"op2_url_filter": url_filter.ORACLE, "op3_topk": topk.ORACLE, "op7_mixing": mixing.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE, "op11_substring_dedup": substring_dedup.ORACLE, "op13_conversations": conversations.ORACLE}
